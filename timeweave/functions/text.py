"""Text and script functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a delivery note that slow speech down or speed it up.
SLOW = ["slow", "reflective", "gentle", "soft", "quiet", "tender", "melancholy", "thoughtful", "measured", "careful", "somber", "subdued", "calm", "tranquil", "still", "languid"]
FAST = ["quick", "fast", "rushed", "excited", "urgent", "energetic", "frantic", "animated", "lively", "snappy", "rapid"]
# Transcripts that stand for silence.
SILENT = ["you", ".", "I", "Bye.", "Hey."]
# Fillers that are not dialogue.
FILLERS = [
    "uh", "uhh", "uhhh", "um", "umm", "oh", "ohh", "ah", "ahh", "ahhh", "huh", "mm", "mmm", "hm", "hmm", "hmmm", "eh", "ehh", "wow", "oof", "ouch", "ow", "oww", "ugh",
    "어", "음", "아", "오", "허", "후", "흠", "헉", "haha", "hehe", "hihi", "lol",
]
# Language codes and names.
LANGUAGES = {"en": "English", "ko": "Korean", "ja": "Japanese", "zh": "Chinese", "fr": "French", "de": "German", "es": "Spanish", "ru": "Russian", "ar": "Arabic", "pt": "Portuguese", "it": "Italian", "nl": "Dutch"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), default if isinstance(default, Column) else F.lit(default))


def count_of(text: Column, kept: str) -> Column:
    """How many characters fall in a regular-expression class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]", "")).cast("long")


def hangul_count(text: Column) -> Column:
    return count_of(text, "가-힣")


def script_counts(text: Column) -> Column:
    """Letters in all, Korean, ASCII and other."""
    total, korean, ascii_ = count_of(text, r"\p{L}"), hangul_count(text), count_of(text, "a-zA-Z")
    return F.struct(total.alias("total"), korean.alias("korean"), ascii_.alias("ascii"), (total - korean - ascii_).alias("other"))


def leak_class(text: Column) -> Column:
    """silent, OTHER (a non-ASCII letter that is not Korean), ENG, MIXED or clean; the first that fits."""
    korean, english = text.rlike("[가-힣]"), text.rlike("[a-zA-Z]")
    return (
        F.when(text.isNull() | (text == "") | text.isin(SILENT), "silent").when(F.regexp_replace(text, r"[가-힣\x00-\x7F]", "").rlike(r"\p{L}"), "OTHER")
        .when(english & ~korean, "ENG").when(english & korean, "MIXED").otherwise("clean")
    )


def desc_rate(description: Column) -> Column:
    """Pace factor of a delivery note: slow words before fast ones, anywhere in it."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.when(low.rlike("|".join(SLOW)), 0.85).when(low.rlike("|".join(FAST)), 1.05).otherwise(1.0)


def norm_token(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def sentences(text: Column) -> Column:
    """Runs up to and with their end marks; a tail without one counts too."""
    found = F.regexp_extract_all(text, F.lit(r"[^.?!。？！]*[.?!。？！]+|[^.?!。？！]+"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def lang_code(name: Column) -> Column:
    """ISO code of a language name; an unknown name in lower case, a missing one en."""
    return F.when(name.isNull() | (name == ""), "en").otherwise(lookup({v: k for k, v in LANGUAGES.items()}, name, F.lower(name)))


def lang_name(code: Column) -> Column:
    return lookup(LANGUAGES, code, F.lower(code))


def strip_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']+|[\"']+$", "")


def short_name(file: Column) -> Column:
    """At most ten ASCII letters, digits or Hangul of a file name; run if none is left."""
    kept = F.substring(F.regexp_replace(file, "[^a-zA-Z0-9가-힣]", ""), 1, 10)
    return F.when(kept == "", "run").otherwise(kept)


def speaker_number(label: Column) -> Column:
    return F.when(label.rlike(r"\d+$"), F.regexp_extract(label, r"(\d+)$", 1).cast("long"))


def is_outlier(label: Column) -> Column:
    return F.coalesce(speaker_number(label) > 90, F.lit(False))


def is_dialogue(text: Column) -> Column:
    """False for blank text, fillers (trailing marks aside), and one token of under three characters."""
    t = F.trim(text)
    bare = F.regexp_replace(F.lower(t), "[.,!?~]+$", "")
    return ~((t == "") | bare.isin(FILLERS) | ((F.length(t) < 3) & (F.size(F.split(t, r"\s+")) <= 1)))
