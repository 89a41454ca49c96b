"""Speech planning: rates, targets, retries and stretches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions.text import desc_rate, lookup

# Fixed values.
EMOTION_SPEED = {"Sad": 0.92, "Angry": 1.05, "Surprised": 1.05, "Happy": 1.0, "Scared": 0.95, "Neutral": 1.0}
TARGET_FACTOR = {"Sad": 0.85, "Scared": 0.85, "Angry": 0.95, "Happy": 1.0, "Surprised": 1.0, "Neutral": 1.0}
PREDICT_FACTOR = {"Sad": 0.75, "Scared": 0.80, "Neutral": 1.0, "Happy": 1.0, "Angry": 0.95, "Surprised": 1.0}
SPEECH_RATE = {"ko": 5.5, "ja": 7.5, "zh": 5.0, "en": 3.5, "es": 6.5, "fr": 6.0, "de": 4.5, "ru": 5.0, "pt": 5.5, "it": 6.0, "ar": 5.0, "nl": 4.5}
LABELS = {"angry": "Angry", "sad": "Sad", "happy": "Happy", "surprise": "Surprised", "fear": "Scared", "disgust": "Angry", "neutral": "Neutral", "others": "Neutral"}
POLICIES = {"auto": "passthrough", "lecture": "neutral_only", "interview": "neutral_only", "news": "neutral_only", "movie": "passthrough", "drama": "passthrough"}
STYLE = {
    "Sad": "with deep, anguished sadness, slow pacing, restrained voice",
    "Angry": "with sharp, raised, confrontational tone, intense urgency",
    "Happy": "in a bright, energetic tone with lively, exuberant pacing",
    "Surprised": "with sudden, sharp surprise, raised intonation",
    "Scared": "with raw, tense fear, shaky breathy voice",
}
BASE_RATE, TOLERANCE, MIN_STRETCH, MAX_STRETCH = 6.0, 0.15, 0.85, 1.25


def emotion_speed(emotion: Column) -> Column:
    return lookup(EMOTION_SPEED, emotion, 1.0)


def length_speed(source_words: Column, target_length: Column) -> Column:
    return F.greatest(F.lit(0.9), F.least(F.lit(1.3), 0.4 * target_length / F.greatest(source_words, F.lit(1))))


def top_emotion(labels: Column, scores: Column, dur_ms: Column) -> Column:
    """(emotion, score) of the first best label; under 300 ms Neutral and 0."""
    raw = F.element_at(F.split(F.lower(F.element_at(labels, F.array_position(scores, F.array_max(scores)).cast("int"))), "/"), -1)
    short = dur_ms < 300
    return F.struct(F.when(short, "Neutral").otherwise(lookup(LABELS, raw, "Neutral")).alias("emotion"), F.when(short, 0.0).otherwise(F.round(F.array_max(scores), 3)).alias("score"))


def syllable_target(dur_s: Column, emotion: Column) -> Column:
    d, rate = F.greatest(F.lit(0.3), dur_s), BASE_RATE * lookup(TARGET_FACTOR, emotion, 1.0)
    low = F.greatest(F.lit(1), F.floor(d * (rate - 0.5)))
    return F.struct(low.cast("long").alias("low"), F.greatest(low + 1, F.floor(d * (rate + 0.5))).cast("long").alias("high"))


def prompt_line(index: Column, dur_s: Column, emotion: Column, text: Column) -> Column:
    t = syllable_target(dur_s, emotion)
    return F.format_string("[%d] (duration: %.1fs, target: %d~%d syllables) %s", index, F.greatest(F.lit(0.3), dur_s), t["low"], t["high"], text)


def described_line(index: Column, dur_s: Column, emotion: Column, score: Column, speaker: Column, text: Column) -> Column:
    """The line with the recogniser's emotion and the speaker in it."""
    t = syllable_target(dur_s, emotion)
    shown = F.greatest(F.lit(0.3), dur_s)
    return F.format_string("[%d] (duration: %.1fs, target: %d~%d syllables, emotion2vec_hint: %s %.2f, speaker: %s) %s", index, shown, t["low"], t["high"], emotion, F.coalesce(score, F.lit(0.0)), speaker, text)


def effective_rate(lang: Column, emotion: Column, description: Column) -> Column:
    return lookup(SPEECH_RATE, lang, 5.5) * lookup(PREDICT_FACTOR, emotion, 1.0) * desc_rate(description)


def retry_plan(ratio: Column) -> Column:
    return F.when(ratio < 0.8, "slow_0.90").when(ratio < 1.05, "none").when(ratio < 1.4, "fast_1.15").otherwise("stretch_only")


def accept_retry(plan: Column, before_s: Column, after_s: Column, slot_s: Column) -> Column:
    """A slower take must be longer and stay within 1.10 of the slot; a faster one must be shorter."""
    return F.when(plan == "slow_0.90", (after_s > before_s) & (after_s / F.greatest(F.lit(0.1), slot_s) <= 1.1)).when(plan == "fast_1.15", after_s < before_s).otherwise(False)


def stretch_plan(natural_s: Column, target_s: Column, slot_s: Column) -> Column:
    """(action, factor, trimmed): only an overflow beyond the largest stretch is trimmed to its slot."""
    target = F.greatest(F.lit(0.1), target_s)
    ratio, slack = natural_s / target, TOLERANCE / target
    fits, early, fast = (ratio >= 1 - slack) & (ratio <= 1 + slack), ratio < 1 - slack, ratio <= MAX_STRETCH
    action = F.when(fits, "keep").when(early, "lengthen").when(fast, "shorten").otherwise("overflow")
    factor = F.when(fits, 1.0).when(early, F.greatest(F.lit(MIN_STRETCH), ratio)).when(fast, ratio).otherwise(MAX_STRETCH)
    return F.struct(action.alias("action"), factor.alias("factor"), ((action == "overflow") & (natural_s / MAX_STRETCH > slot_s)).alias("trimmed"))


def style_prefix(emotion: Column) -> Column:
    said = F.concat(F.lit("You are a helpful assistant. Please say this sentence "), lookup(STYLE, emotion, ""), F.lit(".<|endofprompt|>"))
    return F.when(emotion.isin(list(STYLE)), said).otherwise("You are a helpful assistant.<|endofprompt|>")


def clip_score(score: Column) -> Column:
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), score)), 2)


def diagnose(score: Column) -> Column:
    return F.when(score >= 4.0, "excellent").when(score >= 3.5, "pass").when(score >= 3.0, "adjust_speed").when(score >= 2.0, "replace_reference").otherwise("restructure")
