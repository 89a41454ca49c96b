"""Benchmark decontamination as a prefix-filtered exact containment join; DataFrame operations only.

An item's windows are its runs of `size` words (the whole item where it is shorter). A window occurs only where all
its words do, so one word of it, the rarest in the corpus, is a sufficient prefix. Document words are matched with
those prefix words; the window's start and end must then fall inside the document (positional and length bounds),
and the words at that place must equal the window's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import lower_ascii, staged

# The word characters are digits, letters and everything outside ASCII.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str):
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_BREAK), "")


def windows_of(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: window (words joined by a blank), len, items (ids as strings). Items without id are left out."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.transform(words_of(text_col), lower_ascii).alias("w"))
    length = F.least(F.size("w"), F.lit(size))
    starts = words.where(F.size("w") > 0).select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("s"))
    return starts.groupBy(F.array_join(F.slice("w", F.col("s"), F.col("len")), " ").alias("window"), "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _guarded(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def occurrences(docs: DataFrame, windows: DataFrame, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first, last, items) for every place where a window occurs, positions in words from 0.

    The tables of benchmark words and windows are broadcast only while they have at most `broadcast_rows` rows; beyond
    that the joins shuffle, one small row a word.
    """
    windows = staged(windows, "windows")
    n_windows = windows.count()
    parts = windows.select("window", "len", "items", F.posexplode(F.split("window", " ")).alias("at", "word")).withColumn("key", F.lower("word"))
    vocabulary = parts.select("key").distinct()
    tokens = docs.select(F.explode(words_of(text_col)).alias("word")).select(F.lower("word").alias("key"))
    counts = staged(tokens.join(_guarded(vocabulary, n_windows, broadcast_rows // 10), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")), "word-counts")
    rarest = parts.join(counts, "key", "left").groupBy("window", "len", "items").agg(
        F.min_by(F.struct("key", "at"), F.struct(F.coalesce("n", F.lit(0)), "key", "at")).alias("p"), F.min(F.coalesce("n", F.lit(0))).alias("n")
    )
    prefixes = staged(rarest.where("n > 0").select(F.col("p.key").alias("key"), F.col("p.at").alias("at"), "window", "len", "items"), "prefixes")
    words = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("w"))
    if n_windows <= broadcast_rows:
        placed = words.select("id", "w", F.posexplode("w").alias("pos", "word"))
        found = placed.withColumn("key", F.lower("word")).join(F.broadcast(prefixes), "key")
    else:
        # Only places travel to the prefixes; candidates then meet their document's words again.
        placed = words.select("id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).select("id", "n", "pos", F.lower("word").alias("key"))
        met = placed.join(prefixes, "key").where((F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("len") <= F.col("n")))
        again = staged(met.select(F.col("id").alias("__id"), "pos", "at", "window", "len", "items").distinct(), "candidates")
        found = words.join(again, F.col("id").eqNullSafe(F.col("__id")))
    first = F.col("pos") - F.col("at")
    inside = found.where((first >= 0) & (first + F.col("len") <= F.size("w")))
    same = inside.where(lower_ascii(F.array_join(F.slice("w", first + 1, F.col("len")), " ")) == F.col("window"))
    return same.select("id", first.alias("first"), (first + F.col("len") - 1).alias("last"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """One row per document id: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and stay uncontaminated. Rows that share an id (or have none) are taken as one
    document: its words are counted once per row and its hits united by place. Items without words or id are ignored.
    Extra columns are not read. An empty table of documents gives no rows, an empty benchmark no hits.
    """
    hits = occurrences(docs, windows_of(items, size, item_id, item_text), broadcast_rows, id_col, text_col)
    base = docs.select(F.col(id_col).alias("id"), F.size(words_of(text_col)).cast("long").alias("n"))
    none = F.lit(None)
    rows = base.select("id", "n", none.cast("struct<first:int,last:int>").alias("span"), none.cast("array<string>").alias("items")).unionByName(
        hits.select("id", F.lit(0).cast("long").alias("n"), F.struct("first", "last").alias("span"), "items")
    )
    seen = rows.groupBy("id").agg(F.sum("n").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a["end"]) + 1)).alias("n"), F.greatest(a["end"], s["last"] + 1).alias("end"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"].cast("long"))
    return seen.select(
        F.col("id").alias("doc_id"), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs. Rows are judged by their text, so rows
    without an id and rows that share one are too; null and empty texts stay, an empty table stays empty. Digests of
    texts that go (16 bytes) are broadcast up to `broadcast_rows` of them, beyond that the join shuffles."""
    keyed = docs.withColumn("__text", F.unhex(F.md5(text_col)))
    hits = occurrences(keyed.select("__text", F.col(text_col).alias("text")), windows_of(items, size), id_col="__text", text_col="text")
    gone = staged(hits.select(F.col("id").alias("__text")).distinct(), "contaminated")
    return keyed.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, "__text", "left_anti").drop("__text")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS l FROM i WHERE len(w) > 0),
win AS (SELECT item_id, l, w[s + 1 : s + l] AS x FROM (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM il)),
dp AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d),
dw AS (SELECT doc_id, p, l, w[p + 1 : p + l] AS x FROM dp, (SELECT DISTINCT l FROM win) WHERE p + l <= len(w)),
hit AS (SELECT dw.doc_id, dw.p, dw.l, win.item_id FROM dw JOIN win ON dw.l = win.l AND dw.x = win.x),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
