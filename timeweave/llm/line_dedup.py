"""Site-relative line frequency: lines on more than a given share of a host's pages are boilerplate; DataFrame only.

A page counts once for each different line on it. Counts are summed per task before the shuffle, so a hot host or
line moves one row a task. A host can have at most (lines a page / ratio) boilerplate lines, so they fit in one array
per host; that table is written, and Spark broadcasts it only if its file size allows, else it joins by host with
skewed hosts split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import staged


def _key(line):
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, host_col: str, text_col: str) -> DataFrame:
    """(host, keys): each host's boilerplate lines."""
    sited = pages.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("host"), F.col(text_col).alias("t"))
    totals = sited.groupBy("host").agg(F.count("*").alias("pages"))
    lines = sited.select("host", F.explode(F.array_distinct(F.split("t", "\n", -1))).alias("line")).where(F.trim("line") != "")
    counts = lines.select("host", _key(F.col("line")).alias("k")).groupBy("host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, "host").where(F.col("n") / F.col("pages") > ratio)
    return staged(common.groupBy("host").agg(F.collect_set("k").alias("keys")), "boilerplate")


def strip_boilerplate(pages: DataFrame, ratio: float = 0.01, min_pages: int = 3, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows and columns of `pages` with boilerplate lines taken out of the text, plus line_total and line_dropped.

    Lines end at a newline; what is left is joined by newlines again. Lines of blanks only are neither counted nor
    dropped; lines are told apart by 96 bits of two hashes. A line on fewer than `min_pages` pages of a host is kept: on a host of few pages every line exceeds a small
    ratio, so without it a host of one or two pages would lose all its text.
    Null hosts form no site: their pages stay as they are. Null texts stay null with no lines; empty texts have one
    blank line. Repeated rows count as pages of their own. Columns of `pages` are kept whatever their names are, but
    for line_total and line_dropped, which are replaced. Very long texts are split whole. Empty tables stay empty.
    """
    rare = boilerplate(pages, ratio, min_pages, host_col, text_col).select(F.col("host").alias("__host"), F.col("keys").alias("__keys"))
    names = [c for c in pages.columns if c not in ("line_total", "line_dropped")]
    own = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(names)])
    host, text = f"c{names.index(host_col)}", f"c{names.index(text_col)}"
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col("__keys").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__keys", _key(x))))
    joined = own.join(rare, F.col(host) == F.col("__host"), "left").withColumn("__kept", kept)
    total, left = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)), F.coalesce(F.size("__kept"), F.lit(0))
    none = F.col(text).isNull()
    return joined.select(
        *[(F.array_join("__kept", "\n") if f"c{i}" == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)],
        F.when(none, 0).otherwise(total).cast("long").alias("line_total"), F.when(none, 0).otherwise(total - left).cast("long").alias("line_dropped"),
    )


ORACLE_SQL = """
WITH r AS (SELECT *, row_number() OVER () AS row FROM documents),
l AS (SELECT row, source, unnest(string_split(text, chr(10))) AS line FROM r WHERE text IS NOT NULL),
p AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
b AS (
  SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT row) AS n FROM l WHERE trim(line) <> '' GROUP BY source, line) c
  JOIN p USING (source) WHERE c.n >= 3 AND c.n / p.pages > CAST(0.01 AS DOUBLE)),
h AS (SELECT source, list(line) AS lines FROM b GROUP BY source),
k AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS a, list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(h.lines, []), x)) AS kept
  FROM documents d LEFT JOIN h USING (source))
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(a), 0) AS BIGINT) AS line_total, CAST(coalesce(len(a) - len(kept), 0) AS BIGINT) AS line_dropped FROM k
"""
