"""Copies, repeated ids and rows without an id in the operators of the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from timeweave.llm import decontaminate, line_dedup, set_join, substrings
from timeweave.llm.common import staged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def text(seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


def test_an_id_with_several_texts_is_one_vertex(spark):
    a, b, c = text(1), text(2), text(3)
    got = set_join.near_texts(table(spark, [(3, a), (5, a), (5, b), (7, b), (9, c), (11, c + " tail"), (5, c)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, 3) for k in (3, 5, 7, 9, 11)}


def test_representatives_by_row(spark):
    a, b = text(1), text(2)
    rows = [(4, a), (6, a), (None, a), (None, b), (None, b), (None, text(4)), (None, None), (None, " "), (None, " "), (8, None), (2, b + " x"), (2, text(5))]
    kept = set_join.keep_representatives(table(spark, rows), n=5, num=80, den=100)
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(4, a), (None, text(4)), (None, None), (None, " "), (None, " "), (8, None), (2, b + " x"), (2, text(5))], key=str)
    alone = set_join.keep_representatives(table(spark, [(None, b), (None, b)]), n=5, num=80, den=100)
    assert [r["text"] for r in alone.collect()] == [b]


def test_contaminated_rows_go_by_row(spark):
    items = spark.createDataFrame([("i1", text(9, 14))], "item_id string, text string")
    bad, good = text(1) + " " + text(9, 14), text(2)
    rows = [(None, bad), (None, good), (5, bad), (5, good), (6, None), (7, "")]
    kept = decontaminate.keep_uncontaminated(table(spark, rows), items)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, good), (5, good), (6, None), (7, "")], key=str)


def test_lines_of_repeated_ids_count_by_row(spark, duck):
    rows = [(1, "same line\nown a", "en", "h", 1), (1, "same line\nown b", "en", "h", 1), (1, "same line\nown c", "en", "h", 1), (2, "other", "en", "h", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(tuple(r) for r in line_dedup.strip_boilerplate(df.select("doc_id", "source", "text")).collect())
    con = duck.cursor()
    con.execute("CREATE OR REPLACE TEMP TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', 'h')" for i, t, *_ in rows) + ") v(doc_id, text, source)")
    want = sorted(con.execute(f"SELECT doc_id, source, text, line_total, line_dropped FROM ({line_dedup.ORACLE_SQL.replace('documents', 'temp.documents')})").fetchall())
    assert got == want and [r[2] for r in got] == ["own a", "own b", "own c", "other"]


@pytest.mark.parametrize("same_id", [False, True])
def test_copies_of_a_text_have_one_row_of_suffixes(spark, same_id):
    """Many copies of one page: suffixes of one, buckets no larger than of one, results as of each."""
    page = text(1, 300)
    ids = spark.range(3000).select((F.lit(5) if same_id else F.col("id")).cast("long").alias("doc_id"))
    docs = ids.withColumn("text", F.lit(page)).unionByName(table(spark, [(90_000, "x" * 30 + page[:700])]).select("doc_id", "text"))
    base = docs.select("text", F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("s"), F.col("doc_id").alias("number"))
    copies = staged(base.groupBy("t", "s").agg(F.count("*").alias("copies"), F.min("number").alias("rep"), F.count_if(F.lit(same_id)).alias("rows")).withColumn("rows", F.greatest("rows", F.lit(1))), "copies")
    assert substrings._one_each(base, copies).count() == 2
    got = substrings.remove_repeats(docs, length=200).select("doc_id", "n_bytes", "n_removed").distinct().collect()
    assert {r["doc_id"]: r["n_removed"] for r in got}[90_000] == 700
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] != 90_000)
