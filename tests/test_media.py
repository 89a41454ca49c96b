"""Sample blocks, media files, table functions, recursive labels, reference bands and stage times."""

import math

import pytest
from pyspark.sql import functions as F

from timeweave.functions import blocks, tables
from timeweave.operators import refine, speakers
from timeweave.plans.media import stage_times
from timeweave.sources import files


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_blocks_hold_every_sample(spark):
    have = [(1, i, i / 10) for i in range(10)] + [(1, 23, 2.5), (2, 4, -1.0), (2, 5, 1.0)]
    made = blocks.to_blocks(spark.createDataFrame(have, "clip_id long, idx long, value double"), 10)
    assert rows(made.select("clip_id", "block", F.size("samples"))) == [(1, 0, 10), (1, 2, 10), (2, 0, 10)]
    assert rows(blocks.to_samples(made, "samples", length=10)) == sorted(have, key=str)
    x = {(r["clip_id"], r["block"]): r for r in made.select("clip_id", "block", blocks.rms(F.col("samples")).alias("rms"), blocks.peak(F.col("samples")).alias("peak"), F.size(blocks.known(F.col("samples"))).alias("n")).collect()}
    assert x[2, 0]["rms"] == 1 and x[2, 0]["peak"] == 1 and x[2, 0]["n"] == 2
    assert x[1, 0]["rms"] == pytest.approx(math.sqrt(sum((i / 10) ** 2 for i in range(10)) / 10))


def test_blocks_keep_one_sample_a_place(spark):
    made = blocks.to_blocks(spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 2, 2.0)], "clip_id long, idx long, value double"), 4)
    assert made.first()["samples"] == [3.0, None, 2.0, None]
    assert blocks.to_blocks(spark.createDataFrame([], "clip_id long, idx long, value double"), 4).collect() == []


def test_mixes_and_pieces(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 4.0], [1.0, 1.0, 1.0, None])], "a array<double>, b array<double>")
    diff = blocks.mixed(F.col("a"), F.col("b"), 1.0, -1.0)
    (row,) = df.select(diff.alias("d"), F.transform(blocks.pieces(diff, 4, 2), blocks.mean_square).alias("m")).collect()
    assert row["d"] == [0.0, None, 2.0, None] and row["m"] == [0.0, 4.0]
    assert df.select(blocks.signal_to_noise(F.lit(0.0))).first()[0] == float("inf")
    assert df.select(blocks.mean_square(F.array(F.lit(None).cast("double")))).first()[0] is None


def test_media_of_metadata(spark):
    meta = spark.createDataFrame([("v1.mp4",), ("v2.mp4",), ("v3.mp4",)], "video string")
    media = spark.createDataFrame([("/b/v1.mp4", "v1.mp4", 5), ("/a/v1.mp4", "v1.mp4", 4), ("/a/v2.mp4", "v2.mp4", 9)], "path string, name string, length long")
    made = spark.createDataFrame([("v1.mp4", 1024), ("v2.avi", 1025)], "name string, length long")
    pairs = files.with_media(meta, media)
    assert rows(pairs) == [("v1.mp4", "/a/v1.mp4", 4), ("v2.mp4", "/a/v2.mp4", 9)]
    assert rows(files.pending(pairs, made)) == [("v1.mp4", "/a/v1.mp4", 4)]


def test_files_are_dealt_by_their_number(spark, tmp_path):
    """Small files have few bytes and much work: tasks and folders grow with their number."""
    n, root = 2 * files.FILES_A_TASK + 1, str(tmp_path / "many")
    files.write_texts(spark.range(n).select(F.concat(F.lit("f"), "id").alias("name"), F.concat(F.lit("é"), "id").alias("content")), root, ".txt", folders=True)
    assert len(list((tmp_path / "many").iterdir())) == 3
    (tmp_path / "many" / "_hidden").mkdir()
    (tmp_path / "many" / "_hidden" / "f1.txt").write_text("x")
    (tmp_path / "many" / "k=1").mkdir()
    (tmp_path / "many" / "k=1" / "g.json").write_text("xyz")
    found = files.media_inventory(spark, root, "*.txt")
    assert found.rdd.getNumPartitions() == 3 and files.content_hash(found).distinct().count() == n
    assert sorted(r["name"] for r in found.where("length = 4").collect()) == [f"f{i}.txt" for i in range(10, 100)]
    assert sorted(map(tuple, files.media_inventory(spark, root, "*.{json,xml}").select("name", "length").collect())) == [("g.json", 3)]


def test_log_tails_are_counted_in_characters(spark, tmp_path):
    (tmp_path / "a.log").write_text("é" * 50 + "\r" + "😀" * 30 + "\nend")
    got = files.read_train_log(spark, str(tmp_path), 10).collect()
    assert [(r["log"], r["line"]) for r in got] == [("a", "😀" * 6), ("a", "end")]


def test_metadata_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Video_env": {"Angle": 7}}')
    meta = files.read_clip_metadata(spark, str(tmp_path))
    assert [tuple(r) for r in meta.collect()] == [("a.json", "7", None, "a.mp4")]
    plan = meta._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert plan.count("parsejson") == 1, plan


ANSWER = "intro\n[1] first\ngoes on\n\n2. second\n(1) again\n[3]\n[4] "
FIELDS = "Korean: none yet\n[1] text first\nEmotion: sad\nstill sad\n\nlost\n[2]\ntone： soft\n[2]\nTone: hard\n[5]\n\n[6] not an entry"


@pytest.mark.parametrize(("name", "native", "answer"), [("parse_numbered", refine.parse_numbered, ANSWER), ("parse_fields", refine.parse_fields, FIELDS)])
def test_table_functions_are_the_column_functions(spark, name, native, answer):
    responses = spark.createDataFrame([(1, answer), (2, ""), (3, "[9] x"), (4, None)], "batch_id long, response string")
    tables.register(spark)
    got = spark.sql(f"SELECT * FROM {name}(TABLE({{lines}}) PARTITION BY batch_id ORDER BY line_no)", lines=refine.numbered_lines(responses))
    want = native(responses)
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 0


def test_table_functions_name_what_is_missing(spark):
    tables.register(spark)
    with pytest.raises(Exception, match="needs a column line_no"):
        spark.sql("SELECT * FROM parse_numbered(TABLE(SELECT 1L AS batch_id, 'x' AS line))").collect()


def test_labels_in_sql(spark):
    n = 12
    labels = spark.createDataFrame([(c, f"S{k:02d}") for c in (1, 2) for k in range(n)], "chunk_id long, speaker string")
    pairs = spark.createDataFrame([(1, f"S{k:02d}", f"S{k + 1:02d}") for k in range(n - 1)], "chunk_id long, a string, b string")
    assert rows(speakers.canonical_labels_in_sql(labels, pairs)) == rows(speakers.canonical_labels(labels, pairs))
    with pytest.raises(Exception, match="chain of speakers is longer than 3"):
        speakers.canonical_labels_in_sql(labels, pairs, 3).collect()


def test_reference_band(spark):
    df = spark.createDataFrame([(1, 0, 900), (1, 0, 3000), (1, 0, 15001), (2, 0, 900), (2, 0, 1000), (2, 0, 25000), (2, 0, 25001)], "chunk_id long, start_ms long, end_ms long")
    assert rows(speakers.reference_band(df).select("chunk_id", "end_ms")) == [(1, 3000), (2, 1000), (2, 25000)]


def test_stage_times(spark):
    timings = spark.createDataFrame([(1, "read", 10.0), (1, "read", 20.0), (1, "write", 10.0), (2, "read", 5.0)], "chunk_id long, stage string, ms double")
    frames = spark.createDataFrame([(1, 10)], "chunk_id long, n_frames long")
    assert rows(stage_times(timings, frames, ["chunk_id"])) == [(1, "read", 2, 30.0, 0.75, 3.0), (1, "write", 1, 10.0, 0.25, 1.0), (2, "read", 1, 5.0, 1.0, 5.0)]
