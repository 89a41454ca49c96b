"""Interval and nearest joins.

A raw range condition makes Spark compare every pair of a chunk. Here both sides are cut into buckets of time, joined
on (chunk, bucket), and a pair is kept only in the bucket where its overlap begins, so it appears once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_MS = 5000


def range_join(left: DataFrame, right: DataFrame, key: str = "chunk_id", bucket_ms: int = BUCKET_MS, how_start: str = "start_ms", how_end: str = "end_ms") -> DataFrame:
    """Pairs whose closed intervals meet. Columns of each side come as structs l and r."""
    cut = lambda df, name: df.select(F.col(key).alias("k"), F.explode(F.sequence(F.floor(F.col(how_start) / bucket_ms), F.floor(F.greatest(how_start, how_end) / bucket_ms))).alias("b"), F.struct(*df.columns).alias(name))
    both = cut(left, "l").join(cut(right, "r"), ["k", "b"])
    ls, le, rs, re = (F.col(f"{s}.{c}") for s in "lr" for c in (how_start, how_end))
    return both.where((ls <= re) & (rs <= le) & (F.col("b") == F.floor(F.greatest(ls, rs) / bucket_ms))).select("l", "r")


def _both_ways(time: str):
    """Frames of a chunk's rows up to each row's time, and, running backwards, from it on; rows of one time see each other."""
    return tuple(W.partitionBy("chunk_id").orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.asc(time), F.desc(time)))


def speaker_at(points: DataFrame, turns: DataFrame, fallback: str = "nearest") -> DataFrame:
    """Speaker of each (chunk_id, point_idx, t_ms): the first turn that holds it; else the nearest, the earliest on a tie.

    A point that no turn holds lies after the ends of some turns and before the starts of the others: the nearest is
    the one whose end was the last before it or whose start is the next after it, found by sorting points and turn
    ends together. A chunk without turns gives SPEAKER_00; with fallback="unk" every miss gives SPEAKER_UNK. Points are
    read once: a point lies in one bucket, so a left join keeps those that no turn holds, and they go on with the others.
    (chunk_id, point_idx) is a key of the points.
    """
    t = turns.select("chunk_id", "turn_idx", "speaker", "start_ms", "end_ms")
    first, last = F.floor(F.col("start_ms") / BUCKET_MS), F.floor(F.greatest("start_ms", "end_ms") / BUCKET_MS)
    cut = t.select(
        F.col("chunk_id").alias("k"), F.explode(F.sequence(first, last)).alias("b"),
        F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("turn_idx").alias("i"), F.col("speaker").alias("by"),
    )
    holds = (F.col("chunk_id") == F.col("k")) & (F.floor(F.col("t_ms") / BUCKET_MS) == F.col("b")) & F.col("t_ms").between(F.col("s"), F.col("e"))
    told = points.select("chunk_id", "point_idx", "t_ms").join(cut, holds, "left").groupBy("chunk_id", "point_idx", "t_ms").agg(F.min_by("by", "i").alias("held"))
    if fallback == "unk":
        return told.select("chunk_id", "point_idx", F.coalesce("held", F.lit("SPEAKER_UNK")).alias("speaker"))

    def mark(time: str, side: str) -> DataFrame:
        at = t.groupBy("chunk_id", F.col(time).alias("t_ms")).agg(F.min(F.struct("turn_idx", "speaker")).alias("turn"))
        place = lambda name: F.when(F.lit(side == name), F.struct("t_ms", "turn")).alias(name)
        return at.select("chunk_id", "t_ms", F.lit(None).cast("long").alias("point_idx"), F.lit(None).cast("string").alias("held"), place("left"), place("right"))

    marks = mark("end_ms", "left").unionByName(mark("start_ms", "right"))
    none = F.lit(None).cast(marks.schema["left"].dataType)
    asked = told.select("chunk_id", "t_ms", "point_idx", "held", none.alias("left"), none.alias("right"))
    w, back = _both_ways("t_ms")
    x = marks.unionByName(asked).withColumn("before", F.last("left", ignorenulls=True).over(w))
    x = x.withColumn("after", F.last("right", ignorenulls=True).over(back)).where("point_idx IS NOT NULL")
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.t_ms") - F.col("t_ms")).alias("d"), F.col(f"{side}.turn").alias("turn")))
    best = F.least(F.coalesce(far("before"), far("after")), F.coalesce(far("after"), far("before")))
    return x.select("chunk_id", "point_idx", F.coalesce("held", best["turn"]["speaker"], F.lit("SPEAKER_00")).alias("speaker"))


def contained(inner: DataFrame, outer: DataFrame, slack_ms: int = 0) -> DataFrame:
    """Pairs (l, r) where l lies inside r, within slack_ms at both ends."""
    wide = outer.withColumn("start_ms", F.col("start_ms") - slack_ms).withColumn("end_ms", F.col("end_ms") + slack_ms)
    return range_join(inner, wide).where("l.start_ms >= r.start_ms AND l.end_ms <= r.end_ms")


def overlap_majority(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Speaker with the longest summed overlap per segment; the smaller label on a tie."""
    shared = F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")
    summed = range_join(segments, turns).where(shared > 0).groupBy(F.col("l.chunk_id").alias("chunk_id"), F.col("l.segment_id").alias("segment_id"), F.col("r.speaker").alias("speaker")).agg(F.sum(shared).alias("overlap_ms"))
    return summed.groupBy("chunk_id", "segment_id").agg(F.min_by(F.struct("speaker", "overlap_ms"), F.struct(-F.col("overlap_ms"), "speaker")).alias("m")).select("chunk_id", "segment_id", "m.*")


def uncovered(speech: DataFrame, segments: DataFrame, min_frac: float = 0.5) -> DataFrame:
    """Speech intervals of which no single segment covers more than min_frac."""
    shared = F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")
    covered = range_join(speech, segments).where(shared > min_frac * (F.col("l.end_ms") - F.col("l.start_ms"))).select(F.col("l.chunk_id").alias("chunk_id"), F.col("l.speech_idx").alias("speech_idx")).distinct()
    return speech.join(covered, ["chunk_id", "speech_idx"], "left_anti")


def rasterise(turns: DataFrame, fps: int, chunks: DataFrame | None = None) -> DataFrame:
    """Frames that turns cover, with the speaker of the last listed turn. With chunks (chunk_id, n_frames), every frame of
    each chunk and no other: silent ones have a null speaker."""
    frames = F.sequence(F.floor(F.col("start_ms") * fps / 1000), F.floor(F.col("end_ms") * fps / 1000))
    said = turns.select("chunk_id", "turn_idx", "speaker", F.explode(frames).alias("frame")).groupBy("chunk_id", "frame").agg(F.max_by("speaker", "turn_idx").alias("speaker"))
    return said if chunks is None else frame_spine(chunks).join(said, ["chunk_id", "frame"], "left")


def frame_spine(chunks: DataFrame) -> DataFrame:
    """(chunk_id, frame): every frame of chunks (chunk_id, n_frames)."""
    return chunks.where("n_frames > 0").select("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))


def snap(points: DataFrame, words: DataFrame, parts: int = 0) -> DataFrame:
    """Closest word boundary of each point, the first on a tie; itself in a chunk without words.

    Points and boundaries are sorted together: the closest boundary is the last one before the point or the next one
    after it, so no point meets all boundaries of its chunk. `parts` is the number of partitions they are sorted in, the
    session's where it is 0.
    """
    edge = F.explode(F.array(F.struct((F.col("word_idx") * 2).alias("i"), F.col("start_ms").alias("at")), F.struct((F.col("word_idx") * 2 + 1).alias("i"), F.col("end_ms").alias("at"))))
    edges = words.select("chunk_id", edge.alias("e")).groupBy("chunk_id", F.col("e.at").alias("t_ms")).agg(F.min("e.i").alias("i"))
    both = edges.select("chunk_id", "t_ms", F.lit(None).cast("long").alias("point_idx"), F.struct(F.col("t_ms").alias("at"), "i").alias("e"))
    both = both.unionByName(points.select("chunk_id", "t_ms", "point_idx", F.lit(None).cast("struct<at:bigint,i:bigint>").alias("e")))
    if parts:
        both = both.repartition(parts, "chunk_id")
    w, back = _both_ways("t_ms")
    x = both.withColumn("left", F.last("e", ignorenulls=True).over(w)).withColumn("right", F.last("e", ignorenulls=True).over(back))
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.at") - F.col("t_ms")).alias("d"), F.col(f"{side}.i").alias("i"), F.col(f"{side}.at").alias("at")))
    best = F.least(F.coalesce(far("left"), far("right")), F.coalesce(far("right"), far("left")))
    return x.where("point_idx IS NOT NULL").select("chunk_id", "point_idx", F.coalesce(best["at"], F.col("t_ms")).alias("t_ms"))


def nearest_label(rows: DataFrame, labelled: DataFrame, at: str, order: str) -> DataFrame:
    """rows with the label of the labelled row (chunk_id, `order`, `at`, speaker) closest in `at`, the smaller `order` on a
    tie; chunks without a labelled row are left out. Found among the last one before and the next one after."""
    known = labelled.groupBy("chunk_id", at).agg(F.min_by(F.struct(F.col(order).alias("i"), "speaker"), order).alias("e"))
    known = known.select("chunk_id", at, F.struct(F.col(at).alias("at"), F.col("e.i").alias("i"), F.col("e.speaker").alias("speaker")).alias("e"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("r"))
    asked = rows.select("chunk_id", at, F.lit(None).cast(known.schema["e"].dataType).alias("e"), F.struct(*rows.columns).alias("r"))
    w, back = _both_ways(at)
    x = known.unionByName(asked).withColumn("left", F.last("e", ignorenulls=True).over(w))
    x = x.withColumn("right", F.last("e", ignorenulls=True).over(back)).where("r IS NOT NULL")
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.at") - F.col(at)).alias("d"), F.col(f"{side}.i").alias("i"), F.col(f"{side}.speaker").alias("label")))
    best = F.least(F.coalesce(far("left"), far("right")), F.coalesce(far("right"), far("left")))
    return x.withColumn("label", best["label"]).where("label IS NOT NULL").select("r.*", "label")
