"""Levels, faces, quality, planning tables and set operations over the derived tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timeweave.functions import blocks, planning, text, vectors
from timeweave.operators import joins, refine, sequences, speakers
from timeweave.operators.lineage import staged
from timeweave.operators.refine import NUMBERED_LINE
from timeweave.plans import timelines
from timeweave.plans.scalars import BAND, KIND
from timeweave.plans.timelines import COLLAPSE, COUNTS, RASTER, SPINE, face_counts
from timeweave.sources import timeline as T

QUERIES, ORACLE_SQL = {}, {}
col, wt = F.col, T.with_tables


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def boxes(s, d):
    """Detected boxes: the face boxes, moved a little."""
    return T.face_frames(s, d).select("chunk_id", "frame", col("track").alias("face"), (col("x1") + 9).alias("x1"), (col("y1") + 7).alias("y1"), (col("x2") + 9).alias("x2"), (col("y2") + 7).alias("y2"))


def match_faces(s, d):
    f = T.face_frames(s, d).where("score > -2")
    present = f.select("chunk_id").distinct().withColumn("known", F.lit(True))
    side = lambda p: [col(f"{p}.{c}") for c in ("x1", "y1", "x2", "y2")]
    b = boxes(s, d)
    scored = b.alias("a").join(f.alias("b"), ["chunk_id", "frame"]).select("chunk_id", "frame", "face", vectors.iou(side("a"), side("b")).alias("iou"), "b.track", "b.score")
    best = scored.groupBy("chunk_id", "frame", "face").agg(F.max("iou").alias("iou"), F.max_by("score", F.struct("iou", -col("track"))).alias("score"))
    out = b.select("chunk_id", "frame", "face").join(best, ["chunk_id", "frame", "face"], "left").join(present, "chunk_id", "left")
    return out.select("chunk_id", "frame", "face", F.when(col("known").isNull(), F.lit(None)).when(col("iou").isNull() | (col("iou") < 0.2), False).otherwise(col("score") >= 0).cast("boolean").alias("speaking"))


IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
add("c10_match_faces", match_faces, wt("face_frames", f"""+bx AS (SELECT chunk_id, frame, track AS face, x1 + 9 AS x1, y1 + 7 AS y1, x2 + 9 AS x2, y2 + 7 AS y2 FROM face_frames), f AS (SELECT * FROM face_frames WHERE score > -2),
  sc AS (SELECT a.chunk_id, a.frame, a.face, b.track, b.score, {IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {IOU}) AS iou FROM bx a JOIN f b USING (chunk_id, frame)),
  bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY chunk_id, frame, face ORDER BY iou DESC, track) = 1)
  SELECT bx.chunk_id, bx.frame, bx.face, CASE WHEN bx.chunk_id NOT IN (SELECT chunk_id FROM f) THEN NULL WHEN bs.iou IS NULL OR bs.iou < 0.2 THEN false ELSE bs.score >= 0 END AS speaking FROM bx LEFT JOIN bs USING (chunk_id, frame, face)"""))


def chunk_frames(s, d):
    """Frames of each chunk on its video's own timeline: a video takes every tenth chunk."""
    c = T.face_frames(s, d).groupBy("chunk_id").agg((F.max("frame") + 1).alias("n_frames")).withColumn("video", col("chunk_id") % 10)
    before = W.partitionBy("video").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, -1)
    return c.withColumn("first", F.coalesce(F.sum("n_frames").over(before), F.lit(0)))


def locate(s, d):
    """C11: chunk and frame of each ninth frame of a video; frames and chunks meet by range in buckets."""
    at = T.samples(s, d).select(col("clip_id").alias("video"), col("idx").alias("g"), (col("idx") * 9).alias("start_ms"), (col("idx") * 9).alias("end_ms"))
    span = chunk_frames(s, d).select("video", "chunk_id", col("first").alias("start_ms"), (col("first") + col("n_frames") - 1).alias("end_ms"))
    return joins.range_join(at, span, "video", 1000).select("l.video", "l.g", "r.chunk_id", (col("l.start_ms") - col("r.start_ms")).alias("frame"))


CHUNKS = """ch AS (SELECT chunk_id, n_frames, chunk_id % 10 AS video, CAST(coalesce(sum(n_frames) OVER (PARTITION BY chunk_id % 10 ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM (SELECT chunk_id, max(frame) + 1 AS n_frames FROM face_frames GROUP BY 1))"""
add("c11_locate_chunk", locate, wt("face_frames samples", f"+{CHUNKS} SELECT video, idx AS g, chunk_id, idx * 9 - first AS frame FROM samples JOIN ch ON clip_id = video AND idx * 9 >= first AND idx * 9 < first + n_frames"))
def sample_blocks(s, d):
    """Samples as they are stored: a hundred to a block."""
    return staged(blocks.to_blocks(T.samples(s, d)), "sample-blocks")


def clips(s, d):
    """Each clip's samples beside those of the next clip, the last beside the first's."""
    x = T.samples(s, d)
    return x.select(col("clip_id").alias("clip"), "idx", col("value").alias("a")), x.select(((col("clip_id") + 9) % 10).alias("clip"), "idx", col("value").alias("b"))


def clip_blocks(s, d):
    """(clip, block, a, b): blocks of each clip and of the next one."""
    x = sample_blocks(s, d)
    return x.select(col("clip_id").alias("clip"), "block", col("samples").alias("a")).join(x.select(((col("clip_id") + 9) % 10).alias("clip"), "block", col("samples").alias("b")), ["clip", "block"])


def mixes(s, d):
    """Difference and mix of each clip and the next one."""
    made = clip_blocks(s, d).select("clip", "block", blocks.mixed(col("a"), col("b"), 1.0, -1.0).alias("difference"), blocks.mixed(col("a"), col("b"), 0.8, 0.3).alias("mix"))
    return blocks.to_samples(made, "difference", "mix", clip="clip").withColumns({c: F.round(c, 6) for c in ("difference", "mix")})


CLIPS = "+a AS (SELECT clip_id AS clip, idx, value AS a FROM samples), b AS (SELECT (clip_id + 9) % 10 AS clip, idx, value AS b FROM samples)"
add("c14_c15_mix_samples", mixes, wt("samples", CLIPS + " SELECT clip, idx, round(a - b, 6) AS difference, round(CAST(0.8 AS DOUBLE) * a + CAST(0.3 AS DOUBLE) * b, 6) AS mix FROM a JOIN b USING (clip, idx)"))


def masked(s, d):
    x = T.samples(s, d).select(col("clip_id").alias("chunk_id"), "idx", "value", (col("idx") * 10).alias("start_ms"), (col("idx") * 10).alias("end_ms"))
    inside = joins.range_join(x, T.speech(s, d)).select(col("l.chunk_id").alias("chunk_id"), col("l.idx").alias("idx")).distinct().withColumn("in", F.lit(True))
    return x.join(inside, ["chunk_id", "idx"], "left").select("chunk_id", "idx", F.when(col("in"), col("value")).otherwise(0.0).alias("value"))


add("c16_mask_outside", masked, wt("samples speech", "SELECT clip_id AS chunk_id, idx, CASE WHEN EXISTS (SELECT 1 FROM speech p WHERE p.chunk_id = s.clip_id AND s.idx * 10 BETWEEN p.start_ms AND p.end_ms) THEN CAST(value AS DOUBLE) ELSE 0 END AS value FROM samples s"))


def scored(s, d):
    """Segments; every third chunk was never scored."""
    return T.segments(s, d).withColumn("tts_mos", F.when(col("chunk_id") % 3 != 0, col("tts_mos")))


def best_references(s, d):
    """F1: per chunk, speaker and emotion the best scored segment of the allowed lengths, without scores the longest; the first
    on a tie."""
    dur = col("end_ms") - col("start_ms")
    first = F.struct("tts_mos", F.when(col("tts_mos").isNull(), dur), -col("segment_id"))
    return speakers.reference_band(scored(s, d)).groupBy("chunk_id", "speaker", "emotion").agg(F.max_by(F.struct("segment_id", F.least(dur, F.lit(15000)).alias("clip_ms")), first).alias("r")).select("chunk_id", "speaker", "emotion", "r.*")


BEST = BAND.removeprefix("+") + """, bref AS (SELECT chunk_id, speaker, emotion, segment_id, least(dur, 15000) AS clip_ms FROM band
  QUALIFY row_number() OVER (PARTITION BY chunk_id, speaker, emotion ORDER BY CASE WHEN chunk_id % 3 <> 0 THEN tts_mos ELSE dur END DESC, segment_id) = 1)"""
add("f1_best_references", best_references, wt("segments", f"+{BEST} SELECT * FROM bref"))


def looked_up(s, d):
    """C17: reference of a segment's speaker and emotion, else the neutral one, else its own audio, wider where it is short."""
    p = best_references(s, d).select("chunk_id", "speaker", "emotion", col("segment_id").alias("ref"))
    asked = T.segments(s, d).select("chunk_id", "segment_id", "speaker", F.when(col("segment_id") % 2 == 0, "Scared").otherwise(col("emotion")).alias("emotion"), "start_ms", "end_ms")
    neutral = p.where("emotion = 'Neutral'").select("chunk_id", "speaker", col("ref").alias("neutral"))
    x = asked.join(p, ["chunk_id", "speaker", "emotion"], "left").join(neutral, ["chunk_id", "speaker"], "left").withColumn("ref", F.coalesce("ref", "neutral"))
    pad = F.when(col("end_ms") - col("start_ms") < 2000, 500).otherwise(0)
    own = lambda c: F.when(col("ref").isNull(), c)
    return x.select("chunk_id", "segment_id", "ref", own(F.greatest(F.lit(0), col("start_ms") - pad)).alias("self_start_ms"), own(col("end_ms") + pad).alias("self_end_ms"))


add("c17_lookup_reference", looked_up, wt("segments", f"""+{BEST}, asked AS (SELECT chunk_id, segment_id, speaker, start_ms, end_ms, CASE WHEN end_ms - start_ms < 2000 THEN 500 ELSE 0 END AS pad, CASE WHEN segment_id % 2 = 0 THEN 'Scared' ELSE emotion END AS emotion FROM segments),
  x AS (SELECT q.*, coalesce(a.segment_id, n.segment_id) AS ref FROM asked q LEFT JOIN bref a ON a.chunk_id = q.chunk_id AND a.speaker = q.speaker AND a.emotion = q.emotion LEFT JOIN bref n ON n.chunk_id = q.chunk_id AND n.speaker = q.speaker AND n.emotion = 'Neutral')
  SELECT chunk_id, segment_id, ref, CASE WHEN ref IS NULL THEN greatest(0, start_ms - pad) END AS self_start_ms, CASE WHEN ref IS NULL THEN end_ms + pad END AS self_end_ms FROM x"""))


def paired(s, d):
    """C20: every twentieth pair of a clip's and the next clip's samples, by rank."""
    a, b = (sequences.global_rank(x, "idx", ["clip"]) for x in clips(s, d))
    return a.drop("idx").join(b.drop("idx"), ["clip", "r"]).where("(r - 1) % 20 = 0").select("clip", "r", F.round(F.abs(col("a") - col("b")), 6).alias("diff"))


add("c20_paired", paired, wt("samples", CLIPS + """, x AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS r FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS r FROM b)
  SELECT clip, CAST(r AS BIGINT) AS r, round(abs(x.a - y.b), 6) AS diff FROM x JOIN y USING (clip, r) WHERE (r - 1) % 20 = 0"""))


def bins(s, d):
    """Level and peak per full second and clip; a block is a second."""
    full = sample_blocks(s, d).where(F.size(blocks.known(col("samples"))) == 100).select("clip_id", col("block").alias("second"), blocks.rms(col("samples")).alias("rms"), blocks.peak(col("samples")).alias("peak"))
    return full.select("clip_id", "second", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), (col("rms") > 0.05).alias("speech"), (col("rms") > 0.01).alias("audio"))


BINS = "bins AS (SELECT clip_id, idx // 100 AS second, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak, sqrt(avg(value * value)) > 0.05 AS speech, sqrt(avg(value * value)) > 0.01 AS audio FROM (SELECT clip_id, idx, CAST(value AS DOUBLE) AS value FROM samples) GROUP BY 1, 2 HAVING count(*) = 100)"
add("d11_level_bins", bins, wt("samples", f"+{BINS} SELECT * FROM bins"))
add("c21_align_bins", lambda s, d: bins(s, d).withColumn("take", F.expr("clip_id div 3")).withColumn("role", col("clip_id") % 3).groupBy("take", "second").pivot("role", [0, 1, 2]).agg(F.first("rms")).toDF("take", "second", "original", "final", "dubbed"),
    wt("samples", f"+{BINS} SELECT clip_id // 3 AS take, second, max(rms) FILTER (WHERE clip_id % 3 = 0) AS original, max(rms) FILTER (WHERE clip_id % 3 = 1) AS final, max(rms) FILTER (WHERE clip_id % 3 = 2) AS dubbed FROM bins GROUP BY 1, 2"))
add("a15_downmix", lambda s, d: T.samples(s, d).groupBy("idx").agg(F.round(F.avg("value"), 6).alias("value")), wt("samples", "SELECT idx, round(avg(CAST(value AS DOUBLE)), 6) AS value FROM samples GROUP BY 1"))
def word_levels(s, d):
    """Level of the audio under each word; a chunk's audio is the clip of its last digit."""
    heard = T.samples(s, d).select("clip_id", (col("idx") * 10).alias("start_ms"), (col("idx") * 10).alias("end_ms"), "value")
    both = joins.range_join(T.words(s, d).withColumn("clip_id", col("chunk_id") % 10), heard, "clip_id")
    return both.groupBy(col("l.chunk_id").alias("chunk_id"), col("l.word_idx").alias("word_idx")).agg(F.round(F.sqrt(F.avg(col("r.value") * col("r.value"))), 6).alias("rms"))


LEVELS = "levels AS (SELECT w.chunk_id, w.word_idx, round(sqrt(avg(CAST(value AS DOUBLE) * value)), 6) AS rms FROM words w JOIN samples s ON s.clip_id = w.chunk_id % 10 AND s.idx * 10 BETWEEN w.start_ms AND w.end_ms GROUP BY 1, 2)"
add("d12_word_level", word_levels, wt("words samples", f"+{LEVELS} SELECT * FROM levels"))
add("e1_contaminated", lambda s, d: sequences.contaminated(T.words(s, d), word_levels(s, d)), wt("words samples", f"""+{LEVELS}, x AS (SELECT *, end_ms - start_ms AS d, lead(start_ms) OVER w - end_ms AS g FROM words WINDOW w AS (PARTITION BY chunk_id ORDER BY word_idx)),
  y AS (SELECT *, lead(d) OVER w AS d1, lead(d, 2) OVER w AS d2, lead(g) OVER w AS g1 FROM x WINDOW w AS (PARTITION BY chunk_id ORDER BY word_idx)),
  z AS (SELECT *, coalesce(abs(d - d1) < 50 AND abs(d1 - d2) < 50 AND abs(g - g1) < 50 AND d > 1000 AND g > 300, false) AS run FROM y)
  SELECT chunk_id, word_idx, d > 3000 OR d < 20 AS bad_length, max(run) OVER (PARTITION BY chunk_id ORDER BY word_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad_rhythm, coalesce(rms < 0.005, true) AS bad_level FROM z LEFT JOIN levels USING (chunk_id, word_idx)"""))


parsed = lambda s, d: refine.parse_numbered(T.responses(s, d))
NUMBERED = rf"""ln0 AS (SELECT batch_id, unnest(string_split(response, chr(10))) AS line, unnest(range(0, len(string_split(response, chr(10))))) AS no FROM responses),
  ln1 AS (SELECT batch_id, no, rtrim(line) AS line, CASE WHEN regexp_matches(rtrim(line), '{NUMBERED_LINE}') THEN CAST(regexp_extract(rtrim(line), '{NUMBERED_LINE}', 1) AS BIGINT) END AS own FROM ln0),
  ln2 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY batch_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS idx FROM ln1),
  ln3 AS (SELECT batch_id, idx, no, own, CASE WHEN own IS NOT NULL THEN regexp_extract(line, '{NUMBERED_LINE}', 2) ELSE trim(line) END AS said FROM ln2 WHERE idx IS NOT NULL),
  parsed AS (SELECT batch_id, idx, trim(string_agg(said, ' ' ORDER BY no)) AS said FROM ln3 WHERE own IS NOT NULL OR said <> '' GROUP BY 1, 2)"""
add("h11_parse_numbered", parsed, wt("responses", f"+{NUMBERED} SELECT * FROM parsed"))
expected = lambda s, d: T.responses(s, d).select("batch_id", "n_expected", F.explode(F.sequence(F.lit(0).cast("long"), col("n_expected") - 1)).alias("idx"))
add("c22_missing_items", lambda s, d: expected(s, d).join(parsed(s, d).where("said <> ''"), ["batch_id", "idx"], "left_anti").withColumn("missing", F.count("*").over(W.partitionBy("batch_id"))).select("batch_id", "idx", (col("missing") > F.expr("n_expected div 2")).alias("retry")),
    wt("responses", f"+{NUMBERED}, ex AS (SELECT batch_id, n_expected, unnest(range(0, n_expected)) AS idx FROM responses), ms AS (SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM parsed p WHERE p.batch_id = ex.batch_id AND p.idx = ex.idx AND said <> '')) SELECT batch_id, CAST(idx AS BIGINT) AS idx, count(*) OVER (PARTITION BY batch_id) > n_expected // 2 AS retry FROM ms"))
add("g2_expected_minus_got", lambda s, d: expected(s, d).select("batch_id", "idx").exceptAll(parsed(s, d).select("batch_id", "idx")), wt("responses", f"+{NUMBERED} SELECT batch_id, CAST(idx AS BIGINT) AS idx FROM (SELECT batch_id, unnest(range(0, n_expected)) AS idx FROM responses) EXCEPT ALL SELECT batch_id, idx FROM parsed"))
add("c23_apply_responses", lambda s, d: T.segments(s, d).join(parsed(s, d).select(col("batch_id").alias("chunk_id"), col("idx").alias("segment_id"), "said"), ["chunk_id", "segment_id"], "left").select("chunk_id", "segment_id", F.coalesce(F.nullif(col("said"), F.lit("")), F.lit("")).alias("translated")),
    wt("segments responses", f"+{NUMBERED} SELECT s.chunk_id, s.segment_id, coalesce(nullif(p.said, ''), '') AS translated FROM segments s LEFT JOIN parsed p ON p.batch_id = s.chunk_id AND p.idx = s.segment_id"))
add("d5_speaker_stats", lambda s, d: T.turns(s, d).groupBy("chunk_id", "speaker").agg(F.sum(col("end_ms") - col("start_ms")).alias("talk_ms"), F.count("*").alias("turns"), F.count_if(col("end_ms") - col("start_ms") >= 1000).alias("long_turns")),
    wt("turns", "SELECT chunk_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, count(*) AS turns, count(*) FILTER (WHERE end_ms - start_ms >= 1000) AS long_turns FROM turns GROUP BY 1, 2"))


def coverage(s, d):
    """Frames with speech, with a face and with a target, of all frames of a chunk."""
    spine = joins.rasterise(T.face_turns(s, d), 25, timelines.chunk_frames(s, d))
    seen = T.face_frames(s, d).groupBy("chunk_id", "frame").agg(F.max("score").alias("best"))
    x = spine.join(seen, ["chunk_id", "frame"], "left").groupBy("chunk_id").agg(
        F.count("*").alias("n_frames"), F.count("speaker").alias("audio_frames"), F.count("best").alias("face_frames"), F.count_if(col("speaker").isNotNull() & (col("best") > -0.5)).alias("target_frames"))
    return x.select("*", *[F.round(col(f"{k}_frames") * 100.0 / col("n_frames"), 6).alias(f"{k}_percent") for k in ("audio", "face", "target")])


add("d8_av_coverage", coverage, wt("face_frames face_turns", f"""+{RASTER}, {SPINE}, x AS (SELECT s.chunk_id, s.frame, r.speaker, b.best FROM spine s LEFT JOIN raster r USING (chunk_id, frame) LEFT JOIN (SELECT chunk_id, frame, max(score) AS best FROM face_frames GROUP BY 1, 2) b USING (chunk_id, frame)),
  y AS (SELECT chunk_id, count(*) AS n_frames, count(speaker) AS audio_frames, count(best) AS face_frames, count(*) FILTER (WHERE speaker IS NOT NULL AND best > -0.5) AS target_frames FROM x GROUP BY 1)
  SELECT *, """ + ", ".join(f"round(CAST({k}_frames AS DOUBLE) * 100 / n_frames, 6) AS {k}_percent" for k in ("audio", "face", "target")) + " FROM y"))
add("d9_track_summary", lambda s, d: T.face_frames(s, d).groupBy("chunk_id", "track").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"), F.round(F.avg((col("score") > 0).cast("double")) * 100, 6).alias("speaking"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("peak")),
    wt("face_frames", "SELECT chunk_id, track, min(frame) AS first, max(frame) AS last, count(*) AS n, round(avg(CAST(score > 0 AS DOUBLE)) * 100, 6) AS speaking, round(avg(CAST(score AS DOUBLE)), 6) AS mean, round(max(CAST(score AS DOUBLE)), 6) AS peak FROM face_frames GROUP BY 1, 2"))


def frame_scores(s, d):
    """Best score of every frame on its video's timeline, and whether it is skipped; frames without a face are kept."""
    at = chunk_frames(s, d).select("video", "chunk_id", "first", "n_frames")
    best = T.face_frames(s, d).groupBy("chunk_id", "frame").agg(F.max("score").alias("score"))
    x = joins.frame_spine(at).join(best, ["chunk_id", "frame"], "left").join(at.drop("n_frames"), "chunk_id")
    return x.select("video", "chunk_id", (col("first") + col("frame")).alias("g"), "score", F.coalesce(col("score") < 0, F.lit(False)).alias("skip"))


SCORES = f"""{CHUNKS}, fs AS (SELECT video, chunk_id, first + frame AS g, score, coalesce(score < 0, false) AS skip FROM (SELECT *, unnest(range(0, n_frames)) AS frame FROM ch) LEFT JOIN (SELECT chunk_id, frame, max(score) AS score FROM face_frames GROUP BY 1, 2) USING (chunk_id, frame))"""
add("d10_frame_scores", lambda s, d: frame_scores(s, d).withColumn("score", F.round("score", 6)), wt("face_frames", f"+{SCORES} SELECT video, chunk_id, g, round(CAST(score AS DOUBLE), 6) AS score, skip FROM fs"))
add("d10_skip_stats", lambda s, d: frame_scores(s, d).groupBy("video", "chunk_id").agg(F.count("*").alias("frames"), F.count("score").alias("covered"), F.count_if("skip").alias("skipped"), F.count_if(~col("skip")).alias("kept")),
    wt("face_frames", f"+{SCORES} SELECT video, chunk_id, count(*) AS frames, count(score) AS covered, count(*) FILTER (WHERE skip) AS skipped, count(*) FILTER (WHERE NOT skip) AS kept FROM fs GROUP BY 1, 2"))
RATIO = "length(regexp_replace(text, '[^가-힣]', '', 'g')) / CAST(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS DOUBLE)"
add("d13_script_verdict", lambda s, d: T.transcripts(s, d).withColumn("r", F.coalesce(F.try_divide(text.hangul_count(col("text")), text.script_counts(col("text"))["total"]), F.lit(1.0))).select("run", "second", F.round("r", 6).alias("ratio"), F.when(col("r") >= 0.85, "PASS").when(col("r") >= 0.7, "MARGINAL").otherwise("FAIL").alias("verdict")),
    wt("transcripts", f"SELECT run, second, round(r, 6) AS ratio, CASE WHEN r >= 0.85 THEN 'PASS' WHEN r >= 0.7 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM (SELECT run, second, CASE WHEN regexp_matches(text, '\\p{{L}}') THEN {RATIO} ELSE 1.0 END AS r FROM transcripts)"))
from timeweave.plans.scalars import LEAK_SQL  # noqa: E402

leaks = lambda s, d: T.transcripts(s, d).withColumn("leak", text.leak_class(col("text")))
add("d14_leak_summary", lambda s, d: leaks(s, d).groupBy("run").agg(*[F.count_if(col("leak") == k).alias(k.lower()) for k in ("silent", "OTHER", "ENG", "MIXED", "clean")]),
    wt("transcripts", f"+lk AS (SELECT run, {LEAK_SQL} AS leak FROM transcripts) SELECT run, " + ", ".join(f"count(*) FILTER (WHERE leak = '{k}') AS {k.lower()}" for k in ("silent", "OTHER", "ENG", "MIXED", "clean")) + " FROM lk GROUP BY 1"))
add("d15_compare_runs", lambda s, d: leaks(s, d).groupBy("run").agg(F.count_if(col("leak").isin("OTHER", "ENG", "MIXED")).alias("leaks")).withColumn("change", col("leaks") - F.lag("leaks").over(W.orderBy("run"))),
    wt("transcripts", f"+lk AS (SELECT run, {LEAK_SQL} AS leak FROM transcripts), n AS (SELECT run, count(*) FILTER (WHERE leak IN ('OTHER', 'ENG', 'MIXED')) AS leaks FROM lk GROUP BY 1) SELECT run, leaks, leaks - lag(leaks) OVER (ORDER BY run) AS change FROM n"))
add("d16_confusion", lambda s, d: T.segments(s, d).groupBy("chunk_id", "speaker").pivot("emotion", ["Neutral", "Happy", "Sad", "Angry", "Surprised", "Scared"]).count().fillna(0).withColumn("purity", F.round(F.greatest("Neutral", "Happy", "Sad", "Angry", "Surprised", "Scared") / (col("Neutral") + col("Happy") + col("Sad") + col("Angry") + col("Surprised") + col("Scared")), 6)),
    wt("segments", "SELECT *, round(greatest(Neutral, Happy, Sad, Angry, Surprised, Scared) / CAST(Neutral + Happy + Sad + Angry + Surprised + Scared AS DOUBLE), 6) AS purity FROM (SELECT chunk_id, speaker, " + ", ".join(f"count(*) FILTER (WHERE emotion = '{e}') AS {e}" for e in ("Neutral", "Happy", "Sad", "Angry", "Surprised", "Scared")) + " FROM segments GROUP BY 1, 2)"))
def quality_summary(s, d):
    """Signal-to-noise of each clip against the next one in pieces of fifty samples, summed up per clip."""
    halves = blocks.pieces(blocks.mixed(col("a"), col("b"), 1.0, -1.0), 100, 50)
    mse = clip_blocks(s, d).select("clip", F.explode(F.transform(halves, blocks.mean_square)).alias("mse")).where("mse IS NOT NULL")
    psnr = mse.withColumn("psnr", blocks.signal_to_noise(col("mse")))
    figures = {"mean": F.avg("psnr"), "median": F.median("psnr"), "low": F.min("psnr"), "p5": F.expr("percentile(psnr, 0.05)"), "p95": F.expr("percentile(psnr, 0.95)")}
    return psnr.groupBy("clip").agg(*[F.round(v, 6).alias(k) for k, v in figures.items()])


add("d17_quality_summary", quality_summary, wt("samples", CLIPS + """, m AS (SELECT clip, idx // 50 AS piece, avg((CAST(a AS DOUBLE) - b) * (CAST(a AS DOUBLE) - b)) AS mse FROM a JOIN b USING (clip, idx) GROUP BY 1, 2),
  q AS (SELECT clip, CASE WHEN mse = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(4.0 / mse) END AS psnr FROM m)
  SELECT clip, round(avg(psnr), 6) AS mean, round(median(psnr), 6) AS median, round(min(psnr), 6) AS low, round(quantile_cont(psnr, 0.05), 6) AS p5, round(quantile_cont(psnr, 0.95), 6) AS p95 FROM q GROUP BY 1"""))


def evaluate_scores(rows, pred: str, label: str, group: str):
    """MSE, Pearson and Spearman with average ranks on ties, per group."""
    for c in (pred, label):
        w = W.partitionBy(group).orderBy(c)
        rows = rows.withColumn(f"r_{c}", F.rank().over(w) + (F.count("*").over(W.partitionBy(group, c)) - 1) / 2)
    return rows.groupBy(group).agg(F.round(F.avg((col(pred) - col(label)) * (col(pred) - col(label))), 4).alias("mse"), F.round(F.corr(pred, label), 6).alias("lcc"), F.round(F.corr(f"r_{pred}", f"r_{label}"), 6).alias("srcc"))


add("d18_evaluate_scores", lambda s, d: evaluate_scores(T.table(s, d, "part").select("p_brand", col("p_retailprice").cast("double").alias("pred"), col("p_size").cast("double").alias("label")), "pred", "label", "p_brand"),
    """WITH x AS (SELECT p_brand, CAST(p_retailprice AS DOUBLE) AS p, CAST(p_size AS DOUBLE) AS l FROM part), r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p) + (count(*) OVER (PARTITION BY p_brand, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY p_brand ORDER BY l) + (count(*) OVER (PARTITION BY p_brand, l) - 1) / 2.0 AS rl FROM x)
  SELECT p_brand, round(avg((p - l) * (p - l)), 4) AS mse, round(corr(p, l), 6) AS lcc, round(corr(CAST(rp AS DOUBLE), CAST(rl AS DOUBLE)), 6) AS srcc FROM r GROUP BY 1""")
add("d19_best_epoch", lambda s, d: T.attempts(s, d).groupBy("chunk_id", "attempt").agg(F.round(F.avg("score"), 9).alias("srcc")).groupBy("chunk_id").agg(F.max_by("attempt", F.struct("srcc", -col("attempt"))).alias("epoch"), F.max("srcc").alias("srcc")),
    wt("attempts", "SELECT chunk_id, attempt AS epoch, srcc FROM (SELECT chunk_id, attempt, round(avg(CAST(score AS DOUBLE)), 9) AS srcc FROM attempts GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY srcc DESC, attempt) = 1"))


def stability(s, d):
    b = T.face_frames(s, d).select("chunk_id", "track", "frame", (col("x2") - col("x1")).alias("w"), (col("y2") - col("y1")).alias("h"), ((col("x1") + col("x2")) / 2).alias("cx"), ((col("y1") + col("y2")) / 2).alias("cy"))
    m = b.groupBy("chunk_id", "track").agg(*[F.median(c).alias(f"m{c}") for c in ("w", "h", "cx", "cy")], F.count("*").alias("n")).where("n >= 5")
    far = F.sqrt((col("cx") - col("mcx")) ** 2 + (col("cy") - col("mcy")) ** 2) > 2 * F.greatest("mw", "mh")
    odd = lambda c: (col(c) < 0.5 * col(f"m{c}")) | (col(c) > 2 * col(f"m{c}"))
    return b.join(m, ["chunk_id", "track"]).where(odd("w") | odd("h") | far).select("chunk_id", "track", "frame")


add("d20_stability_outliers", stability, wt("face_frames", """+b AS (SELECT chunk_id, track, frame, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM face_frames), m AS (SELECT chunk_id, track, median(w) AS mw, median(h) AS mh, median(cx) AS mcx, median(cy) AS mcy FROM b GROUP BY 1, 2 HAVING count(*) >= 5)
  SELECT chunk_id, track, frame FROM b JOIN m USING (chunk_id, track) WHERE w < 0.5 * mw OR w > 2 * mw OR h < 0.5 * mh OR h > 2 * mh OR sqrt((cx - mcx) * (cx - mcx) + (cy - mcy) * (cy - mcy)) > 2 * greatest(mw, mh)"""))


def moments(s, d):
    st = T.samples(s, d).groupBy("clip_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    ref = F.broadcast(st.where("clip_id = 0").select(col("m").alias("m0"), col("sd").alias("sd0")))
    x = T.samples(s, d).where("clip_id > 0").join(st, "clip_id").join(ref)
    return x.select("clip_id", "idx", F.round(0.3 * col("value") + 0.7 * ((col("value") - col("m")) * col("sd0") / (col("sd") + 1e-6) + col("m0")), 6).alias("value"))


add("d21_match_moments", moments, wt("samples", "+sv AS (SELECT clip_id, idx, CAST(value AS DOUBLE) AS v FROM samples), st AS (SELECT clip_id, avg(v) AS m, stddev_pop(v) AS sd FROM sv GROUP BY 1), r AS (SELECT m AS m0, sd AS sd0 FROM st WHERE clip_id = 0) SELECT clip_id, idx, round(CAST(0.3 AS DOUBLE) * v + CAST(0.7 AS DOUBLE) * ((v - m) * sd0 / (sd + 1e-6) + m0), 6) AS value FROM sv JOIN st USING (clip_id), r WHERE clip_id > 0"))
add("d22_report_rollup", lambda s, d: T.segments(s, d).withColumn("run", F.expr("chunk_id div 10")).rollup("run", "chunk_id", "speaker", "emotion").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum(col("end_ms") - col("start_ms")).alias("talk_ms"), F.round(F.avg("tts_mos"), 6).alias("mos")),
    wt("segments", "+g AS (SELECT *, chunk_id // 10 AS run FROM segments) SELECT run, chunk_id, speaker, emotion, CAST(grouping(run, chunk_id, speaker, emotion) AS BIGINT) AS level, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, round(avg(CAST(tts_mos AS DOUBLE)), 6) AS mos FROM g GROUP BY ROLLUP (run, chunk_id, speaker, emotion)"))
rms_by_clip = lambda s, d: T.samples(s, d).groupBy("clip_id").agg(F.sqrt(F.avg(col("value") * col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"))
add("d23_d24_gains", lambda s, d: rms_by_clip(s, d).join(F.broadcast(rms_by_clip(s, d).where("clip_id = 0").select(col("rms").alias("r0")))).select("clip_id",
    F.round(F.when((col("rms") > 1e-5) & (col("r0") > 1e-5), F.greatest(F.lit(0.3), F.least(F.lit(2.5), col("r0") / col("rms")))).otherwise(1.0), 6).alias("gain"), F.round(F.when(col("peak") > 1e-6, 0.9 / col("peak")).otherwise(1.0), 6).alias("normalise"), F.round(F.when((col("peak") > 0) & (col("peak") < 0.5), F.least(0.7 / col("peak"), F.lit(4.0))).otherwise(1.0), 6).alias("boost")),
    wt("samples", "+r AS (SELECT clip_id, sqrt(avg(CAST(value AS DOUBLE) * value)) AS rms, max(abs(CAST(value AS DOUBLE))) AS peak FROM samples GROUP BY 1), z AS (SELECT rms AS r0 FROM r WHERE clip_id = 0) SELECT clip_id, round(CASE WHEN rms > 1e-5 AND r0 > 1e-5 THEN greatest(CAST(0.3 AS DOUBLE), least(CAST(2.5 AS DOUBLE), r0 / rms)) ELSE 1 END, 6) AS gain, round(CASE WHEN peak > 1e-6 THEN CAST(0.9 AS DOUBLE) / peak ELSE 1 END, 6) AS normalise, round(CASE WHEN peak > 0 AND peak < 0.5 THEN least(CAST(0.7 AS DOUBLE) / peak, CAST(4 AS DOUBLE)) ELSE 1 END, 6) AS boost FROM r, z"))
add("d25_fill_stats", lambda s, d: T.samples(s, d).withColumn("m", F.expr("CAST(round((value + 1) * 127.5) AS BIGINT)")).groupBy("clip_id").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg((col("m") < 128).cast("double")) * 100, 6).alias("below")),
    wt("samples", "SELECT clip_id, round(avg(m), 6) AS mean, round(avg(CAST(m < 128 AS DOUBLE)) * 100, 6) AS below FROM (SELECT clip_id, CAST(round((CAST(value AS DOUBLE) + 1) * CAST(127.5 AS DOUBLE)) AS BIGINT) AS m FROM samples) GROUP BY 1"))
add("d26_interval_totals", lambda s, d: T.speech(s, d).groupBy("chunk_id").agg(F.count("*").alias("intervals"), F.sum(col("end_ms") - col("start_ms")).alias("speech_ms")), wt("speech", "SELECT chunk_id, count(*) AS intervals, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms FROM speech GROUP BY 1"))


def change_counts(s, d):
    """Turns before and after joining, and emotions that the content type overrides, per chunk."""
    t = T.turns(s, d)
    joined = sequences.collapse_turns(t).groupBy("chunk_id").agg(F.count("*").alias("turns_after"))
    neutral = text.lookup(planning.POLICIES, F.expr(KIND), "passthrough") == "neutral_only"
    moods = T.segments(s, d).groupBy("chunk_id").agg(F.count_if(neutral & (col("emotion") != "Neutral")).alias("overrides"))
    return t.groupBy("chunk_id").agg(F.count("*").alias("turns_before")).join(joined, "chunk_id").join(moods, "chunk_id")


add("d26_change_counts", change_counts, wt("segments", f"""+src AS (SELECT chunk_id, turn_idx, speaker, start_ms, end_ms FROM turns), {COLLAPSE}
  SELECT b.chunk_id, b.turns_before, a.turns_after, m.overrides FROM (SELECT chunk_id, count(*) AS turns_before FROM turns GROUP BY 1) b JOIN (SELECT chunk_id, count(DISTINCT head) AS turns_after FROM fold GROUP BY 1) a USING (chunk_id)
  JOIN (SELECT chunk_id, count(*) FILTER (WHERE {KIND} IN ('lecture', 'news') AND emotion <> 'Neutral') AS overrides FROM segments GROUP BY 1) m USING (chunk_id)""", recursive=True))
def stage_times(timings, frames, keys: list[str]):
    """Of stage times (keys, stage, ms) and frame counts (keys, n_frames), each stage's total, its share of all stages and
    its time a frame (of one frame where there are none)."""
    total = timings.groupBy(*keys, "stage").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"))
    share = F.try_divide("total_ms", F.sum("total_ms").over(W.partitionBy(*keys)))
    x = total.withColumn("share", share).join(frames, keys, "left")
    return x.select(*keys, "stage", "calls", F.round("total_ms", 3).alias("total_ms"), F.round("share", 6).alias("share"), F.round(col("total_ms") / F.greatest(F.coalesce("n_frames", F.lit(1)), F.lit(1)), 3).alias("ms_per_frame"))


def stage_timing(s, d):
    """Stage times are logged as events; a chunk's frames are those of its faces."""
    timings = T.table(s, d, "events").select(F.expr("CAST(user_id AS BIGINT) div 15").alias("chunk_id"), col("event_type").alias("stage"), col("value").cast("double").alias("ms"))
    return stage_times(timings, T.face_frames(s, d).groupBy("chunk_id").agg((F.max("frame") + 1).alias("n_frames")), ["chunk_id"])


add("d28_stage_timing", stage_timing, wt("face_frames", """+t AS (SELECT CAST(user_id AS BIGINT) // 15 AS chunk_id, event_type AS stage, count(*) AS calls, sum(CAST(value AS DOUBLE)) AS total FROM events GROUP BY 1, 2), n AS (SELECT chunk_id, max(frame) + 1 AS n_frames FROM face_frames GROUP BY 1)
  SELECT t.chunk_id, stage, calls, round(total, 3) AS total_ms, round(total / sum(total) OVER (PARTITION BY t.chunk_id), 6) AS share, round(total / n_frames, 3) AS ms_per_frame FROM t JOIN n USING (chunk_id)"""))
add("f3_largest_face", lambda s, d: T.face_frames(s, d).groupBy("chunk_id", "frame").agg(F.max_by("track", F.struct((col("x2") - col("x1")) * (col("y2") - col("y1")), -col("track"))).alias("track")), wt("face_frames", "SELECT chunk_id, frame, first(track ORDER BY (x2 - x1) * (y2 - y1) DESC, track) AS track FROM face_frames GROUP BY 1, 2"))
def stratified(s, d):
    """all English documents, of every other language the first sixty; only the latter are ranked."""
    docs = T.table(s, d, "documents").select("doc_id", "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))
    return docs.where("lang = 'en'").unionByName(docs.where("lang <> 'en'").withColumn("r", rank).where("r <= 60").drop("r"))


add("f4_stratified_cap", stratified, "SELECT doc_id, lang FROM documents QUALIFY lang = 'en' OR row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 60")
add("f6_first_words", lambda s, d: T.words(s, d).where("word_idx < 200").groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("head")), wt("words", "SELECT chunk_id, string_agg(word, ' ' ORDER BY word_idx) AS head FROM words WHERE word_idx < 200 GROUP BY 1"))
add("f7_long_words", lambda s, d: T.words(s, d).where("end_ms - start_ms > 3000").withColumn("r", F.row_number().over(W.partitionBy("chunk_id").orderBy("word_idx"))).where("r <= 5").select("chunk_id", "word_idx", "word"), wt("words", "SELECT chunk_id, word_idx, word FROM words WHERE end_ms - start_ms > 3000 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY word_idx) <= 5"))
add("g1_concat_chunks", lambda s, d: T.turns(s, d).join(T.turns(s, d).groupBy("chunk_id").agg(F.max("end_ms").alias("dur")).withColumn("run", F.expr("chunk_id div 20")).withColumn("shift", F.coalesce(F.sum("dur").over(W.partitionBy("run").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "chunk_id").select("run", "chunk_id", "turn_idx", (col("start_ms") + col("shift")).alias("start_ms")),
    wt("turns", "+o AS (SELECT chunk_id, chunk_id // 20 AS run, CAST(coalesce(sum(dur) OVER (PARTITION BY chunk_id // 20 ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM (SELECT chunk_id, max(end_ms) AS dur FROM turns GROUP BY 1)) SELECT run, chunk_id, turn_idx, start_ms + shift AS start_ms FROM turns JOIN o USING (chunk_id)"))
add("g3_shared_tracks", lambda s, d: face_counts(s, d).select("chunk_id", "track", col("speaker").alias("a")).join(face_counts(s, d).select("chunk_id", "track", col("speaker").alias("b")), ["chunk_id", "track"]).where("a < b").groupBy("chunk_id", "a", "b").agg(F.count("*").alias("tracks")), wt("face_frames face_turns", f"+{COUNTS} SELECT x.chunk_id, x.speaker AS a, y.speaker AS b, count(*) AS tracks FROM fcounts x JOIN fcounts y ON x.chunk_id = y.chunk_id AND x.track = y.track AND x.speaker < y.speaker GROUP BY 1, 2, 3"))
add("g4_split_at", lambda s, d: T.words(s, d).groupBy("chunk_id").agg(F.count_if(col("end_ms") <= 60000).alias("before"), F.count_if(col("end_ms") > 60000).alias("after")), wt("words", "SELECT chunk_id, count(*) FILTER (WHERE end_ms <= 60000) AS before, count(*) FILTER (WHERE end_ms > 60000) AS after FROM words GROUP BY 1"))
add("g5_union_labelled", lambda s, d: T.turns(s, d).select(F.lit("turns").alias("source"), "chunk_id", "start_ms", "end_ms").unionByName(T.speech(s, d).select(F.lit("speech").alias("source"), "chunk_id", "start_ms", "end_ms")), wt("turns speech", "SELECT 'turns' AS source, chunk_id, start_ms, end_ms FROM turns UNION ALL SELECT 'speech', chunk_id, start_ms, end_ms FROM speech"))
LOGS = r"pl AS (SELECT log, seq, CAST(regexp_extract(line, '(\d+)/(\d+) \[', 1) AS BIGINT) AS step, CAST(regexp_extract(line, 'step_loss=([\d.]+)', 1) AS DOUBLE) AS loss FROM train_lines)"


def monitored(s, d):
    from timeweave.functions.logs import parse_step

    return T.train_lines(s, d).select("log", "seq", parse_step(col("line")).alias("p")).select("log", "seq", "p.step", "p.loss")


add("i1_monitor_batch", lambda s, d: monitored(s, d).withColumn("r", F.row_number().over(W.partitionBy("log").orderBy(F.desc("seq")))).where("r <= 100").groupBy("log").agg(F.max("step").alias("step"), F.round(F.avg("loss"), 6).alias("mean_loss")),
    wt("train_lines", f"+{LOGS} SELECT log, max(step) AS step, round(avg(loss), 6) AS mean_loss FROM (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY log ORDER BY seq DESC) <= 100) GROUP BY 1"))


def alerts(s, d):
    w = W.partitionBy("log").orderBy("seq")
    x = monitored(s, d).withColumn("used", 8000 + (col("seq") * 37 + F.length("log") * 991) % 7800).withColumn("free", 200 - col("seq") % 170)
    x = x.withColumn("peak", F.max("used").over(w)).withColumn("old", F.lag("peak", 4).over(w)).withColumn("lo", F.min("step").over(w.rowsBetween(-2, 0))).withColumn("n", F.count("*").over(w.rowsBetween(-2, 0)))
    return x.select("log", "seq", "peak", (col("peak") > 0.92 * 16000).alias("memory"), F.coalesce((col("old") > 0) & (col("peak") > col("old") * 1.1), F.lit(False)).alias("growth"), (col("free") < 50).alias("disk"), ((F.avg("loss").over(w.rowsBetween(-99, 0)) > 1.0) & (col("step") > 100)).alias("diverging"), ((col("n") == 3) & (col("lo") == col("step")) & (col("step") > 0)).alias("stalled"))


ALERTS_SQL = wt("train_lines", f"""+{LOGS}, x AS (SELECT *, 8000 + (seq * 37 + length(log) * 991) % 7800 AS used, 200 - seq % 170 AS free FROM pl), y AS (SELECT *, max(used) OVER (PARTITION BY log ORDER BY seq) AS peak, min(step) OVER (PARTITION BY log ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS lo, count(*) OVER (PARTITION BY log ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM x),
  z AS (SELECT *, lag(peak, 4) OVER (PARTITION BY log ORDER BY seq) AS old FROM y) SELECT log, seq, peak, peak > CAST(0.92 AS DOUBLE) * 16000 AS memory, coalesce(old > 0 AND peak > old * CAST(1.1 AS DOUBLE), false) AS growth, free < 50 AS disk, avg(loss) OVER (PARTITION BY log ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 1.0 AND step > 100 AS diverging, n = 3 AND lo = step AND step > 0 AS stalled FROM z""")
add("i2_i3_alerts_batch", alerts, ALERTS_SQL)
