"""Sources and sinks over the derived tables: each query writes files to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import refine
from timeweave.operators.lineage import shared_path
from timeweave.plans.media import BEST, best_references
from timeweave.sources import files
from timeweave.sources import timeline as T

QUERIES, ORACLE_SQL = {}, {}
col, wt = F.col, T.with_tables
RUN = "concat('run', CAST(chunk_id div 10 AS STRING))"


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def reports(s, d):
    path = shared_path(s, "reports")
    files.write_reports(T.segments(s, d).withColumn("run_id", F.expr(RUN)), best_references(s, d).withColumn("run_id", F.expr(RUN)), path)
    return files.read_reports(s, path)


add("a1_a2_report_segments", lambda s, d: reports(s, d)[0], wt("segments", "SELECT 'run' || (chunk_id // 10) AS run_id, chunk_id, segment_id, speaker, start_ms, end_ms, text, translated, emotion, CAST(emotion_score AS DOUBLE) AS emotion_score, CAST(tts_mos AS DOUBLE) AS tts_mos FROM segments"))
add("a1_a2_report_profiles", lambda s, d: reports(s, d)[1], wt("segments", f"+{BEST} SELECT 'run' || (chunk_id // 10) AS run_id, chunk_id, speaker, emotion, segment_id FROM bref"))


def asr(s, d):
    """Words go out in three time shapes by chunk and come back in one."""
    path, sec = shared_path(s, "asr"), lambda c: col(c) / 1000.0
    kind = col("chunk_id") % 3
    w = F.struct("word_idx", "word", F.when(kind == 0, sec("start_ms")).alias("start"), F.when(kind == 0, sec("end_ms")).alias("end"), F.when(kind == 1, sec("start_ms")).alias("start_time"), F.when(kind == 1, sec("end_ms")).alias("end_time"), F.when(kind == 2, F.array(sec("start_ms"), sec("end_ms"))).alias("timestamp"))
    one = T.words(s, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", w.alias("w")))).alias("w"))
    one.select("chunk_id", F.array(F.struct(F.when(col("chunk_id") % 2 == 0, "Korean").otherwise("Klingon").alias("language"), F.transform("w", lambda x: x["w"]).alias("words"))).alias("result")).write.json(path)
    return files.read_asr(s, path)


add("a3_read_asr", asr, wt("words", "SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'ko' ELSE 'klingon' END AS lang, word_idx, word, start_ms, end_ms FROM words"))


def turns(s, d):
    path = shared_path(s, "turns")
    t = T.face_turns(s, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", (col("start_ms") / 1000.0).alias("start"), (col("end_ms") / 1000.0).alias("end"), F.substring("speaker", 9, 2).cast("long").alias("label")))).alias("turns"))
    t.write.json(path)
    return files.read_turns(s, path, 500)


add("a4_read_turns", turns, wt("face_turns", "SELECT chunk_id, turn_idx, speaker, start_ms, end_ms FROM face_turns WHERE end_ms - start_ms >= 500"))


def tracks(s, d):
    """Every track goes out with one score too few."""
    path = shared_path(s, "tracks")
    f = T.face_frames(s, d).groupBy("chunk_id", "track").agg(F.array_sort(F.collect_list(F.struct("frame", F.array("x1", "y1", "x2", "y2").alias("b"), "score"))).alias("r"))
    t = F.struct("track", F.transform("r", lambda x: x["frame"]).alias("frames"), F.transform("r", lambda x: x["b"]).alias("bboxes"), F.slice(F.transform("r", lambda x: x["score"]), F.lit(1), F.size("r") - 1).alias("scores"))
    f.where("size(r) > 1").groupBy("chunk_id").agg(F.array_sort(F.collect_list(t)).alias("tracks")).write.json(path)
    return files.read_tracks(s, path)[0]


add("a5_read_tracks", tracks, wt("face_frames", "+q AS (SELECT *, lead(frame) OVER (PARTITION BY chunk_id, track ORDER BY frame) AS nxt, count(*) OVER (PARTITION BY chunk_id, track) AS n FROM face_frames), k AS (SELECT chunk_id, track, dense_rank() OVER (PARTITION BY chunk_id ORDER BY track) - 1 AS place FROM (SELECT DISTINCT chunk_id, track FROM q WHERE n > 1)) SELECT chunk_id, place AS track, frame, x1, y1, x2, y2, CAST(score AS DOUBLE) AS score FROM q JOIN k USING (chunk_id, track) WHERE nxt IS NOT NULL"))


def index(s, d):
    """Every fifth chunk has no frame count; a video takes every tenth chunk."""
    path = shared_path(s, "index")
    c = T.face_frames(s, d).groupBy("chunk_id").agg((F.max("frame") + 1).alias("n_frames")).withColumn("video", col("chunk_id") % 10)
    files.write_index(c.select("video", F.format_string("chunk_%06d", "chunk_id").alias("stem"), F.when(col("chunk_id") % 5 != 2, col("n_frames")).alias("n_frames")), path)
    return files.read_index(s, path)


add("a6_index", index, wt("face_frames", """SELECT chunk_id % 10 AS video, printf('chunk_%06d', chunk_id) AS stem, row_number() OVER (PARTITION BY chunk_id % 10 ORDER BY chunk_id) - 1 AS ord, n_frames
  FROM (SELECT chunk_id, max(frame) + 1 AS n_frames FROM face_frames GROUP BY 1) WHERE chunk_id % 5 <> 2"""))


def scores(s, d):
    path = shared_path(s, "scores")
    rows = T.table(s, d, "part").select(F.when(col("p_partkey") % 7 == 0, F.concat(F.lit("f"), "p_partkey")).when(col("p_partkey") % 11 == 0, F.concat(F.lit("f"), "p_partkey", F.lit(",bad"))).otherwise(F.concat(F.lit("f"), "p_partkey", F.lit(","), "p_size")).alias("path"))
    files.write_manifest(rows, path)
    return files.read_score_list(s, path, T.table(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("f"), "p_partkey").alias("file")))


add("a7_a13_score_list", scores, "SELECT 'f' || p_partkey AS file, CAST(p_size AS DOUBLE) AS mos FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")


def runs(s, d):
    """The second write of run1 replaces it and leaves run0 alone."""
    path = shared_path(s, "runs")
    t = T.turns(s, d).select("chunk_id", "turn_idx", "start_ms")
    for run, part in (("run0", "chunk_id % 2 = 0"), ("run1", "chunk_id % 2 = 1"), ("run1", "chunk_id % 4 = 1")):
        files.write_run(t.where(part), run, path)
    return s.read.parquet(path).select("chunk_id", "turn_idx", "start_ms", col("run_id").cast("string").alias("run_id"))


add("a11_run_sink", runs, wt("turns", "SELECT chunk_id, turn_idx, start_ms, CASE WHEN chunk_id % 2 = 0 THEN 'run0' ELSE 'run1' END AS run_id FROM turns WHERE chunk_id % 2 = 0 OR chunk_id % 4 = 1"))


def logs(s, d):
    """A file a log; half of its lines end in a carriage return. What is read is the tail of each file."""
    path = shared_path(s, "log")
    ended = F.concat("line", F.when(col("seq") % 2 == 0, "\n").otherwise("\r"))
    one = T.train_lines(s, d).groupBy(F.col("log").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", ended.alias("e")))), lambda x: x["e"]), "").alias("value"))
    files.write_texts(one.select("name", F.concat("value", F.lit("\n")).alias("content")), path, folders=True)
    return files.read_train_log(s, path).groupBy("line").agg(F.count("*").alias("n"))


add("a12_train_log", logs, wt("train_lines", """+f AS (SELECT log, right(string_agg(line || CASE WHEN seq % 2 = 0 THEN chr(10) ELSE chr(13) END, '' ORDER BY seq) || chr(10), 200000) AS tail FROM train_lines GROUP BY 1)
  SELECT line, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(tail, '[\r\n]')) AS line FROM f) WHERE line <> '' GROUP BY 1"""))


def validation(s, d):
    path = shared_path(s, "validation")
    files.write_validation(T.words(s, d), T.segments(s, d).groupBy("chunk_id").agg(F.count("*").alias("segments")), path)
    back = s.read.schema("chunk_id long, duration_ms long, segments long, words array<struct<word_idx:long, word:string, start_ms:long, end_ms:long>>").json(path)
    return back.select("chunk_id", "duration_ms", "segments", F.size("words").cast("long").alias("n_words"), F.element_at("words", -1)["word"].alias("last_word"))


add("a14_validation", validation, wt("segments", "SELECT w.chunk_id, w.dur AS duration_ms, s.n AS segments, least(w.n, 200) AS n_words, w.last_word FROM (SELECT chunk_id, max(end_ms) AS dur, count(*) AS n, arg_max(word, CASE WHEN word_idx < 200 THEN word_idx ELSE -1 END) AS last_word FROM words GROUP BY 1) w JOIN (SELECT chunk_id, count(*) AS n FROM segments GROUP BY 1) s USING (chunk_id)"))


# Clip metadata: one file a supplier, as an object or a list, with keys in either case, some broken, some without a name.
CLIP = """CASE s_suppkey % 5 WHEN 0 THEN concat('{"Video_env": {"Angle": "', angle, '"}, "Audio_env": {"Noise": "', noise, '"}, "Video_info": {"video_Name": "', s_name, '"}}')
  WHEN 1 THEN concat('[{"Video_env": {"angle": "', angle, '"}, "Audio_env": {"noise": "', noise, '"}, "Video_info": {"video_name": "', s_name, '"}}]')
  WHEN 2 THEN concat('{"Video_env": {"Angle": "', angle, '"}, "Video_info": {"video_name": "', s_name, '"}}')
  WHEN 3 THEN concat('{"Audio_env": {"noise": "', noise, '"}}') ELSE concat('{broken ', s_name) END"""
SUPPLIERS = "SELECT *, concat('A', CAST(s_nationkey % 4 AS {0})) AS angle, concat('N', CAST(s_nationkey % 3 AS {0})) AS noise FROM supplier"


def clip_folder(s, d):
    path = shared_path(s, "clips")
    x = T.table(s, d, "supplier").withColumn("angle", F.expr("concat('A', CAST(s_nationkey % 4 AS STRING))")).withColumn("noise", F.expr("concat('N', CAST(s_nationkey % 3 AS STRING))"))
    files.write_texts(x.select(F.concat(F.lit("s_suppkey="), "s_suppkey").alias("name"), F.concat(F.coalesce(F.expr(CLIP), F.lit("")), F.lit("\n")).alias("content")), path, ".txt", folders=True)
    return path


def clips(s, d):
    """A file that names no video stands for its own name, which the writer chose: it is shown as a dash."""
    meta = files.read_clip_metadata(s, clip_folder(s, d), "*.txt")
    return meta.select("angle", "noise", F.when(col("video").startswith("s_suppkey="), "-").otherwise(col("video")).alias("video"))


CLIPS_SQL = f"""WITH s AS ({SUPPLIERS.format('VARCHAR')}), clips AS (SELECT CASE WHEN s_suppkey % 5 < 3 THEN angle END AS angle, CASE WHEN s_suppkey % 5 <> 2 THEN noise END AS noise, CASE WHEN s_suppkey % 5 = 3 THEN '-' ELSE s_name END AS video FROM s WHERE s_suppkey % 5 < 4)"""
add("a8_clip_metadata", clips, f"{CLIPS_SQL} SELECT * FROM clips")
MEDIA_BYTES, MADE_BYTES = "400 + (s_suppkey * 37) % 900", "(s_suppkey * 613) % 2600"


def media_pending(s, d):
    """Metadata files meet the media files of their names (two in three suppliers have one, every seventh twice); those
    whose crop is missing or too small are to do."""
    names = T.table(s, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(".mp4")).alias("file"))
    meta = clips(s, d).where("video <> '-'").withColumn("video", F.concat("video", F.lit(".mp4")))
    source, made = shared_path(s, "media"), shared_path(s, "made")
    put = lambda x, size, folder: files.write_texts(x.select(F.regexp_replace("file", r"\.mp4$", "").alias("name"), F.expr(f"repeat('x', CAST({size} AS INT))").alias("content")), folder, ".mp4", folders=True)
    put(names.where("s_suppkey % 3 <> 1"), MEDIA_BYTES, f"{source}/a")
    put(names.where("s_suppkey % 7 = 0"), "7", f"{source}/b")
    put(names.where("s_suppkey % 2 = 0"), MADE_BYTES, made)
    todo = files.pending(files.with_media(meta, files.media_inventory(s, source, "*.mp4")), files.media_inventory(s, made, "*.mp4"))
    return todo.select("video", "angle", "noise", F.element_at(F.split("path", "/"), -3).alias("folder"), "length")


add("c12_with_media_pending", media_pending, f"""{CLIPS_SQL}, k AS (SELECT s_suppkey, s_name FROM supplier),
  m AS (SELECT s_name, CASE WHEN s_suppkey % 3 <> 1 THEN 'a' ELSE 'b' END AS folder, CASE WHEN s_suppkey % 3 <> 1 THEN CAST({MEDIA_BYTES} AS BIGINT) ELSE 7 END AS length FROM k WHERE s_suppkey % 3 <> 1 OR s_suppkey % 7 = 0),
  done AS (SELECT s_name FROM k WHERE s_suppkey % 2 = 0 AND {MADE_BYTES} > 1024)
  SELECT c.video || '.mp4' AS video, c.angle, c.noise, m.folder, m.length FROM clips c JOIN m ON m.s_name = c.video WHERE c.video NOT IN (SELECT s_name FROM done)""")
add("b12_filter_clips", lambda s, d: files.filter_clips(clips(s, d), angle="A1", noise="N1"), f"{CLIPS_SQL} SELECT * FROM clips WHERE angle = 'A1' AND noise = 'N1'")
SUPPLIER = r"CAST(regexp_extract(path, 's_suppkey=([0-9]+)', 1) AS BIGINT) AS supplier"
BYTES_SQL = f"WITH s AS ({SUPPLIERS.format('VARCHAR')}), f AS (SELECT s_suppkey, {CLIP} || chr(10) AS body FROM s)"
add("a9_media_inventory", lambda s, d: files.media_inventory(s, clip_folder(s, d), "*.txt", 40).selectExpr(SUPPLIER, "length"), f"{BYTES_SQL} SELECT s_suppkey AS supplier, strlen(body) AS length FROM f WHERE strlen(body) >= 40")
add("a10_content_hash", lambda s, d: files.content_hash(files.media_inventory(s, clip_folder(s, d), "*.txt")).selectExpr(SUPPLIER, "fingerprint"),
    f"{BYTES_SQL} SELECT s_suppkey AS supplier, left(md5(body || body || CAST(strlen(body) AS VARCHAR)), 16) AS fingerprint FROM f")


def count_words(weight, texts):
    """A scorer that cannot take a text without a blank: it fails for the whole batch."""
    if any(t is None or " " not in t for t in texts):
        raise ValueError("not a sentence")
    return [weight * len(t) for t in texts]


add("j1_score_with", lambda s, d: (lambda docs: docs.select("doc_id", files.score_with(docs, "text", count_words, lambda: 0.5).alias("score")))(T.table(s, d, "documents")),
    "SELECT doc_id, CAST(CASE WHEN contains(text, ' ') THEN 0.5 * length(text) ELSE 0 END AS DOUBLE) AS score FROM documents")


def speaker_count(s, d):
    """The number of speakers in the table, with the number of voices it was chosen from."""
    v = T.turn_vectors(s, d).where("embedding IS NOT NULL").select("embedding")
    return v.agg(F.count("*").alias("voices")).withColumn("speakers", F.lit(refine.choose_k(v)))


add("d27_choose_k", speaker_count)
