"""Joins, speaker vectors and sequences over the derived tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timeweave.functions import text
from timeweave.operators import joins, sequences, speakers, split
from timeweave.operators.lineage import staged
from timeweave.sources import timeline as T

QUERIES, ORACLE_SQL = {}, {}
col, wt = F.col, T.with_tables


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def points(s, d):
    """Middle of each word as a point."""
    return points_of(T.words(s, d))


def points_of(words):
    return words.select("chunk_id", col("word_idx").alias("point_idx"), F.expr("(start_ms + end_ms) div 2").alias("t_ms"))


POINTS = "pts AS (SELECT chunk_id, word_idx AS point_idx, (start_ms + end_ms) // 2 AS t_ms FROM words)"
add("c1_speaker_at", lambda s, d: joins.speaker_at(points(s, d), T.turns(s, d).where("turn_idx % 7 <> 3")),
    wt("turns", f"""+{POINTS}, tt AS (SELECT * FROM turns WHERE turn_idx % 7 <> 3), j AS (SELECT p.chunk_id, p.point_idx, t.speaker, t.turn_idx, greatest(start_ms - t_ms, t_ms - end_ms, 0) AS dist FROM pts p JOIN tt t USING (chunk_id))
      SELECT p.chunk_id, p.point_idx, coalesce(b.speaker, 'SPEAKER_00') AS speaker FROM pts p LEFT JOIN (SELECT chunk_id, point_idx, arg_min(speaker, dist * 1000000 + turn_idx) AS speaker FROM j GROUP BY 1, 2) b USING (chunk_id, point_idx)"""))
add("c1b_speaker_exact", lambda s, d: joins.speaker_at(points(s, d), T.turns(s, d).where("turn_idx % 7 <> 3"), fallback="unk"),
    wt("turns", f"""+{POINTS} SELECT p.chunk_id, p.point_idx, coalesce(arg_min(t.speaker, t.turn_idx), 'SPEAKER_UNK') AS speaker FROM pts p LEFT JOIN (SELECT * FROM turns WHERE turn_idx % 7 <> 3) t ON t.chunk_id = p.chunk_id AND t_ms BETWEEN start_ms AND end_ms GROUP BY 1, 2"""))
add("c2_words_in_segments", lambda s, d: joins.contained(T.words(s, d), T.segments(s, d)).select("l.chunk_id", "l.word_idx", "r.segment_id"),
    wt("segments", "SELECT w.chunk_id, w.word_idx, s.segment_id FROM words w JOIN segments s ON s.chunk_id = w.chunk_id AND w.start_ms >= s.start_ms AND w.end_ms <= s.end_ms"))
add("c3_overlap_majority", lambda s, d: joins.overlap_majority(T.segments(s, d).withColumn("end_ms", col("end_ms") + 2500), T.turns(s, d)),
    wt("segments", """+o AS (SELECT s.chunk_id, s.segment_id, t.speaker, CAST(sum(least(s.end_ms + 2500, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS BIGINT) AS overlap_ms FROM segments s JOIN turns t ON s.chunk_id = t.chunk_id AND least(s.end_ms + 2500, t.end_ms) > greatest(s.start_ms, t.start_ms) GROUP BY 1, 2, 3)
      SELECT chunk_id, segment_id, speaker, overlap_ms FROM o QUALIFY row_number() OVER (PARTITION BY chunk_id, segment_id ORDER BY overlap_ms DESC, speaker) = 1"""))
add("c4_uncovered", lambda s, d: joins.uncovered(T.speech(s, d), T.speech(s, d).where("speech_idx % 9 <> 4").withColumn("end_ms", F.when(col("speech_idx") % 5 == 0, F.expr("(start_ms + end_ms) div 2")).otherwise(col("end_ms")))),
    wt("speech", """+sg AS (SELECT chunk_id, start_ms, CASE WHEN speech_idx % 5 = 0 THEN (start_ms + end_ms) // 2 ELSE end_ms END AS end_ms FROM speech WHERE speech_idx % 9 <> 4)
      SELECT chunk_id, speech_idx, start_ms, end_ms FROM speech a WHERE NOT EXISTS (SELECT 1 FROM sg b WHERE a.chunk_id = b.chunk_id AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 0.5 * (a.end_ms - a.start_ms))"""))
CENTROIDS = """cw AS (SELECT *, max(end_ms - start_ms >= 500) OVER (PARTITION BY chunk_id, speaker) AS anyl, min(turn_idx) OVER (PARTITION BY chunk_id, speaker) AS ft FROM turn_vectors WHERE embedding IS NOT NULL),
  cu AS (SELECT chunk_id, speaker, unnest(embedding) AS x, unnest(range(0, 64)) AS dim FROM cw WHERE end_ms - start_ms >= 500 OR (NOT anyl AND turn_idx = ft)),
  cm AS (SELECT chunk_id, speaker, dim, avg(x) AS x FROM cu GROUP BY 1, 2, 3), cn AS (SELECT chunk_id, speaker, list(x ORDER BY dim) AS m FROM cm GROUP BY 1, 2),
  centroids AS (SELECT chunk_id, speaker, list_transform(m, lambda v: v / sqrt(list_dot_product(m, m))) AS centroid FROM cn)"""
add("d1_centroids", lambda s, d: speakers.speaker_centroids(T.turn_vectors(s, d)).select("chunk_id", "speaker", F.posexplode("centroid").alias("dim", "x")).select("chunk_id", "speaker", col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x")),
    wt("turn_vectors", f"+{CENTROIDS} SELECT chunk_id, speaker, unnest(range(0, len(centroid))) AS dim, round(unnest(centroid), 6) AS x FROM centroids"))
PAIRS = """cc AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n FROM centroids), pairs AS (SELECT a.chunk_id, a.speaker AS a, b.speaker AS b, list_dot_product(a.centroid, b.centroid) AS sim FROM cc a JOIN cc b ON a.chunk_id = b.chunk_id AND a.speaker < b.speaker
  WHERE list_dot_product(a.centroid, b.centroid) >= CASE WHEN a.n >= 3 THEN 0.5 ELSE 0.65 END)"""
add("c5_similar_pairs", lambda s, d: speakers.similar_pairs(speakers.speaker_centroids(T.turn_vectors(s, d))).withColumn("sim", F.round("sim", 6)), wt("turn_vectors", f"+{CENTROIDS}, {PAIRS} SELECT chunk_id, a, b, round(sim, 6) AS sim FROM pairs"))
add("c6_reassign_short", lambda s, d: speakers.reassign_short(T.turn_vectors(s, d), speakers.speaker_centroids(T.turn_vectors(s, d))),
    wt("turn_vectors", f"""+{CENTROIDS}, sc AS (SELECT t.chunk_id, t.turn_idx, c.speaker AS other, round(list_dot_product(t.embedding, c.centroid), 9) AS sim, c.speaker <> t.speaker AS off FROM turn_vectors t JOIN centroids c USING (chunk_id) WHERE t.end_ms - t.start_ms < 800 AND t.embedding IS NOT NULL),
      best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY chunk_id, turn_idx ORDER BY sim DESC, off, other) = 1) SELECT t.chunk_id, t.turn_idx, coalesce(b.other, t.speaker) AS speaker FROM turn_vectors t LEFT JOIN best b USING (chunk_id, turn_idx)"""))


def labels_of(s, d):
    c = speakers.speaker_centroids(T.turn_vectors(s, d))
    return speakers.canonical_labels(c.select("chunk_id", "speaker"), speakers.similar_pairs(c))


REACH = f"{CENTROIDS}, {PAIRS}, both_ways AS (SELECT chunk_id, a, b FROM pairs UNION SELECT chunk_id, b, a FROM pairs), reach AS (SELECT chunk_id, speaker AS a, speaker AS b FROM centroids UNION SELECT r.chunk_id, r.a, e.b FROM reach r JOIN both_ways e ON e.chunk_id = r.chunk_id AND e.a = r.b)"
add("d3_canonical_labels", labels_of, wt("turn_vectors", f"+{REACH} SELECT chunk_id, a AS speaker, min(b) AS canonical FROM reach GROUP BY 1, 2", recursive=True))
def labels_in_sql(s, d):
    c = staged(speakers.speaker_centroids(T.turn_vectors(s, d)), "centroids")
    return speakers.canonical_labels_in_sql(c.select("chunk_id", "speaker"), speakers.similar_pairs(c))


add("d3_canonical_labels_recursive", labels_in_sql, ORACLE_SQL["d3_canonical_labels"])
add("d4_dense_rename", lambda s, d: labels_of(s, d).select("chunk_id", "speaker", F.format_string("SPEAKER_%02d", F.dense_rank().over(W.partitionBy("chunk_id").orderBy("canonical")) - 1).alias("renamed")),
    wt("turn_vectors", f"+{REACH}, k AS (SELECT chunk_id, a AS speaker, min(b) AS canonical FROM reach GROUP BY 1, 2) SELECT chunk_id, speaker, printf('SPEAKER_%02d', dense_rank() OVER (PARTITION BY chunk_id ORDER BY canonical) - 1) AS renamed FROM k", recursive=True))


def merged_centroids(s, d):
    t = T.turn_vectors(s, d).where("embedding is not null").join(labels_of(s, d), ["chunk_id", "speaker"])
    return speakers.mean_vectors(t, ["chunk_id", "canonical"])


add("d2_merged_centroids", lambda s, d: merged_centroids(s, d).select("chunk_id", "canonical", F.posexplode("centroid").alias("dim", "x")).select("chunk_id", "canonical", col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x")),
    wt("turn_vectors", f"""+{REACH}, k AS (SELECT chunk_id, a AS speaker, min(b) AS canonical FROM reach GROUP BY 1, 2), mu AS (SELECT chunk_id, canonical, unnest(embedding) AS x, unnest(range(0, 64)) AS dim FROM turn_vectors JOIN k USING (chunk_id, speaker) WHERE embedding IS NOT NULL),
      mm AS (SELECT chunk_id, canonical, dim, avg(x) AS x FROM mu GROUP BY 1, 2, 3), ml AS (SELECT chunk_id, canonical, list(x ORDER BY dim) AS m FROM mm GROUP BY 1, 2) SELECT chunk_id, canonical, unnest(range(0, len(m))) AS dim, round(unnest(m) / sqrt(list_dot_product(m, m)), 6) AS x FROM ml""", recursive=True))
add("e4b_outlier_moves", lambda s, d: speakers.outlier_moves(T.turn_vectors(s, d), speakers.speaker_centroids(T.turn_vectors(s, d))),
    wt("turn_vectors", f"""+{CENTROIDS}, sc AS (SELECT t.chunk_id, t.turn_idx, t.speaker, c.speaker AS other, round(list_dot_product(t.embedding, c.centroid), 9) AS sim FROM turn_vectors t JOIN centroids c USING (chunk_id) WHERE t.embedding IS NOT NULL),
      g AS (SELECT chunk_id, turn_idx, speaker, coalesce(max(sim) FILTER (WHERE other = speaker), -1) AS own, coalesce(max(sim) FILTER (WHERE other <> speaker), -1) AS best, first(other ORDER BY sim DESC, other) FILTER (WHERE other <> speaker) AS bs FROM sc GROUP BY 1, 2, 3),
      st AS (SELECT *, CASE WHEN best > own AND best >= 0.65 THEN 'move' WHEN own < 0.55 AND best < 0.55 THEN 'new' ELSE 'keep' END AS state FROM g)
      SELECT chunk_id, turn_idx, state, CASE state WHEN 'move' THEN bs WHEN 'new' THEN printf('NEW_%02d', row_number() OVER (PARTITION BY chunk_id, state ORDER BY turn_idx)) ELSE speaker END AS speaker FROM st"""))
RASTER = """rf AS (SELECT chunk_id, turn_idx, speaker, unnest(range(start_ms * 25 // 1000, end_ms * 25 // 1000 + 1)) AS frame FROM face_turns), raster AS (SELECT chunk_id, frame, arg_max(speaker, turn_idx) AS speaker FROM rf GROUP BY 1, 2)"""

def chunk_frames(s, d):
    return T.face_frames(s, d).groupBy("chunk_id").agg((F.max("frame") + 1).alias("n_frames"))


SPINE = "nf AS (SELECT chunk_id, max(frame) + 1 AS n_frames FROM face_frames GROUP BY 1), spine AS (SELECT chunk_id, n_frames, unnest(range(0, n_frames)) AS frame FROM nf)"
add("c8_rasterise", lambda s, d: joins.rasterise(T.face_turns(s, d), 25, chunk_frames(s, d)), wt("face_frames face_turns", f"+{RASTER}, {SPINE} SELECT chunk_id, frame, speaker FROM spine LEFT JOIN raster USING (chunk_id, frame)"))


def frame_targets(s, d):
    """Best face over -.5 of each frame in which someone speaks."""
    best = T.face_frames(s, d).where("score > -0.5").groupBy("chunk_id", "frame").agg(F.max_by("track", F.struct("score", -col("track"))).alias("track"))
    return joins.rasterise(T.face_turns(s, d), 25).join(best, ["chunk_id", "frame"]).select("chunk_id", "frame", "speaker", "track")


TARGETS = RASTER + ", targets AS (SELECT r.chunk_id, r.frame, r.speaker, b.track FROM raster r JOIN (SELECT chunk_id, frame, track FROM face_frames WHERE score > -0.5 QUALIFY row_number() OVER (PARTITION BY chunk_id, frame ORDER BY score DESC, track) = 1) b USING (chunk_id, frame))"
add("f2_frame_targets", frame_targets, wt("face_frames face_turns", f"+{TARGETS} SELECT chunk_id, frame, speaker, track FROM targets"))


def face_counts(s, d):
    return frame_targets(s, d).groupBy("chunk_id", "speaker", "track").agg(F.count("*").alias("n"))


COUNTS = TARGETS + ", fcounts AS (SELECT chunk_id, speaker, track, count(*) AS n FROM targets GROUP BY 1, 2, 3)"
add("d6_face_contingency", lambda s, d: face_counts(s, d).where("n >= 5").groupBy("chunk_id", "speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-col("n")).alias("o"), "track"))), lambda x: x["track"].cast("string")), ",").alias("tracks")),
    wt("face_frames face_turns", f"+{COUNTS} SELECT chunk_id, speaker, string_agg(CAST(track AS VARCHAR), ',' ORDER BY n DESC, track) AS tracks FROM fcounts WHERE n >= 5 GROUP BY 1, 2"))


def shared_faces(s, d):
    c = staged(face_counts(s, d), "face-counts")
    t = c.groupBy("chunk_id", "speaker").agg(F.sum("n").alias("total"))
    both = c.select("chunk_id", "track", col("speaker").alias("a"), col("n").alias("na")).join(c.select("chunk_id", "track", col("speaker").alias("b"), col("n").alias("nb")), ["chunk_id", "track"]).where("a < b")
    shared = both.groupBy("chunk_id", "a", "b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    named = lambda k: t.select("chunk_id", col("speaker").alias(k), col("total").alias(f"t{k}"))
    share = F.least(col("shared") / col("ta"), col("shared") / col("tb"))
    return shared.join(named("a"), ["chunk_id", "a"]).join(named("b"), ["chunk_id", "b"]).where((col("shared") >= 10) & (share >= 0.3)).select("chunk_id", "a", "b", "shared", F.round(share, 6).alias("share"))


SHARED = f"""{COUNTS}, ft AS (SELECT chunk_id, speaker, sum(n) AS t FROM fcounts GROUP BY 1, 2), sh AS (SELECT x.chunk_id, x.speaker AS a, y.speaker AS b, CAST(sum(least(x.n, y.n)) AS BIGINT) AS shared FROM fcounts x JOIN fcounts y ON x.chunk_id = y.chunk_id AND x.track = y.track AND x.speaker < y.speaker GROUP BY 1, 2, 3),
  merges AS (SELECT sh.chunk_id, a, b, shared, round(least(shared / p.t, shared / q.t), 6) AS share FROM sh JOIN ft p ON p.chunk_id = sh.chunk_id AND p.speaker = a JOIN ft q ON q.chunk_id = sh.chunk_id AND q.speaker = b WHERE shared >= 10 AND least(shared / p.t, shared / q.t) >= 0.3)"""
add("c9_face_merge_pairs", shared_faces, wt("face_frames face_turns", f"+{SHARED} SELECT * FROM merges"))


def face_merged_turns(s, d):
    """Turns of speakers that share a face take the smallest label among them, however long the chain; others keep theirs."""
    t = T.face_turns(s, d)
    same = speakers.canonical_labels(t.select("chunk_id", "speaker").distinct(), shared_faces(s, d))
    return t.join(same, ["chunk_id", "speaker"]).select("chunk_id", "turn_idx", col("canonical").alias("speaker"), "start_ms", "end_ms")


add("c9_face_merged_turns", face_merged_turns, wt("face_frames face_turns", f"""+{SHARED}, ways AS (SELECT chunk_id, a, b FROM merges UNION SELECT chunk_id, b, a FROM merges),
  met AS (SELECT DISTINCT chunk_id, speaker AS a, speaker AS b FROM face_turns UNION SELECT m.chunk_id, m.a, w.b FROM met m JOIN ways w ON w.chunk_id = m.chunk_id AND w.a = m.b)
  SELECT t.chunk_id, t.turn_idx, min(m.b) AS speaker, t.start_ms, t.end_ms FROM face_turns t JOIN met m ON m.chunk_id = t.chunk_id AND m.a = t.speaker GROUP BY ALL""", recursive=True))
add("d7_spurious_speakers", lambda s, d: T.face_turns(s, d).groupBy("chunk_id", "speaker").agg(F.sum(col("end_ms") - col("start_ms")).alias("total_ms")).where("total_ms < 600").join(face_counts(s, d).where("n >= 5"), ["chunk_id", "speaker"], "left_anti"),
    wt("face_frames face_turns", f"+{COUNTS} SELECT chunk_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM face_turns t WHERE NOT EXISTS (SELECT 1 FROM fcounts c WHERE c.chunk_id = t.chunk_id AND c.speaker = t.speaker AND n >= 5) GROUP BY 1, 2 HAVING sum(end_ms - start_ms) < 600"))
add("c13_snap", lambda s, d: joins.snap(T.turns(s, d).select("chunk_id", col("turn_idx").alias("point_idx"), (col("start_ms") + 777).alias("t_ms")), T.words(s, d), T.word_parts(T.table(s, d, "conversations"))),
    wt("turns", """+e AS (SELECT chunk_id, word_idx * 2 AS i, start_ms AS at FROM words UNION ALL SELECT chunk_id, word_idx * 2 + 1, end_ms FROM words)
      SELECT t.chunk_id, t.turn_idx AS point_idx, coalesce(arg_min(e.at, abs(e.at - t.start_ms - 777) * 10000000 + e.i), t.start_ms + 777) AS t_ms FROM turns t LEFT JOIN e USING (chunk_id) GROUP BY t.chunk_id, t.turn_idx, t.start_ms"""))
add("c18_drop_speakers", lambda s, d: T.face_turns(s, d).join(QUERIES["d7_spurious_speakers"](s, d).select("chunk_id", "speaker"), ["chunk_id", "speaker"], "left_anti").select("chunk_id", "turn_idx", "speaker"),
    wt("face_frames face_turns", f"+{COUNTS}, sps AS (SELECT chunk_id, speaker FROM face_turns t WHERE NOT EXISTS (SELECT 1 FROM fcounts c WHERE c.chunk_id = t.chunk_id AND c.speaker = t.speaker AND n >= 5) GROUP BY 1, 2 HAVING sum(end_ms - start_ms) < 600) SELECT chunk_id, turn_idx, speaker FROM face_turns t WHERE NOT EXISTS (SELECT 1 FROM sps WHERE sps.chunk_id = t.chunk_id AND sps.speaker = t.speaker)"))
add("c19_relabel", lambda s, d: T.turn_vectors(s, d).join(labels_of(s, d), ["chunk_id", "speaker"], "left").select("chunk_id", "turn_idx", F.coalesce("canonical", "speaker").alias("speaker")),
    wt("turn_vectors", f"+{REACH}, k AS (SELECT chunk_id, a AS speaker, min(b) AS canonical FROM reach GROUP BY 1, 2) SELECT t.chunk_id, t.turn_idx, coalesce(k.canonical, t.speaker) AS speaker FROM turn_vectors t LEFT JOIN k USING (chunk_id, speaker)", recursive=True))
add("c24_propagate_labels", lambda s, d: joins.nearest_label(T.turns(s, d).where("end_ms - start_ms < 20000").select("chunk_id", "turn_idx", "start_ms"), T.turns(s, d).where("end_ms - start_ms >= 20000"), "start_ms", "turn_idx"),
    wt("turns", "SELECT a.chunk_id, a.turn_idx, a.start_ms, arg_min(b.speaker, abs(a.start_ms - b.start_ms) * 1000000 + b.turn_idx) AS label FROM turns a JOIN turns b ON a.chunk_id = b.chunk_id AND b.end_ms - b.start_ms >= 20000 WHERE a.end_ms - a.start_ms < 20000 GROUP BY 1, 2, 3"))

# Sequences
COLLAPSE = """q AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY turn_idx) AS rn FROM src), fold AS (SELECT chunk_id, rn, turn_idx AS head, speaker, start_ms, end_ms FROM q WHERE rn = 1
  UNION ALL SELECT q.chunk_id, q.rn, CASE WHEN q.speaker = f.speaker AND q.start_ms - f.end_ms < 300 THEN f.head ELSE q.turn_idx END, q.speaker, CASE WHEN q.speaker = f.speaker AND q.start_ms - f.end_ms < 300 THEN f.start_ms ELSE q.start_ms END,
    CASE WHEN q.speaker = f.speaker AND q.start_ms - f.end_ms < 300 THEN greatest(f.end_ms, q.end_ms) ELSE q.end_ms END FROM fold f JOIN q ON q.chunk_id = f.chunk_id AND q.rn = f.rn + 1)"""
add("e2_collapse_turns", lambda s, d: sequences.collapse_turns(T.face_turns(s, d).withColumn("speaker", F.concat(F.lit("S"), F.expr("turn_idx div 3")))),
    wt("face_turns", f"+src AS (SELECT chunk_id, turn_idx, 'S' || (turn_idx // 3) AS speaker, start_ms, end_ms FROM face_turns), {COLLAPSE} SELECT chunk_id, head AS turn_idx, speaker, start_ms, max(end_ms) AS end_ms FROM fold GROUP BY chunk_id, head, speaker, start_ms", recursive=True))
add("e3_absorb_short", lambda s, d: sequences.absorb_short(T.face_turns(s, d), 900), wt("face_turns", """+h AS (SELECT *, end_ms - start_ms >= 900 OR row_number() OVER (PARTITION BY chunk_id ORDER BY turn_idx) = 1 AS head FROM face_turns), i AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY chunk_id ORDER BY turn_idx) AS isle FROM h)
  SELECT chunk_id, min(turn_idx) AS turn_idx, arg_min(speaker, turn_idx) AS speaker, arg_min(start_ms, turn_idx) AS start_ms, arg_max(end_ms, turn_idx) AS end_ms FROM i GROUP BY chunk_id, isle"""))
BLOCK_ROWS = 1000  # so that chunks of the given tables are cut; a cluster takes more
GAPS = """gf AS (SELECT chunk_id, word_idx, CAST(0 AS BIGINT) AS segment, start_ms AS s, end_ms AS e FROM words WHERE word_idx = 0
  UNION ALL SELECT w.chunk_id, w.word_idx, CASE WHEN br THEN segment + 1 ELSE segment END, CASE WHEN br THEN w.start_ms ELSE s END, w.end_ms FROM (SELECT w.*, g.segment, g.s, w.start_ms - g.e > 1500 OR (w.start_ms - g.e > 400 AND g.e - g.s >= 3000) OR g.e - g.s >= 15000 AS br FROM gf g JOIN words w ON w.chunk_id = g.chunk_id AND w.word_idx = g.word_idx + 1) w)"""
add("e5_gap_segments", lambda s, d: sequences.gap_segments(T.words(s, d)), wt("words", f"+{GAPS} SELECT chunk_id, word_idx, segment FROM gf", recursive=True))
add("e6_punct_segments", lambda s, d: sequences.punct_segments(T.words(s, d)), wt("words", """+pf AS (SELECT chunk_id, word_idx, CAST(0 AS BIGINT) AS segment, start_ms AS s, 1 AS n, right(word, 1) IN ('.', '?', '!') OR end_ms - start_ms >= 12000 AS stop FROM words WHERE word_idx = 0
  UNION ALL SELECT w.chunk_id, w.word_idx, CASE WHEN p.stop THEN p.segment + 1 ELSE p.segment END, CASE WHEN p.stop THEN w.start_ms ELSE p.s END, CASE WHEN p.stop THEN 1 ELSE p.n + 1 END,
    right(w.word, 1) IN ('.', '?', '!') OR w.end_ms - CASE WHEN p.stop THEN w.start_ms ELSE p.s END >= 12000 OR CASE WHEN p.stop THEN 1 ELSE p.n + 1 END >= 30 FROM pf p JOIN words w ON w.chunk_id = p.chunk_id AND w.word_idx = p.word_idx + 1) SELECT chunk_id, word_idx, segment FROM pf""", recursive=True))
add("e5_gap_segments_split", lambda s, d: split.gap_segments(T.words(s, d), block_rows=BLOCK_ROWS), ORACLE_SQL["e5_gap_segments"])
add("e6_punct_segments_split", lambda s, d: split.punct_segments(T.words(s, d), block_rows=BLOCK_ROWS), ORACLE_SQL["e6_punct_segments"])
add("e9_merge_short", lambda s, d: sequences.merge_short(T.speech(s, d).withColumnRenamed("speech_idx", "group_idx")), wt("speech", """+mf AS (SELECT chunk_id, speech_idx AS i, speech_idx AS group_idx, start_ms AS s, end_ms AS e, 1 AS n FROM speech WHERE speech_idx = 0
  UNION ALL SELECT chunk_id, i, CASE WHEN j THEN group_idx ELSE i END, CASE WHEN j THEN s ELSE start_ms END, end_ms, CASE WHEN j THEN n + 1 ELSE 1 END FROM (SELECT x.chunk_id, x.speech_idx AS i, m.group_idx, m.s, m.n, x.start_ms, x.end_ms, (m.e - m.s < 1500 OR x.end_ms - x.start_ms < 1500) AND x.end_ms - m.s <= 12000 AS j FROM mf m JOIN speech x ON x.chunk_id = m.chunk_id AND x.speech_idx = m.i + 1))
  SELECT chunk_id, group_idx, min(s) AS start_ms, max(e) AS end_ms, CAST(max(n) AS BIGINT) AS n FROM mf GROUP BY 1, 2""", recursive=True))
ABA = "CASE WHEN (chunk_id * 5 + word_idx * word_idx) % 7 < 3 THEN 'A' WHEN (chunk_id * 5 + word_idx * word_idx) % 7 < 6 THEN 'B' ELSE 'C' END"
add("e10_smooth_aba", lambda s, d: sequences.smooth_aba(T.words(s, d).withColumn("speaker", F.expr(ABA)), "word_idx"), wt("words", f"""+l AS (SELECT chunk_id, word_idx, {ABA} AS raw, lead({ABA}) OVER (PARTITION BY chunk_id ORDER BY word_idx) AS nxt FROM words),
  sf AS (SELECT chunk_id, word_idx, raw AS speaker FROM l WHERE word_idx = 0 UNION ALL SELECT l.chunk_id, l.word_idx, CASE WHEN l.nxt = s.speaker THEN s.speaker ELSE l.raw END FROM sf s JOIN l ON l.chunk_id = s.chunk_id AND l.word_idx = s.word_idx + 1) SELECT * FROM sf""", recursive=True))
add("e10_smooth_aba_split", lambda s, d: split.smooth_aba(T.words(s, d).withColumn("speaker", F.expr(ABA)), "word_idx", block_rows=BLOCK_ROWS), ORACLE_SQL["e10_smooth_aba"])
add("e17_smooth_runs", lambda s, d: sequences.smooth_runs(T.words(s, d).withColumn("speaker", F.expr(ABA)), "word_idx"), wt("words", f"""+l AS (SELECT chunk_id, word_idx, {ABA} AS raw FROM words), n AS (SELECT *, CASE WHEN raw = lag(raw) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY chunk_id ORDER BY word_idx)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY chunk_id ORDER BY word_idx) AS run, count(*) OVER (PARTITION BY chunk_id) AS total FROM n), q AS (SELECT chunk_id, run, any_value(raw) AS raw, count(*) AS size, any_value(total) AS total FROM r GROUP BY 1, 2),
  sm AS (SELECT q.chunk_id, q.run, CASE WHEN q.total < 4 OR q.size >= 2 THEN q.raw ELSE coalesce(x.raw, q.raw) END AS speaker FROM q LEFT JOIN q x ON x.chunk_id = q.chunk_id AND x.run = 2 WHERE q.run = 1
    UNION ALL SELECT q.chunk_id, q.run, CASE WHEN q.total < 4 OR q.size >= 2 THEN q.raw ELSE sm.speaker END FROM sm JOIN q ON q.chunk_id = sm.chunk_id AND q.run = sm.run + 1)
  SELECT r.chunk_id, r.word_idx, sm.speaker FROM r JOIN sm USING (chunk_id, run)""", recursive=True))
PART_SQL = f"""l AS (SELECT chunk_id, word_idx, turn, {ABA} AS raw, row_number() OVER t AS i, lead({ABA}) OVER t AS nxt FROM words WINDOW t AS (PARTITION BY chunk_id, turn ORDER BY word_idx)),
  sf AS (SELECT chunk_id, turn, word_idx, i, raw AS speaker FROM l WHERE i = 1 UNION ALL SELECT l.chunk_id, l.turn, l.word_idx, l.i, CASE WHEN l.nxt = s.speaker THEN s.speaker ELSE l.raw END FROM sf s JOIN l ON l.chunk_id = s.chunk_id AND l.turn = s.turn AND l.i = s.i + 1),
  ch AS (SELECT *, coalesce(CASE WHEN turn <> lag(turn) OVER w OR speaker <> lag(speaker) OVER w THEN 1 ELSE 0 END, 0) AS new FROM sf WINDOW w AS (PARTITION BY chunk_id ORDER BY turn, word_idx))"""
add("e10_split_by_speaker", lambda s, d: sequences.split_by_speaker(T.words(s, d).withColumn("speaker", F.expr(ABA)), "turn"),
    wt("words", f"+{PART_SQL} SELECT chunk_id, word_idx, speaker, CAST(sum(new) OVER (PARTITION BY chunk_id ORDER BY turn, word_idx) AS BIGINT) AS part FROM ch", recursive=True))
add("e11_synth_groups", lambda s, d: sequences.synth_groups(T.segments(s, d).withColumn("emotion", F.lit("Neutral")).withColumn("speaker", F.expr("CASE WHEN segment_id % 3 = 0 THEN 'A' ELSE 'B' END")).withColumn("start_ms", F.expr("start_ms - 900"))).select("chunk_id", "segment_id", "group_idx"),
    wt("segments", """+g AS (SELECT chunk_id, segment_id, start_ms - 900 AS s, end_ms AS e, CASE WHEN segment_id % 3 = 0 THEN 'A' ELSE 'B' END AS sp FROM segments), n AS (SELECT *, CASE WHEN sp = lag(sp) OVER w AND s - lag(e) OVER w < 300 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY chunk_id ORDER BY segment_id))
      SELECT chunk_id, segment_id, CAST(sum(new) OVER (PARTITION BY chunk_id ORDER BY segment_id) AS BIGINT) - 1 AS group_idx FROM n"""))
add("e12_slot_limits", lambda s, d: sequences.slot_limits(T.segments(s, d), "segment_id").select("chunk_id", "segment_id", "slot_ms"), wt("segments", "SELECT chunk_id, segment_id, greatest(100, coalesce(lead(start_ms) OVER (PARTITION BY chunk_id ORDER BY segment_id), max(end_ms) OVER (PARTITION BY chunk_id)) - start_ms - 50) AS slot_ms FROM segments"))
def shown(s, d):
    """The face in front of each frame: two faces in turn for sixty frames, then a third for sixty."""
    best = T.face_frames(s, d).groupBy("chunk_id", "frame").agg(F.max_by("track", F.struct("score", -col("track"))).alias("track"))
    return best.withColumn("track", F.expr("CASE WHEN frame % 120 < 60 THEN track % 2 ELSE 3 END"))


add("e13_face_changes", lambda s, d: sequences.face_changes(shown(s, d), 8, 500), wt("face_frames", """+b AS (SELECT chunk_id, frame, CASE WHEN frame % 120 < 60 THEN track % 2 ELSE 3 END AS face FROM face_frames QUALIFY row_number() OVER (PARTITION BY chunk_id, frame ORDER BY score DESC, track) = 1),
  q AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY frame) AS i FROM b),
  st AS (SELECT chunk_id, i, frame AS since, CAST(NULL AS BIGINT) AS held, face AS cand, frame AS begun, 1 AS n, false AS hit, CAST(NULL AS BIGINT) AS hit_frame, face AS hit_face FROM q WHERE i = 1
    UNION ALL SELECT chunk_id, i, CASE WHEN hit THEN begun2 ELSE since END, CASE WHEN n2 >= 4 THEN face ELSE held END, CASE WHEN n2 >= 4 THEN NULL ELSE cand2 END, begun2, CASE WHEN n2 >= 4 THEN 0 ELSE n2 END, hit, CASE WHEN hit THEN begun2 END, face
    FROM (SELECT *, n2 >= 4 AND held IS NOT NULL AND begun2 - since >= 4 AS hit FROM (SELECT q.chunk_id, q.i, q.face, s.since, s.held,
      CASE WHEN q.face = s.held THEN s.cand ELSE q.face END AS cand2, CASE WHEN q.face = s.held OR q.face = s.cand THEN s.begun ELSE q.frame END AS begun2, CASE WHEN q.face = s.held THEN 0 WHEN q.face = s.cand THEN s.n + 1 ELSE 1 END AS n2
      FROM st s JOIN q ON q.chunk_id = s.chunk_id AND q.i = s.i + 1)))
  SELECT chunk_id, hit_frame AS frame, hit_face AS track FROM st WHERE hit""", recursive=True))
add("e15_trim_short", lambda s, d: sequences.trim_short(T.segments(s, d), T.words(s, d)), wt("segments", """+w AS (SELECT chunk_id, turn, min(start_ms) AS ws, max(end_ms) AS we, count(*) AS n FROM words GROUP BY 1, 2),
  x AS (SELECT s.chunk_id, s.segment_id, s.start_ms, s.end_ms, ws, we, coalesce(n <= 3 AND s.end_ms - s.start_ms >= 5000 AND we - ws >= 1000, false) AS trim FROM segments s LEFT JOIN w ON w.chunk_id = s.chunk_id AND w.turn = s.segment_id)
  SELECT chunk_id, segment_id, CASE WHEN trim THEN greatest(start_ms, ws - 200) ELSE start_ms END AS start_ms, CASE WHEN trim THEN least(end_ms, we + 200) ELSE end_ms END AS end_ms FROM x"""))
add("e16_sliding", lambda s, d: sequences.sliding(T.segments(s, d)), wt("segments", "SELECT chunk_id, segment_id, unnest(range(start_ms, end_ms - 600 + 1, 200)) AS t_ms FROM segments WHERE end_ms - start_ms >= 600"))


def odd_turns(s, d):
    return T.face_turns(s, d).withColumnRenamed("turn_idx", "segment_id").withColumn("speaker", F.when(col("segment_id") % 4 == 2, "SPEAKER_95").otherwise(col("speaker")))


add("e19_absorb_outliers", lambda s, d: sequences.absorb_outliers(odd_turns(s, d), 1500), wt("face_turns", """+x AS (SELECT chunk_id, turn_idx AS i, CASE WHEN turn_idx % 4 = 2 THEN 'SPEAKER_95' ELSE speaker END AS speaker, start_ms, end_ms FROM face_turns),
  y AS (SELECT *, speaker = 'SPEAKER_95' AS odd, first_value(CASE WHEN speaker <> 'SPEAKER_95' THEN start_ms END IGNORE NULLS) OVER a AS ns, first_value(CASE WHEN speaker <> 'SPEAKER_95' THEN speaker END IGNORE NULLS) OVER a AS nl FROM x WINDOW a AS (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  f AS (SELECT chunk_id, i, speaker, CASE WHEN NOT odd THEN end_ms END AS le, CASE WHEN NOT odd THEN speaker END AS ll FROM y WHERE i = 0
    UNION ALL SELECT chunk_id, i, l, CASE WHEN main THEN end_ms ELSE le END, CASE WHEN main THEN l ELSE ll END FROM (SELECT *, NOT odd OR take AS main,
      CASE WHEN NOT take THEN speaker WHEN ll IS NULL THEN nl WHEN nl IS NULL THEN ll WHEN abs(start_ms - le) <= abs(ns - end_ms) THEN ll ELSE nl END AS l
      FROM (SELECT y.*, f.le, f.ll, y.odd AND y.end_ms - y.start_ms < 1500 AND (f.ll IS NOT NULL OR y.nl IS NOT NULL) AS take FROM f JOIN y ON y.chunk_id = f.chunk_id AND y.i = f.i + 1)))
  SELECT chunk_id, i AS segment_id, speaker FROM f""", recursive=True))
add("e20_chunk_offsets", lambda s, d: T.turns(s, d).groupBy("chunk_id").agg(F.max("end_ms").alias("dur")).withColumn("hour", F.expr("chunk_id div 20")).withColumn("offset_ms", F.coalesce(F.sum("dur").over(W.partitionBy("hour").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))),
    wt("turns", "SELECT chunk_id, dur, chunk_id // 20 AS hour, CAST(coalesce(sum(dur) OVER (PARTITION BY chunk_id // 20 ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM (SELECT chunk_id, max(end_ms) AS dur FROM turns GROUP BY 1)"))
add("e21_fixed_chunks", lambda s, d: T.words(s, d).withColumn("whole", F.max("end_ms").over(W.partitionBy("chunk_id")) <= 300000).select("chunk_id", "word_idx", F.when(col("whole"), 0).otherwise(F.expr("start_ms div 60000")).cast("long").alias("part")),
    wt("words", "SELECT chunk_id, word_idx, CASE WHEN max(end_ms) OVER (PARTITION BY chunk_id) <= 300000 THEN 0 ELSE start_ms // 60000 END AS part FROM words"))
add("e22_silence_cuts", lambda s, d: sequences.silence_cuts(T.speech(s, d), 30000), wt("speech", """+tot AS (SELECT chunk_id, max(end_ms) AS total FROM speech GROUP BY 1), gp AS (SELECT chunk_id, end_ms AS a, lead(start_ms) OVER (PARTITION BY chunk_id ORDER BY start_ms, speech_idx) AS b FROM speech),
  near AS (SELECT chunk_id, a, b FROM gp WHERE b > a),
  ct AS (SELECT chunk_id, total, CAST(0 AS BIGINT) AS cut_idx, CAST(30000 AS BIGINT) AS target FROM tot WHERE total > 30000
    UNION ALL SELECT chunk_id, total, cut_idx + 1, target + 30000 FROM (SELECT c.chunk_id, c.total, c.cut_idx, coalesce((SELECT arg_max((a + b) // 2, (b - a) * 100000000 - a) FROM near g WHERE g.chunk_id = c.chunk_id AND g.a >= c.target - 5000 AND g.b <= least(c.target + 5000, c.total - 1000)), c.target) AS target FROM ct c) WHERE target + 30000 < total),
  cuts AS (SELECT chunk_id, cut_idx, coalesce((SELECT arg_max((a + b) // 2, (b - a) * 100000000 - a) FROM near g WHERE g.chunk_id = c.chunk_id AND g.a >= c.target - 5000 AND g.b <= least(c.target + 5000, c.total - 1000)), c.target) AS cut_ms FROM ct c)
  SELECT chunk_id, cut_idx, cut_ms FROM cuts""", recursive=True))
add("e23_pingpong", lambda s, d: sequences.pingpong(T.turns(s, d).select("chunk_id", col("turn_idx").cast("int").alias("i"), "speaker"), "chunk_id", "i", 12).select("chunk_id", "pos", col("i").cast("int").alias("i"), "speaker"),
    wt("turns", "SELECT n.chunk_id, CAST(p AS INTEGER) AS pos, CAST(i AS INTEGER) AS i, t.speaker FROM (SELECT chunk_id, p, CASE WHEN p % (2 * n) < n THEN p % (2 * n) ELSE 2 * n - 1 - p % (2 * n) END AS i FROM (SELECT chunk_id, count(*) AS n FROM turns GROUP BY 1), (SELECT unnest(range(0, 12)) AS p)) n JOIN turns t ON t.chunk_id = n.chunk_id AND t.turn_idx = n.i"))
def place_clips(s, d):
    """In each tenth of a second of a chunk's video the clip laid down last; clips end where the video ends."""
    length = T.face_frames(s, d).groupBy("chunk_id").agg(((F.max("frame") + 1) * 40).alias("video_ms"))
    last = F.expr("least(end_ms, video_ms - 1) div 100")
    x = T.face_turns(s, d).join(length, "chunk_id").where("start_ms < video_ms")
    return x.select("chunk_id", "turn_idx", F.explode(F.sequence(F.expr("start_ms div 100"), last)).alias("bin")).groupBy("chunk_id", "bin").agg(F.max("turn_idx").alias("clip"))


add("e24_place_clips", place_clips, wt("face_frames face_turns", """+v AS (SELECT chunk_id, (max(frame) + 1) * 40 AS video_ms FROM face_frames GROUP BY 1)
  SELECT chunk_id, CAST(bin AS BIGINT) AS bin, max(turn_idx) AS clip FROM (SELECT chunk_id, turn_idx, unnest(range(start_ms // 100, least(end_ms, video_ms - 1) // 100 + 1)) AS bin FROM face_turns JOIN v USING (chunk_id) WHERE start_ms < video_ms) GROUP BY 1, 2"""))
add("e25_best_attempt", lambda s, d: T.attempts(s, d).groupBy("chunk_id", "segment_id").agg(F.min(F.when(col("score") >= 3.5, col("attempt"))).alias("good"), F.max_by("attempt", F.struct("score", -col("attempt"))).alias("best")).select("chunk_id", "segment_id", F.coalesce("good", "best").alias("attempt")),
    wt("attempts", "SELECT chunk_id, segment_id, coalesce(min(attempt) FILTER (WHERE score >= 3.5), first(attempt ORDER BY score DESC, attempt)) AS attempt FROM attempts GROUP BY 1, 2"))
add("e26_every_kth", lambda s, d: T.samples(s, d).where("idx % 20 = 0"), wt("samples", "SELECT * FROM samples WHERE idx % 20 = 0"))
add("e27_batches", lambda s, d: T.segments(s, d).where(text.is_dialogue(col("text"))).withColumn("r", F.row_number().over(W.partitionBy("chunk_id").orderBy("segment_id")) - 1).select("chunk_id", "segment_id", F.expr("r div 7").alias("batch"), (col("r") % 7).cast("long").alias("slot")),
    wt("segments", "SELECT chunk_id, segment_id, r // 7 AS batch, r % 7 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY segment_id) - 1 AS r FROM segments)"))
def crowd(s, d):
    """Boxes of twenty frames taken as one, pushed together, so that many overlap."""
    x = T.face_frames(s, d).select("chunk_id", F.expr("frame div 20").alias("frame"), (col("track") * 1000 + col("frame")).alias("track"), "x1", "y1", "x2", "y2", "score")
    return x.select("chunk_id", "frame", "track", (col("x1") * 0.2).alias("x1"), (col("y1") * 0.2).alias("y1"), (col("x1") * 0.2 + col("x2") - col("x1")).alias("x2"), (col("y1") * 0.2 + col("y2") - col("y1")).alias("y2"), "score")


IOU_SQL = "greatest(0, least(q.x2, k.x2) - greatest(q.x1, k.x1)) * greatest(0, least(q.y2, k.y2) - greatest(q.y1, k.y1))"
add("f5_nms", lambda s, d: sequences.nms(crowd(s, d)), wt("face_frames", f"""+c AS (SELECT chunk_id, frame // 20 AS frame, track * 1000 + frame AS track, x1 * 0.2 AS x1, y1 * 0.2 AS y1, x1 * 0.2 + x2 - x1 AS x2, y1 * 0.2 + y2 - y1 AS y2, score FROM face_frames),
  q AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, frame ORDER BY score DESC, track) AS i, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS q FROM c),
  f AS (SELECT chunk_id, frame, i, track, [q] AS kept, true AS stays FROM q WHERE i = 1 UNION ALL SELECT chunk_id, frame, i, track, CASE WHEN stays THEN list_append(kept, q) ELSE kept END, stays FROM (SELECT q.chunk_id, q.frame, q.i, q.track, f.kept, q.q,
    len(list_filter(f.kept, lambda k: {IOU_SQL.replace('q.', 'q.q.')} > 0.3 * ((q.q.x2 - q.q.x1) * (q.q.y2 - q.q.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - {IOU_SQL.replace('q.', 'q.q.')}))) = 0 AS stays FROM f JOIN q ON q.chunk_id = f.chunk_id AND q.frame = f.frame AND q.i = f.i + 1))
  SELECT chunk_id, frame, track FROM f WHERE stays""", recursive=True))
