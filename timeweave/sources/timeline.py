"""Timeline tables derived from the given parquet tables; every time is a whole number of milliseconds.

Each function reads (spark, sf_dir) whole tables. TABLE_SQL has the same derivations in standard SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD_PARTS = 16  # partitions of words for each one of the table that their texts come from: words take many times its bytes


def word_parts(conversations: DataFrame) -> int:
    """Partitions that rows of words need: they grow with the table, so that what a task sorts does not."""
    return WORD_PARTS * max(1, conversations.rdd.getNumPartitions())


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words of conversations: chunk_id, word_idx, word, turn, start_ms, end_ms."""
    source = table(spark, sf_dir, "conversations")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    tokens = source.select(F.col("conv_id").cast("long").alias("chunk_id"), F.col("turn").cast("long").alias("turn"), "text").repartition(word_parts(source), "chunk_id")
    tokens = tokens.select("chunk_id", "turn", F.posexplode(F.split(text, " ")).alias("pos", "word")).where("word <> ''")
    order = W.partitionBy("chunk_id").orderBy("turn", "pos")
    i, c, p = F.col("word_idx"), F.col("chunk_id"), F.col("pos")
    timed = tokens.withColumn("word_idx", F.row_number().over(order).cast("long") - 1)
    dur = F.when((i * 7 + c) % 97 == 0, 3500).when((i + c) % 101 == 1, 10).otherwise(80 * F.length("word"))
    gap = 40 + (i * 37 + c * 11) % 300 + F.when(p == 0, 600).otherwise(0) + F.when((p == 0) & (F.col("turn") % 3 == 0), 1600).otherwise(0)
    ends = timed.withColumn("dur", dur.cast("long")).withColumn("gap", gap.cast("long")).withColumn("end_ms", F.sum(F.col("dur") + F.col("gap")).over(order))
    return ends.select("chunk_id", "word_idx", "word", "turn", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: chunk_id, turn_idx, speaker, start_ms, end_ms; odd turns start 100 ms early and may overlap."""
    return turns_of(spark, sf_dir, words(spark, sf_dir))


def turns_of(spark: SparkSession, sf_dir: str, timed: DataFrame) -> DataFrame:
    spans = timed.groupBy("chunk_id", "turn").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("end_ms"))
    roles = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("chunk_id"), F.col("turn").cast("long").alias("turn"), "role")
    speaker = F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01").otherwise("SPEAKER_02")
    return spans.join(roles, ["chunk_id", "turn"]).select("chunk_id", F.col("turn").alias("turn_idx"), speaker.alias("speaker"), (F.col("s") - 100 * (F.col("turn") % 2)).alias("start_ms"), "end_ms")


EMOTIONS = ["Neutral", "Happy", "Sad", "Angry", "Surprised", "Scared"]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment a turn with derived emotion, scores, translation and quality."""
    t = turns(spark, sf_dir)
    text = words(spark, sf_dir).groupBy("chunk_id", F.col("turn").alias("turn_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("text"), F.count("*").alias("n_words"))
    c, i = F.col("chunk_id"), F.col("turn_idx")
    emotion = F.element_at(F.array(*map(F.lit, EMOTIONS)), ((c * 7 + i * 3) % 6 + 1).cast("int"))
    return t.join(text, ["chunk_id", "turn_idx"]).select(
        "chunk_id", F.col("turn_idx").alias("segment_id"), "speaker", "start_ms", "end_ms", "text", "n_words", emotion.alias("emotion"),
        (((c * 13 + i * 29) % 1000) / 1000.0).alias("emotion_score"), (1 + ((c * 17 + i * 31) % 400) / 100.0).alias("tts_mos"),
        F.when((c + i) % 5 == 0, "").otherwise(F.concat(F.lit("번역 "), "text")).alias("translated"), ((c + i) % 4 == 0).alias("was_split"),
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of words less than 500 ms apart: chunk_id, speech_idx, start_ms, end_ms."""
    order = W.partitionBy("chunk_id").orderBy("word_idx")
    w = words(spark, sf_dir).withColumn("new", F.when(F.col("start_ms") - F.lag("end_ms").over(order) < 500, 0).otherwise(1))
    w = w.withColumn("speech_idx", F.sum("new").over(order) - 1)
    return w.groupBy("chunk_id", "speech_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def turn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with speaker vectors: label groups lean on shared dimensions, every 41st is an outlier, short ones have none."""
    v, lab = F.col("vec_id").cast("long"), F.col("label").cast("long")
    raw = table(spark, sf_dir, "embeddings").select(v.alias("vec_id"), lab.alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v, lab = F.col("vec_id"), F.col("label")
    leaned = F.transform("e", lambda x, i: x + F.when((i % 10 == lab % 4) & (v % 41 != 0), 0.3).otherwise(0.0))
    unit = raw.withColumn("e", leaned).withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)))
    start, dur = (v % 50) * 3000 + (v * 29) % 400, 250 + (v * 173) % 2400
    return unit.select(
        F.expr("vec_id div 50").alias("chunk_id"), (v % 50).alias("turn_idx"), F.concat(F.lit("SPEAKER_0"), lab).alias("speaker"), start.alias("start_ms"), (start + dur).alias("end_ms"),
        F.when(dur >= 400, F.transform("e", lambda x: x / F.col("norm"))).alias("embedding"),
    )


def face_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored face box per (chunk, track, frame)."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "value")
    keyed = e.withColumn("chunk_id", F.expr("user_id div 15")).withColumn("track", F.col("user_id") % 5).withColumn("frame", (F.col("event_id") * 7) % 1000)
    first = keyed.groupBy("chunk_id", "track", "frame").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("r")).select("chunk_id", "track", "frame", "r.*")
    i = F.col("event_id")
    score = (F.round(F.col("value") * 100).cast("long") % 900) / 100.0 - 3
    x, y = ((i * 13) % 1500).cast("double"), ((i * 17) % 800).cast("double")
    return first.select("chunk_id", "track", "frame", x.alias("x1"), y.alias("y1"), (x + 60 + (i * 7) % 200).alias("x2"), (y + 90 + (i * 11) % 220).alias("y2"), score.alias("score"))


def face_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns for the face chunks: twenty each, and a short one of its own speaker in even chunks."""
    c = table(spark, sf_dir, "events").select(F.expr("CAST(user_id AS BIGINT) div 15").alias("chunk_id")).distinct()
    t = c.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("t", F.col("t").cast("long"))
    k, i = F.col("chunk_id"), F.col("t")
    start, dur = i * 2000 + (k * 131 + i * 57) % 500, 400 + (i * 311 + k * 97) % 1900
    many = t.select("chunk_id", i.alias("turn_idx"), F.concat(F.lit("SPEAKER_0"), (i * 3 + k) % 4).alias("speaker"), start.alias("start_ms"), (start + dur).alias("end_ms"))
    odd = c.where("chunk_id % 2 = 0").select("chunk_id", F.lit(20).cast("long").alias("turn_idx"), F.lit("SPEAKER_09").alias("speaker"), F.lit(39500).cast("long").alias("start_ms"), F.lit(39900).cast("long").alias("end_ms"))
    return many.unionByName(odd)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred samples a second per clip: clip_id, idx, value."""
    i = F.col("event_id").cast("long")
    value = (F.round(F.col("value") * 100).cast("long") % 2000 - 1000) / 1000.0
    return table(spark, sf_dir, "events").select((i % 10).alias("clip_id"), F.expr("CAST(event_id AS BIGINT) div 10").alias("idx"), value.alias("value"))


PIECE = "(?s).{1,60}"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text a second and run: every document in pieces of sixty characters, plain, after or before Korean in turn, then
    a silent, an empty and a Korean second."""
    pieces = F.concat(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PIECE), F.lit(0)), F.array(F.lit("."), F.lit(""), F.lit("안녕하세요")))
    s = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(pieces).alias("pos", "piece"))
    second = F.col("doc_id") * 10000 + F.col("pos")
    text = F.when(second % 5 == 1, F.concat(F.lit("안녕 "), F.col("piece"))).when(second % 5 == 3, F.concat(F.col("piece"), F.lit(" 안녕하세요"))).otherwise(F.col("piece"))
    return s.select(F.col("source").alias("run"), second.alias("second"), F.when(F.length("piece") > 1, text).otherwise(F.col("piece")).alias("text"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered answers, one line a turn, every fifth turn missing: batch_id, response, n_expected."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("batch_id"), F.col("turn").cast("long").alias("turn"), "text")
    line = F.concat(F.lit("["), F.col("turn"), F.lit("] "), F.col("text"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["turn"] % 5 != 4)
    return c.groupBy("batch_id").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("response"), F.count("*").alias("n_expected"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scored attempts a segment at speeds 1, .9 and 1.1."""
    s = segments(spark, sf_dir).select("chunk_id", "segment_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("attempt"))
    c, i, a = F.col("chunk_id"), F.col("segment_id"), F.col("attempt")
    speed = F.when(a == 0, 1.0).when(a == 1, 0.9).otherwise(1.1)
    return s.select("chunk_id", "segment_id", "attempt", speed.alias("speed"), (1 + ((c * 19 + i * 23 + a * 37) % 40) / 10.0).alias("score"))


def train_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines of a log per user: log, seq, line; the last three steps of every tenth log repeat."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "value")
    w = W.partitionBy("user_id").orderBy("event_id")
    n = e.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("total", F.count("*").over(W.partitionBy("user_id")))
    step = F.when(F.col("user_id") % 10 == 0, F.least("seq", F.greatest(F.col("total") - 2, F.lit(1)))).otherwise(F.col("seq"))
    loss = F.round(F.col("value") * 10).cast("long")
    unit = F.when(F.col("user_id") % 3 == 0, "s/it").otherwise("it/s")
    line = F.concat(F.lit("Steps:  "), F.expr("CAST(1 AS STRING)"), F.lit("%|###   | "), step.cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" [01:23<02:34,  2.5"), unit, F.lit(", lr=1e-5, step_loss="), F.expr("CAST(CAST(round(value * 10) AS BIGINT) div 10000 AS STRING)"), F.lit("."), F.lpad((loss % 10000).cast("string"), 4, "0"), F.lit("]"))
    return n.select(F.concat(F.lit("log"), F.col("user_id")).alias("log"), "seq", line.alias("line"))


#: Standard SQL of the same tables; later entries may use earlier ones.
TABLE_SQL = {
    "words": r"""tok AS (SELECT CAST(conv_id AS BIGINT) AS chunk_id, CAST(turn AS BIGINT) AS turn, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS word,
        unnest(range(0, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')))) AS pos FROM conversations),
      tok2 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY turn, pos) - 1 AS word_idx FROM tok WHERE word <> ''),
      tok3 AS (SELECT *, CAST(CASE WHEN (word_idx * 7 + chunk_id) % 97 = 0 THEN 3500 WHEN (word_idx + chunk_id) % 101 = 1 THEN 10 ELSE 80 * length(word) END AS BIGINT) AS dur,
        40 + (word_idx * 37 + chunk_id * 11) % 300 + CASE WHEN pos = 0 THEN 600 ELSE 0 END + CASE WHEN pos = 0 AND turn % 3 = 0 THEN 1600 ELSE 0 END AS gap FROM tok2),
      tok4 AS (SELECT *, CAST(sum(dur + gap) OVER (PARTITION BY chunk_id ORDER BY word_idx) AS BIGINT) AS end_ms FROM tok3),
      words AS (SELECT chunk_id, word_idx, word, turn, end_ms - dur AS start_ms, end_ms FROM tok4)""",
    "turns": """turns AS (SELECT w.chunk_id, w.turn AS turn_idx, CASE c.role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker, w.s - 100 * (w.turn % 2) AS start_ms, w.end_ms
        FROM (SELECT chunk_id, turn, min(start_ms) AS s, max(end_ms) AS end_ms FROM words GROUP BY 1, 2) w JOIN conversations c ON c.conv_id = w.chunk_id AND c.turn = w.turn)""",
    "segments": """segments AS (SELECT t.chunk_id, t.turn_idx AS segment_id, t.speaker, t.start_ms, t.end_ms, x.text, x.n_words, ['Neutral', 'Happy', 'Sad', 'Angry', 'Surprised', 'Scared'][(t.chunk_id * 7 + t.turn_idx * 3) % 6 + 1] AS emotion,
        ((t.chunk_id * 13 + t.turn_idx * 29) % 1000) / 1000.0 AS emotion_score, 1 + ((t.chunk_id * 17 + t.turn_idx * 31) % 400) / 100.0 AS tts_mos,
        CASE WHEN (t.chunk_id + t.turn_idx) % 5 = 0 THEN '' ELSE '번역 ' || x.text END AS translated, (t.chunk_id + t.turn_idx) % 4 = 0 AS was_split
        FROM turns t JOIN (SELECT chunk_id, turn, string_agg(word, ' ' ORDER BY word_idx) AS text, count(*) AS n_words FROM words GROUP BY 1, 2) x ON x.chunk_id = t.chunk_id AND x.turn = t.turn_idx)""",
    "speech": """sp1 AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY chunk_id ORDER BY word_idx) < 500 THEN 0 ELSE 1 END AS new FROM words),
      sp2 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY chunk_id ORDER BY word_idx) AS BIGINT) - 1 AS speech_idx FROM sp1),
      speech AS (SELECT chunk_id, speech_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM sp2 GROUP BY 1, 2)""",
    "turn_vectors": """tv0 AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN (i - 1) % 10 = label % 4 AND vec_id % 41 <> 0 THEN 0.3 ELSE 0.0 END) AS e FROM embeddings),
      tv1 AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm, (vec_id % 50) * 3000 + (vec_id * 29) % 400 AS s, 250 + (vec_id * 173) % 2400 AS d FROM tv0),
      turn_vectors AS (SELECT vec_id // 50 AS chunk_id, vec_id % 50 AS turn_idx, 'SPEAKER_0' || label AS speaker, s AS start_ms, s + d AS end_ms, CASE WHEN d >= 400 THEN list_transform(e, lambda x: x / norm) END AS embedding FROM tv1)""",
    "face_frames": """ff0 AS (SELECT CAST(user_id AS BIGINT) // 15 AS chunk_id, CAST(user_id AS BIGINT) % 5 AS track, (CAST(event_id AS BIGINT) * 7) % 1000 AS frame, CAST(event_id AS BIGINT) AS i, value FROM events),
      ff1 AS (SELECT chunk_id, track, frame, min(i) AS i, arg_min(value, i) AS value FROM ff0 GROUP BY 1, 2, 3),
      face_frames AS (SELECT chunk_id, track, frame, CAST((i * 13) % 1500 AS DOUBLE) AS x1, CAST((i * 17) % 800 AS DOUBLE) AS y1, CAST((i * 13) % 1500 + 60 + (i * 7) % 200 AS DOUBLE) AS x2, CAST((i * 17) % 800 + 90 + (i * 11) % 220 AS DOUBLE) AS y2,
        (CAST(round(value * 100) AS BIGINT) % 900) / 100.0 - 3 AS score FROM ff1)""",
    "face_turns": """ftc AS (SELECT DISTINCT CAST(user_id AS BIGINT) // 15 AS k FROM events), ftt AS (SELECT k, CAST(unnest(range(0, 20)) AS BIGINT) AS t FROM ftc),
      face_turns AS (SELECT k AS chunk_id, t AS turn_idx, 'SPEAKER_0' || ((t * 3 + k) % 4) AS speaker, t * 2000 + (k * 131 + t * 57) % 500 AS start_ms, t * 2000 + (k * 131 + t * 57) % 500 + 400 + (t * 311 + k * 97) % 1900 AS end_ms FROM ftt
        UNION ALL SELECT k, 20, 'SPEAKER_09', 39500, 39900 FROM ftc WHERE k % 2 = 0)""",
    "samples": "samples AS (SELECT CAST(event_id AS BIGINT) % 10 AS clip_id, CAST(event_id AS BIGINT) // 10 AS idx, (CAST(round(value * 100) AS BIGINT) % 2000 - 1000) / 1000.0 AS value FROM events)",
    "transcripts": """tr0 AS (SELECT source AS run, CAST(doc_id AS BIGINT) AS doc_id, list_concat(regexp_extract_all(coalesce(text, ''), '(?s).{1,60}'), ['.', '', '안녕하세요']) AS p FROM documents),
      tr1 AS (SELECT run, doc_id * 10000 + unnest(range(0, len(p))) AS second, unnest(p) AS piece FROM tr0),
      transcripts AS (SELECT run, second, CASE WHEN length(piece) <= 1 THEN piece WHEN second % 5 = 1 THEN '안녕 ' || piece WHEN second % 5 = 3 THEN piece || ' 안녕하세요' ELSE piece END AS text FROM tr1)""",
    "responses": """responses AS (SELECT CAST(conv_id AS BIGINT) AS batch_id, coalesce(string_agg('[' || turn || '] ' || text, chr(10) ORDER BY turn) FILTER (WHERE turn % 5 <> 4), '') AS response, count(*) AS n_expected FROM conversations GROUP BY 1)""",
    "attempts": """attempts AS (SELECT chunk_id, segment_id, CAST(attempt AS BIGINT) AS attempt, CAST(CASE attempt WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 1.1 END AS DOUBLE) AS speed, 1 + ((chunk_id * 19 + segment_id * 23 + attempt * 37) % 40) / 10.0 AS score FROM segments, (SELECT unnest([0, 1, 2]) AS attempt))""",
    "train_lines": """tl0 AS (SELECT CAST(user_id AS BIGINT) AS user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS total FROM events),
      tl1 AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN least(seq, greatest(total - 2, 1)) ELSE seq END AS step, CAST(round(value * 10) AS BIGINT) AS loss FROM tl0),
      train_lines AS (SELECT 'log' || user_id AS log, seq, 'Steps:  1%|###   | ' || step || '/' || total || ' [01:23<02:34,  2.5' || CASE WHEN user_id % 3 = 0 THEN 's/it' ELSE 'it/s' END || ', lr=1e-5, step_loss=' || (loss // 10000) || '.' || lpad(CAST(loss % 10000 AS VARCHAR), 4, '0') || ']' AS line FROM tl1)""",
}
NEEDS = {"turns": ["words"], "segments": ["words", "turns"], "speech": ["words"], "attempts": ["words", "turns", "segments"]}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """A query over derived tables: their definitions in front of `body` (which may go on with more of its own)."""
    wanted = {n for t in names.split() for n in [*NEEDS.get(t, []), t]}
    parts = ",\n".join(TABLE_SQL[t] for t in TABLE_SQL if t in wanted)
    return f"WITH {'RECURSIVE ' * recursive}{parts}{', ' if body.startswith('+') else ' '}{body.removeprefix('+')}"
