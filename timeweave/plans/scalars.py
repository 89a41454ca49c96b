"""Scalar functions and filters over the derived tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.functions import logs, planning, text, vectors
from timeweave.operators import speakers
from timeweave.sources import timeline as T

QUERIES, ORACLE_SQL = {}, {}
col = F.col


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _case(values: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" if isinstance(v, float) else f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


HANGUL = "length(regexp_replace({0}, '[^가-힣]', '', 'g'))"
SLOW_SQL, FAST_SQL = "|".join(text.SLOW), "|".join(text.FAST)
RATE_SQL = f"CASE WHEN regexp_matches(lower({{0}}), '{SLOW_SQL}') THEN CAST(0.85 AS DOUBLE) WHEN regexp_matches(lower({{0}}), '{FAST_SQL}') THEN CAST(1.05 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END"
LEAK_SQL = f"""CASE WHEN text = '' OR text IN ({_in(text.SILENT)}) THEN 'silent' WHEN regexp_matches(regexp_replace(text, '[가-힣\\x00-\\x7F]', '', 'g'), '\\p{{L}}') THEN 'OTHER'
  WHEN regexp_matches(text, '[a-zA-Z]') AND NOT regexp_matches(text, '[가-힣]') THEN 'ENG' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'MIXED' ELSE 'clean' END"""

add("h1_h2_script_counts", lambda s, d: T.transcripts(s, d).select("run", "second", text.hangul_count(col("text")).alias("hangul"), text.script_counts(col("text")).alias("c")).select("run", "second", "hangul", "c.*"),
    T.with_tables("transcripts", f"""SELECT run, second, {HANGUL.format('text')} AS hangul, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS total, {HANGUL.format('text')} AS korean, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS ascii,
      length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) - {HANGUL.format('text')} - length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS other FROM transcripts"""))
add("h3_leak_class", lambda s, d: T.transcripts(s, d).select("run", "second", text.leak_class(col("text")).alias("leak")), T.with_tables("transcripts", f"SELECT run, second, {LEAK_SQL} AS leak FROM transcripts"))
NOTE = "CASE (chunk_id + segment_id) % 4 WHEN 0 THEN 'Slow, reflective' WHEN 1 THEN 'quick and urgent' WHEN 2 THEN 'quick but calm' ELSE 'plain' END"
add("h4_desc_rate", lambda s, d: T.segments(s, d).withColumn("note", F.expr(NOTE)).select("chunk_id", "segment_id", text.desc_rate(col("note")).alias("rate")),
    T.with_tables("segments", f"SELECT chunk_id, segment_id, {RATE_SQL.format(NOTE)} AS rate FROM segments"))
add("h5_norm_token", lambda s, d: T.words(s, d).select("chunk_id", "word_idx", text.norm_token(col("word")).alias("token")), T.with_tables("words", r"SELECT chunk_id, word_idx, lower(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')) AS token FROM words"))
add("h6_sentences", lambda s, d: T.segments(s, d).select("chunk_id", "segment_id", F.posexplode(text.sentences(col("text"))).alias("n", "sentence")),
    T.with_tables("segments", """SELECT chunk_id, segment_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS n, unnest(x) AS sentence FROM (SELECT chunk_id, segment_id,
      list_filter(list_transform(regexp_extract_all(text, '[^.?!。？！]*[.?!。？！]+|[^.?!。？！]+'), lambda y: trim(y)), lambda y: y <> '') AS x FROM segments)"""))
add("h7_lang_code", lambda s, d: T.table(s, d, "documents").select("doc_id", text.lang_name(col("lang")).alias("name"), text.lang_code(text.lang_name(col("lang"))).alias("code")),
    f"SELECT doc_id, {_case(text.LANGUAGES, 'lang', 'lower(lang)')} AS name, CASE {_case(text.LANGUAGES, 'lang', 'lower(lang)')} " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in text.LANGUAGES.items()) + " ELSE lower(lang) END AS code FROM documents")
DUR = "((end_ms - start_ms) / 1000.0)"
TARGET_SQL = f"greatest(CAST(0.3 AS DOUBLE), (end_ms - start_ms) / 1000.0)"
FACTOR_SQL = "6.0 * " + _case(planning.TARGET_FACTOR, "emotion", "1.0")
LOW_SQL = f"greatest(1, CAST(floor({TARGET_SQL} * ({FACTOR_SQL} - 0.5)) AS BIGINT))"
HIGH_SQL = f"greatest({LOW_SQL} + 1, CAST(floor({TARGET_SQL} * ({FACTOR_SQL} + 0.5)) AS BIGINT))"
add("h8_syllable_target", lambda s, d: T.segments(s, d).select("chunk_id", "segment_id", planning.syllable_target((col("end_ms") - col("start_ms")) / 1000.0, col("emotion")).alias("t")).select("chunk_id", "segment_id", "t.*"),
    T.with_tables("segments", f"SELECT chunk_id, segment_id, {LOW_SQL} AS low, {HIGH_SQL} AS high FROM segments"))


def prompts(s, d):
    """H9: both forms of every segment's line, and a batch of seven joined by line ends."""
    x = T.segments(s, d).withColumn("ds", F.expr("round((end_ms - start_ms) / 100) * 100 / 1000.0 + 0.00001")).withColumn("hint", F.expr("CAST(emotion_score AS DOUBLE) + 0.00001"))
    x = x.withColumn("batch", F.expr("segment_id div 7")).withColumn("slot", col("segment_id") % 7)
    plain = planning.prompt_line(col("slot"), col("ds"), col("emotion"), col("text"))
    full = planning.described_line(col("slot"), col("ds"), col("emotion"), col("hint"), col("speaker"), col("text"))
    lines = x.select("chunk_id", "batch", "slot", plain.alias("p"), full.alias("f"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", c))), lambda r: r[c]), "\n")
    return lines.groupBy("chunk_id", "batch").agg(joined("p").alias("plain"), joined("f").alias("described"))


LINE_HEAD = f"printf('[%d] (duration: %.1fs, target: %d~%d syllables', segment_id % 7, greatest(CAST(0.3 AS DOUBLE), ds), {LOW_SQL.replace('(end_ms - start_ms) / 1000.0', 'ds')}, {HIGH_SQL.replace('(end_ms - start_ms) / 1000.0', 'ds')})"
add("h9_prompt_line", prompts, T.with_tables("segments", f"""+l AS (SELECT chunk_id, segment_id // 7 AS batch, segment_id, {LINE_HEAD} || ') ' || text AS p, {LINE_HEAD} || printf(', emotion2vec_hint: %s %.2f, speaker: %s) ', emotion, CAST(emotion_score AS DOUBLE) + 0.00001, speaker) || text AS f
  FROM (SELECT *, round((end_ms - start_ms) / 100) * 100 / 1000.0 + 0.00001 AS ds FROM segments)) SELECT chunk_id, batch, string_agg(p, chr(10) ORDER BY segment_id) AS plain, string_agg(f, chr(10) ORDER BY segment_id) AS described FROM l GROUP BY 1, 2"""))
add("h10_strip_think", lambda s, d: T.segments(s, d).withColumn("r", F.concat(F.lit("<think>a\nb</think> \""), col("text"), F.lit("\""))).select("chunk_id", "segment_id", text.strip_quotes(text.strip_think(col("r"))).alias("said")),
    T.with_tables("segments", r"""SELECT chunk_id, segment_id, regexp_replace(trim(regexp_replace('<think>a' || chr(10) || 'b</think> "' || text || '"', '(?s)<think>.*?</think>', '', 'g')), '^["'']+|["'']+$', '', 'g') AS said FROM segments"""))
RATIO = "((chunk_id * 7 + segment_id * 13) % 200 / 100.0)"
add("h13_predicted", lambda s, d: T.segments(s, d).withColumn("slot", (col("end_ms") - col("start_ms")) / 1000.0).withColumn("rate", planning.effective_rate(F.lit("ko"), col("emotion"), F.expr(NOTE)))
    .select("chunk_id", "segment_id", F.round(F.length("translated") / col("rate"), 6).alias("predicted"), (F.length("translated") / col("rate") > col("slot") * 1.25).alias("overflow"), F.floor(F.round(col("slot") * col("rate"), 6)).cast("long").alias("target_syllables")),
    T.with_tables("segments", f"""SELECT chunk_id, segment_id, round(length(translated) / rate, 6) AS predicted, length(translated) / rate > slot * 1.25 AS overflow, CAST(floor(round(slot * rate, 6)) AS BIGINT) AS target_syllables
      FROM (SELECT *, CAST((end_ms - start_ms) / 1000.0 AS DOUBLE) AS slot, CAST(5.5 AS DOUBLE) * {_case(planning.PREDICT_FACTOR, 'emotion', '1.0')} * {RATE_SQL.format(NOTE)} AS rate FROM segments)"""))
add("h14_retry_plan", lambda s, d: T.segments(s, d).withColumn("ratio", F.expr(RATIO).cast("double")).withColumn("plan", planning.retry_plan(col("ratio"))).select("chunk_id", "segment_id", "plan", planning.accept_retry(col("plan"), col("ratio"), col("ratio") * 1.2, F.lit(1.0)).alias("accepted")),
    T.with_tables("segments", f"""SELECT chunk_id, segment_id, plan, CASE plan WHEN 'slow_0.90' THEN r * CAST(1.2 AS DOUBLE) > r AND r * CAST(1.2 AS DOUBLE) <= CAST(1.1 AS DOUBLE) WHEN 'fast_1.15' THEN r * CAST(1.2 AS DOUBLE) < r ELSE false END AS accepted FROM (SELECT *, CASE WHEN r < 0.8 THEN 'slow_0.90' WHEN r < 1.05 THEN 'none' WHEN r < 1.4 THEN 'fast_1.15' ELSE 'stretch_only' END AS plan
      FROM (SELECT *, CAST({RATIO} AS DOUBLE) AS r FROM segments))"""))
add("h15_stretch_plan", lambda s, d: T.segments(s, d).withColumn("t", (col("end_ms") - col("start_ms")) / 1000.0).select("chunk_id", "segment_id", planning.stretch_plan(col("t") * F.expr(RATIO), col("t"), col("t") + 0.3).alias("p")).select("chunk_id", "segment_id", "p.action", F.round("p.factor", 6).alias("factor"), "p.trimmed"),
    T.with_tables("segments", f"""+p AS (SELECT *, n / greatest(0.1, t) AS r, 0.15 / greatest(0.1, t) AS k FROM (SELECT *, t * {RATIO} AS n FROM (SELECT *, CAST((end_ms - start_ms) / 1000.0 AS DOUBLE) AS t FROM segments))),
      a AS (SELECT *, CASE WHEN r >= 1 - k AND r <= 1 + k THEN 'keep' WHEN r < 1 - k THEN 'lengthen' WHEN r <= 1.25 THEN 'shorten' ELSE 'overflow' END AS action FROM p)
      SELECT chunk_id, segment_id, action, round(CASE action WHEN 'keep' THEN 1.0 WHEN 'lengthen' THEN greatest(0.85, r) WHEN 'shorten' THEN r ELSE 1.25 END, 6) AS factor, action = 'overflow' AND n / 1.25 > t + 0.3 AS trimmed FROM a"""))
add("h16_diagnose", lambda s, d: T.segments(s, d).withColumn("score", planning.clip_score(col("tts_mos") * 1.3 - 0.6 + 1e-7)).select("chunk_id", "segment_id", "score", planning.diagnose(col("score")).alias("band"), (col("score") >= 3.5).alias("passed")),
    T.with_tables("segments", """SELECT chunk_id, segment_id, score, CASE WHEN score >= 4 THEN 'excellent' WHEN score >= 3.5 THEN 'pass' WHEN score >= 3 THEN 'adjust_speed' WHEN score >= 2 THEN 'replace_reference' ELSE 'restructure' END AS band, score >= 3.5 AS passed
      FROM (SELECT *, round(greatest(CAST(1 AS DOUBLE), least(CAST(5 AS DOUBLE), CAST(tts_mos AS DOUBLE) * CAST(1.3 AS DOUBLE) - CAST(0.6 AS DOUBLE) + 1e-7)), 2) AS score FROM segments)"""))
add("h17_format_seconds", lambda s, d: T.turns(s, d).select("chunk_id", "turn_idx", logs.format_seconds(col("end_ms") / 100.0).alias("shown")),
    T.with_tables("turns", "SELECT chunk_id, turn_idx, CASE WHEN x // 3600 > 0 THEN printf('%dh %dmin', x // 3600, x % 3600 // 60) WHEN x // 60 > 0 THEN printf('%dmin %ds', x // 60, x % 60) ELSE printf('%ds', x) END AS shown FROM (SELECT *, end_ms // 100 AS x FROM turns)"))
STEP_SQL = r"Steps:\s+\d+%\|[^|]*\|\s+(\d+)/(\d+)\s+\[\S+,\s+([\d.]+)\s*(s/it|it/s)[^\]]*step_loss=([\d.eE+-]+)"
add("h18_h27_parse_step", lambda s, d: T.train_lines(s, d).select("log", "seq", logs.parse_step(col("line")).alias("p")).select("log", "seq", "p.step", "p.total", "p.speed", "p.loss", F.round(logs.eta_seconds(col("p.step"), col("p.total"), col("p.speed")), 6).alias("eta")),
    T.with_tables("train_lines", f"""+p AS (SELECT log, seq, CAST(regexp_extract(line, '{STEP_SQL}', 1) AS BIGINT) AS step, CAST(regexp_extract(line, '{STEP_SQL}', 2) AS BIGINT) AS total,
      CASE WHEN regexp_extract(line, '{STEP_SQL}', 4) = 'it/s' THEN CAST(regexp_extract(line, '{STEP_SQL}', 3) AS DOUBLE) ELSE 1 / CAST(regexp_extract(line, '{STEP_SQL}', 3) AS DOUBLE) END AS speed, CAST(regexp_extract(line, '{STEP_SQL}', 5) AS DOUBLE) AS loss FROM train_lines)
      SELECT *, round(CASE WHEN speed > 0 AND total > step THEN (total - step) / speed END, 6) AS eta FROM p"""))
ODD_LINE = "CASE event_id % 4 WHEN 0 THEN 'RuntimeError: bad shape' WHEN 1 THEN 'FAILED: fp16 kernel' WHEN 2 THEN 'FAILED node ' || event_type ELSE event_type END"
add("h19_is_crash", lambda s, d: T.table(s, d, "events").select("event_id", logs.is_crash(F.expr(ODD_LINE), F.expr("event_id * 37 % 600")).alias("crash")),
    f"SELECT event_id, event_id * 37 % 600 >= 300 AND (contains(x, 'RuntimeError') OR contains(x, 'FAILED')) AND NOT regexp_matches(lower(x), 'fp16|dtype|onnxruntime|providerlibrary|cublaslt|tryget') AS crash FROM (SELECT event_id, {ODD_LINE} AS x FROM events)")
add("h20_speaker_number", lambda s, d: T.turn_vectors(s, d).withColumn("l", F.concat(F.lit("SPEAKER_"), col("turn_idx") + 60)).select("chunk_id", "turn_idx", text.speaker_number(col("l")).alias("number"), text.is_outlier(col("l")).alias("outlier")),
    T.with_tables("turn_vectors", "SELECT chunk_id, turn_idx, turn_idx + 60 AS number, turn_idx + 60 > 90 AS outlier FROM turn_vectors"))
add("h21_short_name", lambda s, d: T.table(s, d, "part").select("p_partkey", text.short_name(col("p_name")).alias("short")), "SELECT p_partkey, CASE WHEN x = '' THEN 'run' ELSE x END AS short FROM (SELECT p_partkey, left(regexp_replace(p_name, '[^a-zA-Z0-9가-힣]', '', 'g'), 10) AS x FROM part)")
add("h22_ratio_string", lambda s, d: T.table(s, d, "part").select("p_partkey", F.round(logs.ratio_string(F.concat(col("p_size").cast("string"), F.lit("000/"), (col("p_partkey") % 5).cast("string"))), 6).alias("ratio")),
    "SELECT p_partkey, round(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 1000.0 / (p_partkey % 5) END, 6) AS ratio FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part)")
add("h23_vectors", lambda s, d: T.turn_vectors(s, d).where("embedding is not null").withColumn("r", F.reverse("embedding")).select("chunk_id", "turn_idx", F.round(vectors.dot(col("embedding"), col("r")), 6).alias("dot"), F.round(vectors.l2_norm(col("embedding")), 6).alias("norm"), F.round(vectors.cosine(col("embedding"), col("r")), 6).alias("cosine")),
    T.with_tables("turn_vectors", "SELECT chunk_id, turn_idx, round(list_dot_product(embedding, list_reverse(embedding)), 6) AS dot, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm, round(list_dot_product(embedding, list_reverse(embedding)) / (list_dot_product(embedding, embedding) + 1e-9), 6) AS cosine FROM turn_vectors WHERE embedding IS NOT NULL"))
add("h25_frames", lambda s, d: T.turns(s, d).select("chunk_id", "turn_idx", logs.frame_of(col("start_ms"), 25).alias("frame"), logs.ms_of(logs.frame_of(col("start_ms"), 25), 25).alias("ms"), logs.sample_of(col("start_ms")).alias("sample")),
    T.with_tables("turns", "SELECT chunk_id, turn_idx, CAST(floor(start_ms * 25 / 1000) AS BIGINT) AS frame, CAST(floor(floor(start_ms * 25 / 1000) * 1000 / 25) AS BIGINT) AS ms, start_ms * 24 AS sample FROM turns"))
add("h26_style_prefix", lambda s, d: T.segments(s, d).select("chunk_id", "segment_id", planning.style_prefix(col("emotion")).alias("prefix")),
    T.with_tables("segments", f"SELECT chunk_id, segment_id, CASE WHEN emotion IN ({_in(list(planning.STYLE))}) THEN 'You are a helpful assistant. Please say this sentence ' || {_case(planning.STYLE, 'emotion', chr(39) * 2)} || '.<|endofprompt|>' ELSE 'You are a helpful assistant.<|endofprompt|>' END AS prefix FROM segments"))

# Filters and projections
add("b1_dialogue", lambda s, d: T.words(s, d).where(text.is_dialogue(col("word"))).select("chunk_id", "word_idx", "word"),
    T.with_tables("words", f"SELECT chunk_id, word_idx, word FROM words WHERE NOT (trim(word) = '' OR regexp_replace(lower(trim(word)), '[.,!?~]+$', '') IN ({_in(text.FILLERS)}) OR length(trim(word)) < 3)"))
add("b3_fix_interval", lambda s, d: T.segments(s, d).withColumn("e", F.when(col("segment_id") % 3 == 0, col("start_ms")).otherwise(col("end_ms"))).select("chunk_id", "segment_id", F.when(col("e") <= col("start_ms"), col("start_ms") + 100).otherwise(col("e")).alias("end_ms")),
    T.with_tables("segments", "SELECT chunk_id, segment_id, CASE WHEN segment_id % 3 = 0 OR end_ms <= start_ms THEN start_ms + 100 ELSE end_ms END AS end_ms FROM segments"))
LABEL_LIST = ["生气/angry", "开心/happy", "其他/others", "Sad", "unk"]
SCORES = ["((chunk_id * 3 + segment_id) % 7) / 7.0", "((chunk_id + segment_id * 5) % 7) / 7.0", "0.3", "((chunk_id + segment_id) % 3) / 3.0", "0.5"]
add("b4_top_emotion", lambda s, d: T.segments(s, d).select("chunk_id", "segment_id", planning.top_emotion(F.array(*map(F.lit, LABEL_LIST)), F.array(*[F.expr(x).cast("double") for x in SCORES]), col("end_ms") - col("start_ms")).alias("e")).select("chunk_id", "segment_id", "e.*"),
    T.with_tables("segments", f"""+x AS (SELECT chunk_id, segment_id, end_ms - start_ms AS d, [{', '.join(f'CAST({x} AS DOUBLE)' for x in SCORES)}] AS sc FROM segments)
      SELECT chunk_id, segment_id, CASE WHEN d < 300 THEN 'Neutral' ELSE ['Angry', 'Happy', 'Neutral', 'Sad', 'Neutral'][list_position(sc, list_max(sc))] END AS emotion, CASE WHEN d < 300 THEN CAST(0 AS DOUBLE) ELSE round(list_max(sc), 3) END AS score FROM x"""))
KIND = "CASE chunk_id % 4 WHEN 0 THEN 'lecture' WHEN 1 THEN 'drama' WHEN 2 THEN 'news' ELSE 'other' END"
add("b5_emotion_policy", lambda s, d: T.segments(s, d).withColumn("neutral", text.lookup(planning.POLICIES, F.expr(KIND), "passthrough") == "neutral_only").select("chunk_id", "segment_id", F.when(col("neutral"), "Neutral").otherwise(col("emotion")).alias("emotion"), F.when(col("neutral"), 1.0).otherwise(col("emotion_score")).cast("double").alias("emotion_score"), col("emotion").alias("raw_emotion")),
    T.with_tables("segments", f"SELECT chunk_id, segment_id, CASE WHEN {KIND} IN ('lecture', 'news') THEN 'Neutral' ELSE emotion END AS emotion, CAST(CASE WHEN {KIND} IN ('lecture', 'news') THEN 1.0 ELSE emotion_score END AS DOUBLE) AS emotion_score, emotion AS raw_emotion FROM segments"))
BAND = """+q AS (SELECT *, end_ms - start_ms AS dur FROM segments), r AS (SELECT *, max(CASE WHEN dur BETWEEN 3000 AND 15000 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id) AS ok FROM q),
  band AS (SELECT * FROM r WHERE CASE WHEN ok = 1 THEN dur BETWEEN 3000 AND 15000 ELSE dur BETWEEN 1000 AND 25000 END)"""
add("b2_reference_band", lambda s, d: speakers.reference_band(T.segments(s, d)).select("chunk_id", "segment_id", (col("end_ms") - col("start_ms")).alias("dur")), T.with_tables("segments", f"{BAND} SELECT chunk_id, segment_id, dur FROM band"))
BOX = "x2 - x1 AS w, y2 - y1 AS h, (frame * 7 + track * 13) % 100 / 100.0 AS det, (frame * 3 + track) % 9 - 4.0 AS dx, (frame * 5 + track) % 7 - 3.0 AS dy, (frame * 11) % 60 AS bright"
GATES = {
    "size": "w >= 50 AND h >= 80 AND w / h >= 0.2 AND w / h <= 1.5 AND det >= 0.5", "strict": "w >= 50 AND h >= 80 AND w / h >= 0.4 AND w / h <= 1.5 AND det >= 0.85",
    "roll": "NOT (abs(dx) > 1 AND abs(dy) / abs(dx) > 0.5)", "distance": "sqrt(w * w + h * h) / sqrt(1920.0 * 1920 + 1080.0 * 1080) >= 0.1", "profile": "NOT (abs(dx) > 1 AND abs(dy) / abs(dx) > 0.35)", "dark": "bright >= 25",
}
for _name, _gate in GATES.items():
    add(f"b6_b10_gate_{_name}", (lambda g: lambda s, d: T.face_frames(s, d).selectExpr("*", *[x.strip() for x in BOX.split(", ")]).where(g.replace("abs(dy) / abs(dx)", "try_divide(abs(dy), abs(dx))")).select("chunk_id", "track", "frame"))(_gate),
        T.with_tables("face_frames", f"SELECT chunk_id, track, frame FROM (SELECT *, {BOX} FROM face_frames) WHERE {_gate}"))
add("b11_gate_ablation", lambda s, d: T.face_frames(s, d).selectExpr("*", *[x.strip() for x in BOX.split(", ")]).groupBy("chunk_id").agg(
        *[F.round(F.avg(F.expr(f"CASE WHEN {g} THEN 1.0D ELSE 0.0D END".replace("abs(dy) / abs(dx)", "try_divide(abs(dy), abs(dx))"))), 6).alias(k) for k, g in [*GATES.items(), ("all", " AND ".join(f"({g})" for g in GATES.values()))]]).unpivot("chunk_id", [*GATES, "all"], "gate", "kept"),
    T.with_tables("face_frames", "+f AS (SELECT *, " + BOX + " FROM face_frames) " + " UNION ALL ".join(f"SELECT chunk_id, '{k}' AS gate, round(avg(CASE WHEN {g} THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS kept FROM f GROUP BY chunk_id" for k, g in [*GATES.items(), ("all", " AND ".join(f"({g})" for g in GATES.values()))])))
add("b13_short_chunks", lambda s, d: T.turns(s, d).groupBy("chunk_id").agg(F.max("end_ms").alias("duration_ms")).where("duration_ms >= 3000"), T.with_tables("turns", "SELECT chunk_id, max(end_ms) AS duration_ms FROM turns GROUP BY 1 HAVING max(end_ms) >= 3000"))
add("b14_b15_speeds", lambda s, d: T.segments(s, d).select("chunk_id", "segment_id", planning.emotion_speed(col("emotion")).alias("by_emotion"), F.round(planning.length_speed(col("n_words"), F.length("translated")), 6).alias("by_length")),
    T.with_tables("segments", f"SELECT chunk_id, segment_id, {_case(planning.EMOTION_SPEED, 'emotion', '1.0')} AS by_emotion, round(greatest(CAST(0.9 AS DOUBLE), least(CAST(1.3 AS DOUBLE), CAST(0.4 AS DOUBLE) * length(translated) / greatest(n_words, 1))), 6) AS by_length FROM segments"))
add("b16_has_text", lambda s, d: T.segments(s, d).where("translated <> ''").groupBy("chunk_id", "speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "translated"))), lambda x: x["translated"]), " ").alias("said")),
    T.with_tables("segments", "SELECT chunk_id, speaker, string_agg(translated, ' ' ORDER BY segment_id) AS said FROM segments WHERE translated <> '' GROUP BY 1, 2"))
