"""All queries of the timeline engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.operators import joins, sequences
from timeweave.operators.lineage import staged
from timeweave.plans import live, media, scalars, storage, timelines
from timeweave.plans.timelines import GAPS
from timeweave.sources import timeline as T


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who says how much: speaker of every word, words cut into utterances, talk time by chunk and speaker."""
    words = staged(T.words(spark, sf_dir), "words")
    said = joins.speaker_at(timelines.points_of(words), T.turns_of(spark, sf_dir, words)).withColumnRenamed("point_idx", "word_idx")
    cut = sequences.gap_segments(words)
    rows = words.join(said, ["chunk_id", "word_idx"]).join(cut, ["chunk_id", "word_idx"])
    return rows.groupBy("chunk_id", "speaker").agg(F.count("*").alias("words"), F.count_distinct("segment").alias("utterances"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"))


FLAGSHIP_SQL = T.with_tables(
    "turns",
    f"""+pts AS (SELECT chunk_id, word_idx, (start_ms + end_ms) // 2 AS t_ms, end_ms - start_ms AS d FROM words), {GAPS},
  who AS (SELECT p.chunk_id, p.word_idx, p.d, coalesce(arg_min(t.speaker, greatest(t.start_ms - t_ms, t_ms - t.end_ms, 0) * 1000000 + t.turn_idx), 'SPEAKER_00') AS speaker FROM pts p LEFT JOIN turns t USING (chunk_id) GROUP BY 1, 2, 3)
  SELECT chunk_id, speaker, count(*) AS words, count(DISTINCT segment) AS utterances, CAST(sum(d) AS BIGINT) AS talk_ms FROM who JOIN gf USING (chunk_id, word_idx) GROUP BY 1, 2""",
    recursive=True,
)
PARTS = [scalars, timelines, media, storage, live]
QUERIES = {"talk_time": flagship} | {k: q for part in PARTS for k, q in part.QUERIES.items()}
ORACLE_SQL = {"talk_time": FLAGSHIP_SQL} | {k: q for part in PARTS for k, q in part.ORACLE_SQL.items()}
