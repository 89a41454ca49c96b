"""Corpus cleaning, from raw documents to packed training sequences.

Each stage reads what its predecessor kept, whole. Stages but the last return the columns of `documents`; the last one
returns pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm import decontaminate, line_dedup, packing, set_join, toxicity
from timeweave.llm.common import load, staged
from timeweave.llm.queries import word_vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from labelled rows outside the held-out fold. Rows with a null, empty or
    wordless text stay; without labels of both classes all do."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")), threshold=0.5)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; documents stay, their n_chars counts what is left. Rows without a source or text stay as they are."""
    kept = line_dedup.strip_boilerplate(docs, ratio=0.01, min_pages=3).drop("line_total", "line_dropped")
    return kept.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kept.schema["n_chars"].dataType)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the document with the smallest id stays; rows without
    an id count as the last, rows that repeat one as one document, rows without words stay."""
    return set_join.keep_representatives(docs, n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's run of ten words (or a shorter item whole) go, row by row."""
    return decontaminate.keep_uncontaminated(docs, load(spark, sf_dir, "benchmark"), size=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers have held what earlier stages took, so less is remembered and held here than in a job of its own."""
    return packing.pack(docs, word_vocabulary(), end_id=1, memo_words=200_000, flush_tokens=1 << 20)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
