"""Speaker vectors: centroids, merging, assignment and outliers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timeweave.functions.vectors import dot


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """L2-normalised mean vector per key. Whole vectors are summed where they lie, so a task sends one sum for each key."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("m")
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return rows.groupBy(*keys).agg(mean).select(*keys, F.transform("m", lambda x: x / norm).alias("centroid"))


def speaker_centroids(turns: DataFrame, min_ms: int = 500) -> DataFrame:
    """Mean of vectors of turns of at least min_ms; a speaker without any takes its first vector alone."""
    known = turns.where("embedding is not null").withColumn("long", F.col("end_ms") - F.col("start_ms") >= min_ms)
    w = W.partitionBy("chunk_id", "speaker")
    used = known.withColumn("any_long", F.max("long").over(w)).withColumn("first", F.min("turn_idx").over(w)).where("long OR (NOT any_long AND turn_idx = first)")
    return mean_vectors(used, ["chunk_id", "speaker"])


def similar_pairs(centroids: DataFrame) -> DataFrame:
    """Speakers a < b of a chunk with a cosine of at least .50, or .65 in chunks of fewer than three speakers."""
    c = centroids.withColumn("n", F.count("*").over(W.partitionBy("chunk_id")))
    a, b = c.select("chunk_id", "n", F.col("speaker").alias("a"), F.col("centroid").alias("ca")), c.select("chunk_id", F.col("speaker").alias("b"), F.col("centroid").alias("cb"))
    sim = dot(F.col("ca"), F.col("cb"))
    return a.join(b, "chunk_id").where("a < b").withColumn("sim", sim).where(F.col("sim") >= F.when(F.col("n") >= 3, 0.5).otherwise(0.65)).select("chunk_id", "a", "b", "sim")


def canonical_labels(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Smallest label reachable by pairs, within each chunk.

    A chunk's pairs are folded over a map from speaker to label: each pair gives the labels of both groups it meets the
    smaller of the two. One pass over the pairs, whatever the length of a chain.
    """
    known = labels.groupBy("chunk_id").agg(F.collect_set("speaker").alias("speakers"))
    met = pairs.groupBy("chunk_id").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def meet(state, pair):
        a, b = state[pair["a"]], state[pair["b"]]
        return F.when(a == b, state).otherwise(F.transform_values(state, lambda _, v: F.when((v == a) | (v == b), F.least(a, b)).otherwise(v)))

    start = F.map_from_arrays("speakers", F.transform("speakers", lambda s: F.when(s.isNotNull(), s)))
    folded = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<a:string,b:string>>")), start, meet)
    return known.join(met, "chunk_id", "left").select("chunk_id", F.explode(folded).alias("speaker", "canonical"))


def canonical_labels_in_sql(labels: DataFrame, pairs: DataFrame, most_rounds: int = 64) -> DataFrame:
    """`canonical_labels` as a recursive query: a round gives every label the smallest among its neighbours' labels, until a
    chunk's labels stay. Chains of up to `most_rounds` speakers; a chunk that still changes then is an error. One row a
    chunk and round, all kept by Spark while the query runs: for chunks in the thousands, `canonical_labels` for more."""
    return labels.sparkSession.sql(
        f"""WITH RECURSIVE
        met AS (SELECT chunk_id, collect_list(struct(a, b)) AS pairs FROM {{pairs}} GROUP BY chunk_id),
        known AS (SELECT chunk_id, collect_set(speaker) AS speakers FROM {{labels}} GROUP BY chunk_id),
        first AS (SELECT k.chunk_id, map_from_arrays(speakers, speakers) AS label, coalesce(pairs, array()) AS pairs FROM known k LEFT JOIN met m ON m.chunk_id <=> k.chunk_id),
        found(chunk_id, round, label, pairs, open) MAX RECURSION LEVEL {most_rounds + 2} AS (
          SELECT chunk_id, 0, label, pairs, true FROM first
          UNION ALL
          SELECT chunk_id, round + 1, next, pairs, CASE WHEN round + 1 < {most_rounds} OR map_values(next) = map_values(label) THEN map_values(next) <> map_values(label)
            ELSE raise_error('a chain of speakers is longer than {most_rounds}') END
          FROM (SELECT *, transform_values(label, (k, v) -> array_min(concat(array(v), transform(filter(pairs, p -> p.a = k OR p.b = k), p -> least(label[p.a], label[p.b]))))) AS next FROM found) WHERE open)
        SELECT chunk_id, explode(label) AS (speaker, canonical) FROM found WHERE NOT open""",
        labels=labels, pairs=pairs,
    )


def reference_band(segments: DataFrame) -> DataFrame:
    """Segments (chunk_id, start_ms, end_ms) that may stand for their speaker's voice: of 3 to 15 seconds, in a chunk without
    any such of 1 to 25."""
    dur = F.col("end_ms") - F.col("start_ms")
    some = F.max(dur.between(3000, 15000)).over(W.partitionBy("chunk_id"))
    return segments.withColumn("some", some).where(F.when(F.col("some"), dur.between(3000, 15000)).otherwise(dur.between(1000, 25000))).drop("some")


def best_speakers(rows: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, speaker, sim: the speaker of the best cosine for each row with an embedding, the smaller label on a tie."""
    heard = rows.where("embedding IS NOT NULL").select("chunk_id", *keys, "embedding")
    scored = heard.join(centroids.select("chunk_id", F.col("speaker").alias("other"), "centroid"), "chunk_id").withColumn("sim", F.round(dot(F.col("embedding"), F.col("centroid")), 9))
    return scored.groupBy("chunk_id", *keys).agg(F.min_by(F.struct(F.col("other").alias("speaker"), "sim"), F.struct(-F.col("sim"), "other")).alias("best")).select("chunk_id", *keys, "best.*")


def reassign_short(turns: DataFrame, centroids: DataFrame, max_ms: int = 800) -> DataFrame:
    """Short turns take the speaker of the best cosine, their own on a tie; others keep theirs."""
    short = turns.where((F.col("end_ms") - F.col("start_ms") < max_ms) & F.col("embedding").isNotNull()).select("chunk_id", "turn_idx", "speaker", "embedding")
    scored = short.join(centroids.select("chunk_id", F.col("speaker").alias("other"), "centroid"), "chunk_id").withColumn("sim", F.round(dot(F.col("embedding"), F.col("centroid")), 9))
    best = scored.groupBy("chunk_id", "turn_idx").agg(F.min_by("other", F.struct(-F.col("sim"), (F.col("other") != F.col("speaker")).cast("int"), "other")).alias("best"))
    return turns.join(best, ["chunk_id", "turn_idx"], "left").select("chunk_id", "turn_idx", F.coalesce("best", "speaker").alias("speaker"))


def outlier_moves(turns: DataFrame, centroids: DataFrame) -> DataFrame:
    """Move to another centroid that is better and at least .65; a new label where own and other are under .55."""
    t = turns.where("embedding is not null").select("chunk_id", "turn_idx", "speaker", "embedding")
    scored = t.join(centroids.select("chunk_id", F.col("speaker").alias("other"), "centroid"), "chunk_id").withColumn("sim", F.round(dot(F.col("embedding"), F.col("centroid")), 9))
    g = scored.groupBy("chunk_id", "turn_idx", "speaker").agg(
        F.max(F.when(F.col("other") == F.col("speaker"), F.col("sim"))).alias("own"), F.max(F.when(F.col("other") != F.col("speaker"), F.col("sim"))).alias("best"),
        F.min_by("other", F.struct((F.col("other") == F.col("speaker")).cast("int"), -F.col("sim"), "other")).alias("best_speaker"),
    )
    own, best = F.coalesce("own", F.lit(-1.0)), F.coalesce("best", F.lit(-1.0))
    state = F.when((best > own) & (best >= 0.65), "move").when((own < 0.55) & (best < 0.55), "new").otherwise("keep")
    ranked = g.withColumn("state", state)
    new = F.format_string("NEW_%02d", F.row_number().over(W.partitionBy("chunk_id", "state").orderBy("turn_idx")))
    return ranked.select("chunk_id", "turn_idx", "state", F.when(F.col("state") == "move", F.col("best_speaker")).when(F.col("state") == "new", new).otherwise(F.col("speaker")).alias("speaker"))
