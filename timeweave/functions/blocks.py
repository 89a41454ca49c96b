"""Audio samples as blocks: a row holds a fixed number of samples as an array, a place without a sample is null.

At 24,000 samples a second a row a sample would shuffle every sample in every step. Blocks are made once, where samples come
in; levels, differences and mixes then work inside arrays, and clips meet by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_blocks(samples: DataFrame, length: int = 100, clip: str = "clip_id") -> DataFrame:
    """(clip, block, samples) of rows (clip, idx, value): block b holds places b * length to (b + 1) * length - 1. Of several
    samples at one place the last value in order stays."""
    at = F.struct(F.pmod("idx", F.lit(length)).cast("int").alias("at"), "value")
    rows = samples.groupBy(clip, F.floor(F.col("idx") / length).cast("long").alias("block")).agg(F.array_sort(F.collect_list(at)).alias("s"))
    # Whole blocks are used as they are; others get their gaps from a map.
    whole = (F.size("s") == length) & (F.size(F.array_distinct(F.transform("s", lambda x: x["at"]))) == length)
    by_place = F.map_from_entries(F.array_distinct(F.transform("s", lambda x: F.struct(x["at"], F.element_at(F.filter("s", lambda y: y["at"] == x["at"]), -1)["value"]))))
    gaps = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.try_element_at(by_place, i))
    return rows.select(clip, "block", F.when(whole, F.transform("s", lambda x: x["value"])).otherwise(gaps).alias("samples"))


def to_samples(blocks: DataFrame, *columns: str, clip: str = "clip_id", length: int = 100) -> DataFrame:
    """(clip, idx, columns) of arrays of blocks, one row for each place where any of them has a value."""
    zipped = F.arrays_zip(*columns)
    rows = blocks.select(clip, "block", F.posexplode(zipped).alias("at", "v"))
    return rows.select(clip, (F.col("block") * length + F.col("at")).alias("idx"), *[F.col(f"v.{c}").alias(c) for c in columns]).where(F.coalesce(*columns).isNotNull())


def known(samples: Column) -> Column:
    return F.filter(samples, lambda x: x.isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_square(samples: Column) -> Column:
    """Mean of squares of the values that are there; null where there are none."""
    values = known(samples)
    return F.try_divide(total(F.transform(values, lambda x: x * x)), F.size(values))


def rms(samples: Column) -> Column:
    return F.sqrt(mean_square(samples))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def mixed(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    """Weighted sum, place by place; null where one has no sample."""
    return F.zip_with(a, b, lambda x, y: weight_a * x + weight_b * y)


def pieces(samples: Column, length: int, size: int) -> Column:
    """A block's samples in pieces of `size`."""
    return F.array(*[F.slice(samples, i + 1, size) for i in range(0, length, size)])


def signal_to_noise(error: Column, range_square: float = 4.0) -> Column:
    """Decibels of a mean squared error; infinite where there is none."""
    return F.when(error == 0, float("inf")).otherwise(10 * F.log10(F.lit(range_square) / error))
