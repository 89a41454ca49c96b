"""Time, frame and log-line functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a progress line, and the faults and harmless marks of a crash line below.
STEP = r"Steps:\s+\d+%\|[^|]*\|\s+(\d+)/(\d+)\s+\[\S+,\s+([\d.]+)\s*(s/it|it/s)[^\]]*step_loss=([\d.eE+-]+)"


def format_seconds(s: Column) -> Column:
    s = F.floor(s).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%dh %dmin", h, m)).when(m > 0, F.format_string("%dmin %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def parse_step(line: Column) -> Column:
    """(step, total, speed in steps a second, loss), null where the line is not a progress line."""
    part = lambda i: F.regexp_extract(line, STEP, i)
    rate = part(3).cast("double")
    speed = F.when(part(4) == "it/s", rate).otherwise(F.coalesce(F.try_divide(F.lit(1.0), rate), F.lit(0.0)))
    return F.when(line.rlike(STEP), F.struct(part(1).cast("long").alias("step"), part(2).cast("long").alias("total"), speed.alias("speed"), part(5).cast("double").alias("loss")))


def is_crash(line: Column, age_s: Column | None = None) -> Column:
    """A fault that is none of the benign ones; with the log's age, none while it was written within five minutes."""
    low = F.lower(line)
    # Marks of lines that are no crash.
    benign = ["fp16", "dtype", "onnxruntime", "providerlibrary", "cublaslt", "tryget"]
    found = line.rlike("RuntimeError|FAILED") & ~low.rlike("|".join(benign))
    return found if age_s is None else found & (age_s >= 300)


def ratio_string(text: Column) -> Column:
    """30000/1001 as a number; a plain number as itself; null if neither or divided by zero."""
    parts = F.split(text, "/")
    top, low = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.try_divide(top, low)


def frame_of(ms: Column, fps: int) -> Column:
    return F.floor(ms * fps / 1000).cast("long")


def ms_of(frame: Column, fps: int) -> Column:
    return F.floor(frame * 1000 / fps).cast("long")


def sample_of(ms: Column, rate: int = 24000) -> Column:
    return F.floor(ms * rate / 1000).cast("long")


def eta_seconds(step: Column, total: Column, speed: Column) -> Column:
    left = F.greatest(F.lit(0), total - step)
    return F.when((speed > 0) & (left > 0), left / speed)
