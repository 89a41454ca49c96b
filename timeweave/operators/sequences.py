"""Window and sequence operators over ordered rows of a chunk.

Rules that reset at a break are windows (gaps and islands). Rules where a row's fate depends on decisions already made
are scans: `scan` lets a chunk's ordered rows pass by a small rule object, one Arrow batch at a time, so a chunk may have any
length. `fold` hands a whole chunk to a function; chunks are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from timeweave.functions.text import is_outlier
from timeweave.functions.vectors import iou


def fold(rows: DataFrame, order: list[str], step: Callable[[dict[str, list]], dict[str, list]], schema: str, key: str = "chunk_id") -> DataFrame:
    """Run `step` over each chunk's rows in order; it gets and returns columns as lists. For rules that look a whole chunk over."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = step({c: v.tolist() for c, v in pdf.sort_values(order).items()})
        return pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandas(run, schema)


class Scan:
    """A rule that walks over a chunk's rows once. A new one is made for each chunk; `take` gets the next columns as lists
    and returns the rows that are settled by then, as columns, `close` the rest."""

    def take(self, c: dict[str, list]) -> dict[str, list]:
        raise NotImplementedError

    def close(self) -> dict[str, list]:
        return {}


def scan(rows: DataFrame, order: list[str], make: Callable[[], Scan], schema: str, key: str = "chunk_id") -> DataFrame:
    """Run a `Scan` over each chunk's rows in order, batch by batch: a chunk of any length takes the memory of one batch.

    Chunks are sorted on disk by Spark and pass by a task as Arrow batches. The key is the first column of `schema` and is
    added to what the rule returns; numbers without nulls come as whole numbers.
    """
    names, kept = [c.split()[0] for c in schema.split(", ")], rows.columns
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(target)
        now, rule = None, None

        def made(value, out: dict[str, list]) -> Iterator[pa.RecordBatch]:
            n = len(next(iter(out.values()), []))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([value] * n if c == names[0] else out[c], kinds.field(c).type) for c in names], schema=kinds)

        for batch in batches:
            values, n = batch.column(kept.index(key)), batch.num_rows
            cuts = [0, *(np.flatnonzero(pc.not_equal(values[1:], values[:-1]).fill_null(True).to_numpy(zero_copy_only=False)) + 1).tolist(), n] if n else []
            for a, b in zip(cuts, cuts[1:]):
                part, value = batch.slice(a, b - a), values[a].as_py()
                if rule is None or value != now:
                    if rule is not None:
                        yield from made(now, rule.close())
                    now, rule = value, make()
                yield from made(now, rule.take({c: part.column(i).to_pylist() if part.column(i).null_count or not pa.types.is_integer(part.column(i).type) else part.column(i).to_numpy().tolist() for i, c in enumerate(kept) if c != key}))
        if rule is not None:
            yield from made(now, rule.close())

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def collapse_turns(turns: DataFrame, gap_ms: int = 300) -> DataFrame:
    """Join adjacent turns of a speaker whose gap to the running end is under gap_ms."""
    w = W.partitionBy("chunk_id").orderBy("turn_idx")
    runs = turns.withColumn("change", F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("change").over(w))
    before = F.max("end_ms").over(W.partitionBy("chunk_id", "run").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, -1))
    isles = runs.withColumn("new", F.when(F.col("start_ms") - before < gap_ms, 0).otherwise(1)).withColumn("isle", F.sum("new").over(w))
    return isles.groupBy("chunk_id", "isle").agg(F.min("turn_idx").alias("turn_idx"), F.min_by("speaker", "turn_idx").alias("speaker"), F.min_by("start_ms", "turn_idx").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("isle")


def absorb_short(turns: DataFrame, min_ms: int = 500) -> DataFrame:
    """Short turns go into the one before: its label, their end (not the larger). A first turn is never absorbed."""
    w = W.partitionBy("chunk_id").orderBy("turn_idx")
    head = (F.col("end_ms") - F.col("start_ms") >= min_ms) | (F.row_number().over(w) == 1)
    isles = turns.withColumn("head", head).withColumn("isle", F.sum(F.col("head").cast("int")).over(w))
    return isles.groupBy("chunk_id", "isle").agg(F.min("turn_idx").alias("turn_idx"), F.min_by("speaker", "turn_idx").alias("speaker"), F.min_by("start_ms", "turn_idx").alias("start_ms"), F.max_by("end_ms", "turn_idx").alias("end_ms")).drop("isle")


def contaminated(words: DataFrame, levels: DataFrame | None = None, quiet: float = 0.005) -> DataFrame:
    """Words over 3 s or under 20 ms, and runs of three of equal length and gap (within 50 ms) over 1 s with gaps over .3 s;
    with levels (chunk_id, word_idx, rms), also words that are quieter than `quiet` or outside the audio."""
    w = W.partitionBy("chunk_id").orderBy("word_idx")
    d = F.col("end_ms") - F.col("start_ms")
    x = words.withColumn("d", d).withColumn("g", F.lead("start_ms").over(w) - F.col("end_ms"))
    x = x.withColumns({"d1": F.lead("d", 1).over(w), "d2": F.lead("d", 2).over(w), "g1": F.lead("g", 1).over(w)})
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 50
    starts = near("d", "d1") & near("d1", "d2") & near("g", "g1") & (F.col("d") > 1000) & (F.col("g") > 300)
    x = x.withColumn("run", F.coalesce(starts, F.lit(False)))
    three = F.max("run").over(w.rowsBetween(-2, 0))
    flags = x.select("chunk_id", "word_idx", ((F.col("d") > 3000) | (F.col("d") < 20)).alias("bad_length"), three.alias("bad_rhythm"))
    if levels is None:
        return flags
    heard = flags.join(levels.select("chunk_id", "word_idx", "rms"), ["chunk_id", "word_idx"], "left")
    return heard.select("chunk_id", "word_idx", "bad_length", "bad_rhythm", F.coalesce(F.col("rms") < quiet, F.lit(True)).alias("bad_level"))


class GapSegments(Scan):
    def __init__(self, hard_ms: int, soft_ms: int, soft_after_ms: int, most_ms: int):
        self.hard, self.soft, self.soft_after, self.most = hard_ms, soft_ms, soft_after_ms, most_ms
        self.segment, self.start, self.end = 0, None, None

    def take(self, c: dict[str, list]) -> dict[str, list]:
        number, segment, start, end = [], self.segment, self.start, self.end
        for s, e in zip(c["start_ms"], c["end_ms"]):
            if start is None:
                start = s
            elif s - end > self.hard or (s - end > self.soft and end - start >= self.soft_after) or end - start >= self.most:
                segment, start = segment + 1, s
            end = e
            number.append(segment)
        self.segment, self.start, self.end = segment, start, end
        return {"word_idx": c["word_idx"], "segment": number}


def gap_segments(words: DataFrame, hard_ms: int = 1500, soft_ms: int = 400, soft_after_ms: int = 3000, most_ms: int = 15000) -> DataFrame:
    """Segment number of each word: a break before a word after a long gap, a short gap once long enough, or too long."""
    rows = words.select("chunk_id", "word_idx", "start_ms", "end_ms")
    return scan(rows, ["word_idx"], lambda: GapSegments(hard_ms, soft_ms, soft_after_ms, most_ms), "chunk_id long, word_idx long, segment long")


class PunctSegments(Scan):
    def __init__(self, most_ms: int, most_words: int):
        self.most_ms, self.most_words = most_ms, most_words
        self.segment, self.start, self.n = 0, None, 0

    def take(self, c: dict[str, list]) -> dict[str, list]:
        number, segment, start, n = [], self.segment, self.start, self.n
        for s, e, mark in zip(c["start_ms"], c["end_ms"], c["mark"]):
            start, n = (s, 1) if start is None else (start, n + 1)
            number.append(segment)
            if mark or e - start >= self.most_ms or n >= self.most_words:
                segment, start = segment + 1, None
        self.segment, self.start, self.n = segment, start, n
        return {"word_idx": c["word_idx"], "segment": number}


def punct_segments(words: DataFrame, most_ms: int = 12000, most_words: int = 30) -> DataFrame:
    """Segment number of each word: a break after an end mark, a long run or many words."""
    marked = words.select("chunk_id", "word_idx", "start_ms", "end_ms", F.right("word", F.lit(1)).isin(".", "?", "!").alias("mark"))
    return scan(marked, ["word_idx"], lambda: PunctSegments(most_ms, most_words), "chunk_id long, word_idx long, segment long")


class MergeShort(Scan):
    """Holds the group that the next one may still join."""

    def __init__(self, short_ms: int, most_ms: int):
        self.short, self.most, self.open = short_ms, most_ms, None

    def _columns(self, rows: list[tuple]) -> dict[str, list]:
        return {k: [r[i] for r in rows] for i, k in enumerate(("group_idx", "start_ms", "end_ms", "n"))}

    def take(self, c: dict[str, list]) -> dict[str, list]:
        done, now = [], self.open
        for g, s, e in zip(c["group_idx"], c["start_ms"], c["end_ms"]):
            if now and min(now[2] - now[1], e - s) < self.short and e - now[1] <= self.most:
                now = (now[0], now[1], e, now[3] + 1)
            else:
                if now:
                    done.append(now)
                now = (g, s, e, 1)
        self.open = now
        return self._columns(done)

    def close(self) -> dict[str, list]:
        return self._columns([self.open] if self.open else [])


def merge_short(groups: DataFrame, short_ms: int = 1500, most_ms: int = 12000) -> DataFrame:
    """Merge a group with the one before if either is short and both together are not long."""
    rows = groups.select("chunk_id", "group_idx", "start_ms", "end_ms")
    return scan(rows, ["group_idx"], lambda: MergeShort(short_ms, most_ms), "chunk_id long, group_idx long, start_ms long, end_ms long, n long")


class SmoothAba(Scan):
    """Holds the last two rows: a row is settled when the one after it is known."""

    def __init__(self, order: str, label: str):
        self.order, self.label, self.before, self.open = order, label, [], None

    def take(self, c: dict[str, list]) -> dict[str, list]:
        places, labels, before, now = [], [], self.before, self.open
        for place, said in zip(c[self.order], c[self.label]):
            if now is not None:
                if before and before[0] is not None and before[0] == said:
                    now = (now[0], said)
                places.append(now[0])
                labels.append(now[1])
                before = [now[1]]
            now = (place, said)
        self.before, self.open = before, now
        return {self.order: places, self.label: labels}

    def close(self) -> dict[str, list]:
        return {self.order: [self.open[0]], self.label: [self.open[1]]} if self.open else {}


def smooth_aba(rows: DataFrame, order: str, label: str = "speaker", key: str = "chunk_id") -> DataFrame:
    """A-B-A becomes A-A-A from left to right; a smoothed label counts for the next test."""
    kind = dict(rows.dtypes)[order]
    return scan(rows.select(key, order, label), [order], lambda: SmoothAba(order, label), f"{key} long, {order} {kind}, {label} string", key)


def split_by_speaker(words: DataFrame, group: str, label: str = "speaker") -> DataFrame:
    """(chunk_id, word_idx, speaker, part): A-B-A is smoothed inside each group of words, then a group is cut where the
    speaker changes; parts are numbered through the chunk."""
    numbered = words.withColumn("__place", F.dense_rank().over(W.partitionBy("chunk_id").orderBy(group)).cast("long"))
    keyed = numbered.select("chunk_id", "word_idx", "__place", F.xxhash64("chunk_id", "__place").alias("__group"), label)
    smooth = smooth_aba(keyed, "word_idx", label, "__group").withColumnRenamed(label, "__said")
    both = keyed.join(smooth, ["__group", "word_idx"])
    w = W.partitionBy("chunk_id").orderBy("__place", "word_idx")
    new = (F.col("__place") != F.lag("__place").over(w)) | (F.col("__said") != F.lag("__said").over(w))
    return both.withColumn("__new", F.coalesce(new.cast("long"), F.lit(0))).select("chunk_id", "word_idx", F.col("__said").alias(label), F.sum("__new").over(w).alias("part"))


def _runs(rows: DataFrame, order: str, label: str) -> DataFrame:
    """Rows with the number of their run of equal labels and that run's length."""
    w = W.partitionBy("chunk_id").orderBy(order)
    cut = rows.withColumn("__new", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1)))
    numbered = cut.withColumn("__run", F.sum("__new").over(w)).drop("__new")
    return numbered.withColumn("__size", F.count("*").over(W.partitionBy("chunk_id", "__run")))


def smooth_runs(rows: DataFrame, order: str, label: str = "speaker", least: int = 2) -> DataFrame:
    """Runs shorter than `least` take the smoothed label before them, at the start the one after; short inputs stay.

    The label before a short run is that of the last run long enough; short runs at the start take the second run's.
    """
    w = W.partitionBy("chunk_id").orderBy(order)
    x = _runs(rows.select("chunk_id", order, label), order, label)
    whole = W.partitionBy("chunk_id")
    x = x.withColumn("__n", F.count("*").over(whole)).withColumn("__second", F.first(F.when(F.col("__run") == 2, F.col(label)), ignorenulls=True).over(whole))
    held = F.last(F.when(F.col("__size") >= least, F.col(label)), ignorenulls=True).over(w)
    return x.select("chunk_id", order, F.when(F.col("__n") < 2 * least, F.col(label)).otherwise(F.coalesce(held, "__second", label)).alias(label))


def face_changes(frames: DataFrame, fps: int = 25, min_ms: int = 500) -> DataFrame:
    """(chunk_id, frame, track): where a new face stays on; frames without a face are passed over.

    A run of one face is settled when it has enough frames. A settled run of another face than the settled one before
    is a change; it begins with the face's first frame since any third face was seen. A change lies beyond the frames
    that settled the face before it, so two changes are never closer than that.
    """
    least = max(2, min_ms * fps // 1000)
    seen = _runs(frames.where("track IS NOT NULL").select("chunk_id", "frame", "track"), "frame", "track")
    runs = seen.groupBy("chunk_id", "__run").agg(F.first("track").alias("track"), F.min("frame").alias("frame"), F.first("__size").alias("n"))
    w = W.partitionBy("chunk_id").orderBy("__run")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    settled = F.col("n") >= least
    x = runs.withColumn("held", F.last(F.when(settled, F.col("track")), ignorenulls=True).over(before))
    x = x.where(F.col("held").isNull() | (F.col("track") != F.col("held"))).withColumn("settled", settled)
    x = x.withColumn("epoch", F.coalesce(F.sum(F.col("settled").cast("int")).over(before), F.lit(0)))
    inside = W.partitionBy("chunk_id", "epoch").orderBy("__run")
    x = x.withColumn("new", F.coalesce((F.col("track") != F.lag("track").over(inside)).cast("int"), F.lit(1))).withColumn("chain", F.sum("new").over(inside))
    begun = F.min("frame").over(W.partitionBy("chunk_id", "epoch", "chain"))
    return x.withColumn("begun", begun).where("settled AND held IS NOT NULL").select("chunk_id", F.col("begun").alias("frame"), "track")


class SilenceCuts(Scan):
    """Holds the silences near the next target. A target is settled once speech goes on beyond its slack and the tail, or at
    the chunk's end."""

    def __init__(self, every_ms: int, slack_ms: int, tail_ms: int):
        self.every, self.slack, self.tail = every_ms, slack_ms, tail_ms
        self.target, self.end, self.total, self.gaps, self.cuts = every_ms, None, None, [], 0

    def _settle(self, last: bool) -> list[int]:
        out = []
        while self.target < self.total and (last or self.total - self.tail >= self.target + self.slack):
            low, high = self.target - self.slack, min(self.target + self.slack, self.total - self.tail)
            near = [g for g in self.gaps if g[1] >= low and g[2] <= high]
            out.append(max(near, key=lambda g: (g[2] - g[1], -g[1]))[0] if near else self.target)
            self.target = out[-1] + self.every
            self.gaps = [g for g in self.gaps if g[1] >= self.target - self.slack]
        return out

    def _columns(self, cuts: list[int]) -> dict[str, list]:
        first, self.cuts = self.cuts, self.cuts + len(cuts)
        return {"cut_idx": list(range(first, self.cuts)), "cut_ms": cuts}

    def take(self, c: dict[str, list]) -> dict[str, list]:
        cuts = []
        for s, e in zip(c["start_ms"], c["end_ms"]):
            if self.end is not None and s > self.end and self.end >= self.target - self.slack:
                self.gaps.append(((self.end + s) // 2, self.end, s))
            self.end = e
            if self.total is None or e > self.total:
                # Silences known so far end before this speech starts, so those of settled targets are all here.
                self.total = s if self.total is None else max(self.total, s)
                cuts += self._settle(False)
                self.total = e
        return self._columns(cuts)

    def close(self) -> dict[str, list]:
        return self._columns(self._settle(True) if self.total is not None else [])


def silence_cuts(speech: DataFrame, every_ms: int = 60000, slack_ms: int = 5000, tail_ms: int = 1000) -> DataFrame:
    """Cut points near every target: the middle of the longest silence that lies within the slack (and ends tail_ms before
    the end), the first on a tie, else the target itself. The next target counts from the cut."""
    rows = speech.select("chunk_id", "speech_idx", "start_ms", "end_ms")
    return scan(rows, ["start_ms", "speech_idx"], lambda: SilenceCuts(every_ms, slack_ms, tail_ms), "chunk_id long, cut_idx long, cut_ms long")


def nms(boxes: DataFrame, limit: float = 0.3) -> DataFrame:
    """Greedy suppression per frame: keep the best score (the smaller track on a tie), drop boxes that overlap a kept one by
    more than the limit. One expression over each frame's boxes."""
    corners = ("x1", "y1", "x2", "y2")
    side = lambda b: [b[c] for c in corners]
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("place"), "track", *corners)))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: iou(side(x), side(k)) > limit), acc).otherwise(F.concat(acc, F.array(x))))
    return boxes.groupBy("chunk_id", "frame").agg(best_first.alias("b")).select("chunk_id", "frame", F.explode(F.transform(kept, lambda x: x["track"])).alias("track"))


def synth_groups(segments: DataFrame, gap_ms: int = 300) -> DataFrame:
    """Group number of consecutive segments with the same speaker and emotion and a short gap to the one right before."""
    w = W.partitionBy("chunk_id").orderBy("segment_id")
    same = (F.col("speaker") == F.lag("speaker").over(w)) & (F.col("emotion") == F.lag("emotion").over(w)) & (F.col("start_ms") - F.lag("end_ms").over(w) < gap_ms)
    return segments.withColumn("new", F.coalesce((~same).cast("int"), F.lit(1))).withColumn("group_idx", F.sum("new").over(w) - 1).drop("new")


def slot_limits(groups: DataFrame, order: str = "group_idx") -> DataFrame:
    """Longest duration of a group: up to 50 ms before the next start (or the chunk's end), at least 100 ms."""
    w = W.partitionBy("chunk_id").orderBy(order)
    end = F.max("end_ms").over(W.partitionBy("chunk_id"))
    return groups.withColumn("slot_ms", F.greatest(F.lit(100), F.coalesce(F.lead("start_ms").over(w), end) - F.col("start_ms") - 50))


def pingpong(frames: DataFrame, per: str, idx: str, m: int) -> DataFrame:
    """Sequence of length m that runs to the end, back to the start, and so on; each end is shown twice."""
    sizes = frames.groupBy(per).agg(F.count("*").alias("n"))
    out = sizes.select(per, "n", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("pos"))
    at = F.pmod(F.col("pos"), 2 * F.col("n"))
    return out.select(per, "pos", F.when(at < F.col("n"), at).otherwise(2 * F.col("n") - 1 - at).alias(idx)).join(frames, [per, idx])


class AbsorbOutliers(Scan):
    def __init__(self, max_ms: int):
        self.max_ms, self.last = max_ms, None

    def take(self, c: dict[str, list]) -> dict[str, list]:
        label, last = [], self.last
        for said, start, end, odd, next_ms, next_said in zip(*(c[k] for k in ("speaker", "start_ms", "end_ms", "odd", "next_ms", "next_speaker"))):
            near = [(abs(start - last[0]), 0, last[1])] if last else []
            if next_said is not None:
                near.append((abs(next_ms - end), 1, next_said))
            absorbed = odd and end - start < self.max_ms and bool(near)
            label.append(min(near)[2] if absorbed else said)
            if absorbed or not odd:
                last = (end, label[-1])
        self.last = last
        return {"segment_id": c["segment_id"], "speaker": label}


def absorb_outliers(segments: DataFrame, max_ms: int = 400) -> DataFrame:
    """Short segments of outlier speakers (number over 90) take the label of the nearest main neighbour in time, the one
    before on a tie; an absorbed one counts as main for later rows. Distances are absolute, so overlaps count as well."""
    ahead = W.partitionBy("chunk_id").orderBy(F.desc("segment_id")).rowsBetween(W.unboundedPreceding, -1)
    main = F.when(~is_outlier(F.col("speaker")), F.struct("start_ms", "speaker"))
    rows = segments.withColumn("next", F.last(main, ignorenulls=True).over(ahead))
    rows = rows.select("chunk_id", "segment_id", "speaker", "start_ms", "end_ms", is_outlier(F.col("speaker")).alias("odd"), F.col("next.start_ms").alias("next_ms"), F.col("next.speaker").alias("next_speaker"))
    return scan(rows, ["segment_id"], lambda: AbsorbOutliers(max_ms), "chunk_id long, segment_id long, speaker string")


def trim_short(segments: DataFrame, words: DataFrame, most_words: int = 3, least_ms: int = 5000, spoken_ms: int = 1000, pad_ms: int = 200) -> DataFrame:
    """(chunk_id, segment_id, start_ms, end_ms): a long segment of few words shrinks to its words and a pad at both ends.

    Words are those with the segment's number as turn; segments without words stay as they are.
    """
    spans = words.groupBy("chunk_id", F.col("turn").alias("segment_id")).agg(F.min("start_ms").alias("ws"), F.max("end_ms").alias("we"), F.count("*").alias("n"))
    x = segments.select("chunk_id", "segment_id", "start_ms", "end_ms").join(spans, ["chunk_id", "segment_id"], "left")
    trim = F.coalesce((F.col("n") <= most_words) & (F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.col("we") - F.col("ws") >= spoken_ms), F.lit(False))
    start, end = F.greatest("start_ms", F.col("ws") - pad_ms), F.least("end_ms", F.col("we") + pad_ms)
    return x.select("chunk_id", "segment_id", F.when(trim, start).otherwise(F.col("start_ms")).alias("start_ms"), F.when(trim, end).otherwise(F.col("end_ms")).alias("end_ms"))


def sliding(segments: DataFrame, window_ms: int = 600, hop_ms: int = 200) -> DataFrame:
    """(chunk_id, segment_id, t_ms): starts of the windows that fit into each segment."""
    fit = segments.where(F.col("end_ms") - F.col("start_ms") >= window_ms)
    return fit.select("chunk_id", "segment_id", F.explode(F.sequence("start_ms", F.col("end_ms") - window_ms, F.lit(hop_ms).cast("long"))).alias("t_ms"))


def global_rank(rows: DataFrame, order: str, by: list[str] | None = None, block: int = 10_000) -> DataFrame:
    """Position r (from 1) of each row by a whole-number column, within `by`, without one task that sees all rows: ranks
    inside blocks of the value, plus the rows of earlier blocks, of which there is one count each."""
    by = by or []
    cut = rows.withColumn("__block", F.floor(F.col(order) / block))
    counts = cut.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "__block", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy(*by, "__block").orderBy(order))
    return cut.withColumn("__r", inside).join(offsets, [*by, "__block"]).withColumn("r", F.col("__r") + F.col("__before")).drop("__block", "__r", "__before")
