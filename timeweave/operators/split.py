"""Scans over chunks that are too long for one task: a chunk is cut into blocks and joined by a pass over states.

A rule whose state is small maps the state before a block to the state behind it. Each block's map is written down as a
short table, whatever the state will be; the maps of a chunk's blocks are then applied one after the other, and with the
state before it known, every block gives its rows on its own. Blocks are cut by range, so a chunk that holds most rows is
spread over as many tasks as its rows need; only tables and states meet.

* E5: a segment's start x matters up to the block's first break. Word i breaks it where x is at most a bound T(i); the
  first such i is found in the bounds that are larger than all before, by bisection. What follows a break at i does not
  depend on x. Bounds beyond the block's first word need no entry, as no segment before it starts later.
* E6: the same with one more bound, the number of words that are left.
* E10: a smoothed label is the row's own or the next row's, so a block has two ways through it.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.operators.lineage import staged
from timeweave.operators.sequences import GapSegments, PunctSegments, Scan, SmoothAba


class SplitScan(Scan):
    """A scan with a state that can be carried over blocks."""

    def state(self):
        """What later rows depend on."""
        raise NotImplementedError

    def resume(self, state) -> None:
        raise NotImplementedError

    def table(self, c: dict[str, list]):
        """The map of a block that this rule has not seen the rows before of."""
        raise NotImplementedError

    def behind(self, table, state):
        """The state behind a block from the state before it."""
        raise NotImplementedError


class _Breaks(SplitScan):
    """Rules that cut rows into segments: what happens behind a row depends on the row with which its segment starts."""

    def _ends(self, n: int, first_break: Callable[[int], int | None]) -> Callable[[int], tuple]:
        """ends(i): (start of the last segment, breaks) if a segment starts at row i of n."""
        known: dict[int, tuple] = {}

        def ends(i: int) -> tuple:
            path = []
            while i not in known:
                path.append(i)
                if i >= n or (j := first_break(i)) is None:
                    known[i] = (i, 0)
                else:
                    i = j
            start, breaks = known[i]
            for k in reversed(path):
                if k != i:
                    breaks += 1
                known[k] = (start, breaks)
            return known[path[0]] if path else known[i]

        return ends


class SplitGapSegments(GapSegments, _Breaks):
    def state(self):
        return self.segment, self.start, self.end

    def resume(self, state) -> None:
        self.segment, self.start, self.end = state

    def _bound(self, s: int, before: int) -> float:
        """A segment that starts at this time or earlier breaks before a word at s, the last one having ended at `before`."""
        gap = s - before
        return float("inf") if gap > self.hard else before - (min(self.soft_after, self.most) if gap > self.soft else self.most)

    def table(self, c: dict[str, list]):
        starts, ends_at = c["start_ms"], c["end_ms"]
        bounds = [self._bound(s, e) for s, e in zip(starts[1:], ends_at)]

        def first_break(i: int) -> int | None:
            return next((j + 1 for j in range(i, len(bounds)) if starts[i] <= bounds[j]), None)

        ends = self._ends(len(starts), first_break)
        made = lambda i: (starts[ends(i)[0]], ends(i)[1])
        record, highest = [], float("-inf")
        for j, bound in enumerate(bounds):
            if bound > highest:
                record.append((bound, *made(j + 1)))
                highest = bound
            if highest >= starts[0]:
                break
        return starts[0], made(0), record, ends_at[-1]

    def behind(self, table, state):
        segment, x, end = state
        first, at_first, record, last = table
        if x is None:
            return segment + at_first[1], at_first[0], last
        if x <= self._bound(first, end):
            return segment + 1 + at_first[1], at_first[0], last
        k = bisect_left(record, x, key=lambda r: r[0])
        if k < len(record):
            return segment + 1 + record[k][2], record[k][1], last
        return segment, x, last


class SplitPunctSegments(PunctSegments, _Breaks):
    def state(self):
        return self.segment, self.start, 0 if self.start is None else self.n

    def resume(self, state) -> None:
        self.segment, self.start, self.n = state

    def table(self, c: dict[str, list]):
        starts, n = c["start_ms"], len(c["start_ms"])
        bounds = [float("inf") if mark else e - self.most_ms for e, mark in zip(c["end_ms"], c["mark"])]

        def first_break(i: int) -> int | None:
            """The row behind the one that ends a segment which starts at row i."""
            return next((j + 1 for j in range(i, n) if starts[i] <= bounds[j] or j - i + 1 >= self.most_words), None)

        ends = self._ends(n, first_break)

        def made(i: int) -> tuple:
            """State behind the block if a segment starts at row i: (start, words of it, breaks)."""
            start, breaks = ends(i)
            return (starts[start], n - start, breaks) if start < n else (None, 0, breaks)

        record, highest = [], float("-inf")
        for j, bound in enumerate(bounds):
            if bound > highest:
                record.append((bound, j))
                highest = bound
            if highest >= starts[0]:
                break
        reach = min(n, max([self.most_words, *(j + 1 for _, j in record)]))
        return n, [made(i) for i in range(reach + 1)], record

    def behind(self, table, state):
        segment, x, words = state
        n, made, record = table
        if x is None:
            start, count, breaks = made[0]
            return segment + breaks, start, count
        k = bisect_left(record, x, key=lambda r: r[0])
        broken = min(record[k][1] if k < len(record) else n, max(0, self.most_words - words - 1))
        if broken >= n:
            return segment, x, words + n
        start, count, breaks = made[broken + 1]
        return segment + 1 + breaks, start, count


class SplitSmoothAba(SmoothAba, SplitScan):
    def state(self):
        return self.before, self.open

    def resume(self, state) -> None:
        self.before, self.open = state

    def table(self, c: dict[str, list]):
        said, place = c[self.label], c[self.order][-1]

        def through(label):
            """Smoothed label of the last row but one if the first row's is `label`."""
            for own, after in zip(said[1:], said[2:]):
                label = label if label is not None and label == after else own
            return label

        ways = {x: through(x) for x in dict.fromkeys(said[:2])} if len(said) > 1 else {}
        return said[:2], ways, (place, said[-1])

    def behind(self, table, state):
        before, now = state
        head, ways, last = table
        if now is not None:
            same = before and before[0] is not None and before[0] == head[0]
            before = [head[0] if same else now[1]]
        if len(head) < 2:
            return before, last
        same = before and before[0] is not None and before[0] == head[1]
        return [ways[head[1] if same else head[0]]], last


def split_scan(rows: DataFrame, order: list[str], make: Callable[[], SplitScan], schema: str, key: str = "chunk_id", block_rows: int = 50_000) -> DataFrame:
    """Run a rule over each chunk's rows in order, as `sequences.scan` does, with chunks cut into blocks of at most
    `block_rows` rows. The key and the columns that the rule takes must not be null."""
    names, given = [c.split()[0] for c in schema.split(", ")], dict(rows.dtypes)
    columns = [c for c in rows.columns if c != key]
    held = ", ".join([f"{key} {given[key]}", "block long", *(f"{c} array<{given[c]}>" for c in columns), "map binary"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_ = None, {c: [] for c in columns}
        done, held = [], 0

        def block(value, at: int) -> tuple:
            return (value, at, *(open_[c] for c in columns), pickle.dumps(make().table(open_)))

        def frame() -> pd.DataFrame:
            return pd.DataFrame(done, columns=[key, "block", *columns, "map"])

        for pdf in batches:
            values = pdf[key].tolist()
            fresh = {c: pdf[c].tolist() for c in columns}
            places, a = pdf["__at"].tolist(), 0
            while a < len(values):
                if now is not None and (values[a] != now[0] or len(open_[columns[0]]) >= block_rows):
                    done.append(block(*now))
                    held += len(open_[columns[0]])
                    now, open_ = None, {c: [] for c in columns}
                    if held >= block_rows:
                        yield frame()
                        done, held = [], 0
                now = now or (values[a], places[a])
                room = block_rows - len(open_[columns[0]])
                b = a + 1
                while b < len(values) and b - a < room and values[b] == now[0]:
                    b += 1
                for c in columns:
                    open_[c] += fresh[c][a:b]
                a = b
        if now is not None:
            done.append(block(*now))
            yield frame()

    by = [key, *order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    blocks = staged(sorted_.mapInPandas(cut, held), "blocks")

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tables() -> Iterator[tuple]:
            for pdf in batches:
                yield from zip(pdf[key].tolist(), pdf["block"].tolist(), pdf["map"])

        def found() -> Iterator[tuple]:
            for value, parts in groupby(tables(), key=lambda r: r[0]):
                rule, waiting = make(), None
                state = rule.state()
                for _, block, table in parts:
                    if waiting is not None:
                        yield value, *waiting, False
                    waiting = (block, pickle.dumps(state))
                    state = rule.behind(pickle.loads(table), state)
                yield value, *waiting, True

        rows_ = found()
        while some := list(islice(rows_, 1000)):
            yield pd.DataFrame(some, columns=[key, "block", "entry", "last"])

    entries = blocks.select(key, "block", "map").repartition(key).sortWithinPartitions(key, "block").mapInPandas(prefix, f"{key} {given[key]}, block long, entry binary, last boolean")

    def joined(out: list[dict[str, list]]) -> pd.DataFrame:
        return pd.DataFrame({c: list(chain.from_iterable(o[c] for o in out)) for c in names})

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, n = [], 0
            for r in pdf.to_dict("records"):
                rule = make()
                rule.resume(pickle.loads(r["entry"]))
                parts = [rule.take({c: list(r[c]) for c in columns})] + ([rule.close()] if r["last"] else [])
                for part in parts:
                    if size := len(next(iter(part.values()), [])):
                        out.append({names[0]: [r[key]] * size} | part)
                        n += size
                if n >= block_rows:
                    yield joined(out)
                    out, n = [], 0
            if out:
                yield joined(out)

    return blocks.drop("map").join(entries, [key, "block"]).mapInPandas(give, schema)


def gap_segments(words: DataFrame, hard_ms: int = 1500, soft_ms: int = 400, soft_after_ms: int = 3000, most_ms: int = 15000, block_rows: int = 50_000) -> DataFrame:
    """`sequences.gap_segments` for chunks of any length."""
    rows = words.select("chunk_id", "word_idx", "start_ms", "end_ms")
    return split_scan(rows, ["word_idx"], lambda: SplitGapSegments(hard_ms, soft_ms, soft_after_ms, most_ms), "chunk_id long, word_idx long, segment long", block_rows=block_rows)


def punct_segments(words: DataFrame, most_ms: int = 12000, most_words: int = 30, block_rows: int = 50_000) -> DataFrame:
    """`sequences.punct_segments` for chunks of any length."""
    marked = words.select("chunk_id", "word_idx", "start_ms", "end_ms", F.right("word", F.lit(1)).isin(".", "?", "!").alias("mark"))
    return split_scan(marked, ["word_idx"], lambda: SplitPunctSegments(most_ms, most_words), "chunk_id long, word_idx long, segment long", block_rows=block_rows)


def smooth_aba(rows: DataFrame, order: str, label: str = "speaker", key: str = "chunk_id", block_rows: int = 50_000) -> DataFrame:
    """`sequences.smooth_aba` for chunks of any length."""
    kind = dict(rows.dtypes)[order]
    return split_scan(rows.select(key, order, label), [order], lambda: SplitSmoothAba(order, label), f"{key} long, {order} {kind}, {label} string", key, block_rows)
