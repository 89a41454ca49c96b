"""Packing of documents into sequences by patterns of lengths.

A document is its token ids and an end id; one longer than a sequence is cut into whole sequences behind a shorter first
piece. What has to be packed is then known from the histogram of piece lengths, one number for each length up to the size
of a sequence, whatever the corpus. The plan is made from it:

* patterns of two to four lengths that fill a sequence exactly are enumerated; pairs and triples all, quadruples as pairs
  of two pair sums that the histogram has most of;
* non-negative least squares finds how often each should be used so that together they take up the histogram;
* the repeats are rounded down and cut to what is there;
* the residual is packed on counts too, best fit and longest first, each pattern found being used as often as its lengths
  last. Plans that take all or a share of the fit's repeats are compared.

A pattern takes a range of places of each of its lengths. A piece's place among those of its length, counted in the
tasks that encode and shifted by what earlier tasks counted, tells its pattern, sequence and offset. Texts and ids are never
shuffled, and no task or driver holds more than the histogram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timeweave.llm.common import release, staged
from timeweave.llm.encoding import byte_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def exact_patterns(size: int, counts: np.ndarray, most_pairs: int = 192) -> np.ndarray:
    """Rows of four lengths (0 where a pattern has fewer) that add up to `size` and occur in the histogram."""
    have = np.flatnonzero(counts[1:size] > 0) + 1
    there = np.zeros(size + 1, bool)
    there[have] = True
    a, b = np.meshgrid(have, have, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    total = a + b
    pairs = np.stack([a, b], 1)[total == size]
    rest = size - total
    keep = (rest > 0) & (rest <= b)
    a, b, rest = a[keep], b[keep], rest[keep]
    keep = there[rest]
    triples = np.stack([a[keep], b[keep], rest[keep]], 1)
    # Of the pairs of one sum, those of the most frequent lengths; a quadruple is two pairs whose sums make a sequence.
    common = have[np.argsort(-counts[have], kind="stable")[:most_pairs]]
    p, q = np.meshgrid(common, common, indexing="ij")
    p, q = p[p >= q], q[p >= q]
    order = np.argsort(-np.minimum(counts[p], counts[q]), kind="stable")
    p, q = p[order], q[order]
    first = {}
    for k, s in enumerate((p + q).tolist()):
        first.setdefault(s, []).append(k) if len(first.get(s, ())) < 4 else None
    quads = [(p[i], q[i], p[j], q[j]) for s, ks in first.items() if s <= size - s for i in ks for j in first.get(size - s, ())]
    wide = lambda x: np.pad(np.asarray(x, np.int64).reshape(-1, np.shape(x)[1] if len(x) else 4), ((0, 0), (0, 4 - (np.shape(x)[1] if len(x) else 4))))
    found = np.concatenate([wide(pairs), wide(triples), wide(quads)])
    return np.unique(-np.sort(-found, axis=1), axis=0)


def nonnegative_fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes the squared distance of the patterns' total to the counts small: accelerated projected gradients.
    A pattern's column has its lengths' multiplicities; place 0 stands for no length."""
    weight = (patterns > 0).astype(float)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (weight * x[:, None]).ravel(), minlength=len(counts))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * weight).sum(1)

    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(total(v))
        norm = np.linalg.norm(v)
        v /= norm
    x, y, t = np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(total(y) - counts) / (1.05 * norm))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


@dataclass
class Plan:
    """Patterns with their repeats: entry k gives `uses` places a sequence of one length to one pattern."""

    size: int
    counts: np.ndarray
    patterns: list[list[tuple[int, int]]] = field(default_factory=list)
    repeats: list[int] = field(default_factory=list)

    def use(self, lengths: list[int], times: int) -> None:
        kinds, uses = np.unique([x for x in lengths if x], return_counts=True)
        times = int(min(times, (self.counts[kinds] // uses).min()))
        if times > 0:
            self.counts[kinds] -= uses * times
            self.patterns.append(list(zip(kinds.tolist()[::-1], uses.tolist()[::-1])))
            self.repeats.append(times)

    def entries(self) -> pd.DataFrame:
        """length, first place, places a sequence, first sequence, first offset; sorted by length and first place."""
        taken, rows, sequence = np.zeros(self.size + 1, np.int64), [], 0
        for pattern, times in zip(self.patterns, self.repeats):
            offset = 0
            for length, uses in pattern:
                rows.append((length, int(taken[length]), uses, sequence, offset))
                taken[length] += uses * times
                offset += length * uses
            sequence += times
        out = pd.DataFrame(rows, columns=["length", "first", "uses", "sequence", "offset"])
        return out.sort_values(["length", "first"], ignore_index=True)


def fill_exactly(gap: int, counts: np.ndarray, most: int) -> list[int] | None:
    """One, two or three lengths, `most` at most, that fill the gap and are there; None where there are none. Of pairs the
    one with the longest length, of triples the one whose scarcest length is left most often."""
    if counts[gap]:
        return [gap]
    have = np.flatnonzero(counts[: gap + 1])[::-1]
    if most < 2 or not len(have):
        return None
    other = gap - have
    pair = (other > 0) & (counts[other] > (other == have))
    if pair.any():
        a = int(have[np.argmax(pair)])
        return [a, gap - a]
    if most < 3:
        return None
    a, b = np.meshgrid(have, have, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = gap - a - b
    ok = (c > 0) & (c <= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = (counts[c] > (c == b).astype(int) + (c == a)) & (counts[b] > (b == a))
    if not ok.any():
        return None
    k = np.flatnonzero(ok)[np.argmax(np.minimum(np.minimum(counts[a], counts[b]), counts[c])[ok])]
    return [int(a[k]), int(b[k]), int(c[k])]


def pack_residual(plan: Plan, most: int) -> None:
    """Best fit, longest first, on counts: the gap behind the longest length left is filled exactly where `most` lengths can,
    else by the longest that fit; the pattern found is used as often as its lengths last."""
    while plan.counts.any():
        longest = int(np.flatnonzero(plan.counts)[-1])
        pattern, rest, gap = [longest], plan.counts.copy(), plan.size - longest
        rest[longest] -= 1
        while gap:
            if (exact := fill_exactly(gap, rest, most)) is not None:
                pattern += exact
                break
            fit = np.flatnonzero(rest[: gap + 1])
            if not len(fit):
                break
            pattern.append(int(fit[-1]))
            rest[fit[-1]] -= 1
            gap -= int(fit[-1])
        plan.use(pattern, 1 << 62)


def make_plan(counts: np.ndarray, size: int, shares: tuple[float, ...] = (1.0, 0.5, 0.25)) -> Plan:
    """counts[k]: pieces of length k, up to `size`. The fit's repeats may use up short lengths that long ones need in the
    residual, so plans that take all or a share of them are made, and the one of fewest sequences is kept."""
    counts = counts.astype(np.int64)
    patterns = exact_patterns(size, counts)
    x = nonnegative_fit(patterns, counts.astype(float)) if len(patterns) else np.zeros(0)
    plans = []
    for share in shares if len(patterns) else shares[:1]:
        for most in (1, 3):
            plan = Plan(size, counts.copy())
            plan.use([size], int(counts[size]))
            for k in np.argsort(-x, kind="stable"):
                if x[k] * share < 1:
                    break
                plan.use(patterns[k].tolist(), int(x[k] * share))
            pack_residual(plan, most)
            plans.append(plan)
    return min(plans, key=lambda p: sum(p.repeats))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with the task that cut it and the piece's place among the task's pieces of its length; with
    `ids`, the token ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = byte_encoder(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), [0] * (size + 1)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["d"], pdf["t"]):
                raw = np.frombuffer(enc.encode(text), enc.dtype).astype("<u4").tobytes() + end
                n = len(raw) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part_ids = raw[4 * a : 4 * b]
                    out.append((None if pd.isna(doc_id) else int(doc_id), k, a, b - a, zlib.crc32(part_ids), part, seen[b - a], *([part_ids] if ids else [])))
                    seen[b - a] += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")] + ["ids"] * ids).astype({"doc_id": "Int64"})
        release(encoders=False)

    # Ids travel as text: a null would turn a pandas column of them into floats.
    return docs.select(F.col(id_col).cast("long").cast("string").alias("d"), F.col(text_col).alias("t")).mapInPandas(run, PIECES + ", ids binary" * ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with `ids`, the piece's token ids.

    Null and empty texts are one end id. A null id is kept as null, rows that share an id are packed each (their pieces
    count from 0 each). Extra columns are not read. An empty table gives no rows. Sequences are numbered from 0 without
    gaps; which documents share one follows the table's file layout, how many sequences there are does not.
    """
    cut = staged(pieces(docs, tokenizer, end_id, size, ids, id_col, text_col), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    starts = staged(by_part.select("length", "part", "n", before), "starts")
    counts = np.zeros(size + 1, np.int64)
    for length, n in starts.groupBy("length").agg(F.sum("n")).collect():  # a row a length
        counts[length] = n
    plan = make_plan(counts, size).entries()
    key = plan["length"].to_numpy() << 44 | plan["first"].to_numpy()
    first, uses, sequence, offset = (plan[c].to_numpy() for c in ("first", "uses", "sequence", "offset"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, place = pdf["length"].to_numpy(), pdf["at"].to_numpy()
            k = np.searchsorted(key, length << 44 | place, "right") - 1
            turn, slot = np.divmod(place - first[k], uses[k])
            yield pdf.assign(sequence_id=sequence[k] + turn, offset=offset[k] + slot * length).drop(columns="at")

    out = "length long, at long, doc_id string, piece int, start long, ids_crc32 long" + ", ids binary" * ids
    rows = cut.join(starts.drop("n"), ["length", "part"]).withColumn("at", F.col("place") + F.col("before")).withColumn("doc_id", F.col("doc_id").cast("string"))
    done = rows.select(*(c.split()[0] for c in out.split(", "))).mapInPandas(assign, out.replace("at long, ", "") + ", sequence_id long, offset long")
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)
