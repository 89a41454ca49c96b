"""Hierarchical packing of documents into training sequences of several context sizes.

A document is its token ids plus an end id. Each task packs the documents of its own input split, so nothing
is shuffled. Whole windows of the longest context are cut off first; what is left of each document is routed to
the smallest tier that holds it. Tiers are packed from the longest to the shortest: a bin starts with one of its
tier's documents, its gap takes the longest fitting documents of shorter tiers, and the last gap is closed by
cutting a short one. Only a task's last bin can stay open; it is split into full tiers and one padded rest.
Sequences of a flush are dealt to step groups tier by tier, by attention cost in snake order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import encoder, release

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class TierPacker:
    """Pieces are (row, start, length); `rows` holds (doc_id, ids, doc_tokens) until every piece of it is placed."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.longest = self.tiers[-1]
        self.pool: list[list[tuple]] = [[] for _ in range(self.longest + 1)]
        self.mask, self.held = 0, 0
        self.done: list[tuple[int, list[tuple]]] = []

    def add(self, row: tuple) -> None:
        n = row[2]
        whole = n - n % self.longest
        self.done += [(self.longest, [(row, s, self.longest)]) for s in range(0, whole, self.longest)]
        if n > whole:
            self._put((row, whole, n - whole))

    def _put(self, piece: tuple) -> None:
        self.pool[piece[2]].append(piece)
        self.mask |= 1 << piece[2]
        self.held += piece[2]

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            self.mask ^= 1 << length
        self.held -= length
        return piece

    def _longest_upto(self, n: int) -> int:
        return (self.mask & ((2 << n) - 1)).bit_length() - 1

    def pack(self, last: bool) -> list[tuple[int, list[tuple]]]:
        """Close every bin that the held pieces can fill; with `last`, also the open rest."""
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while (n := self._longest_upto(tier)) > below and self.held >= tier:
                bin_, gap = [self._take(n)], tier - n
                while gap:
                    if (n := self._longest_upto(gap)) > 0:
                        bin_.append(self._take(n))
                    else:
                        n = (self.mask & -self.mask).bit_length() - 1
                        row, start, length = self._take(n)
                        n = gap
                        bin_.append((row, start, gap))
                        self._put((row, start + gap, length - gap))
                    gap -= n
                self.done.append((tier, bin_))
        if last:
            rest = [self._take(n) for n in range(self.longest, 0, -1) for _ in range(len(self.pool[n]))]
            total = sum(p[2] for p in rest)
            for tier in reversed(self.tiers):
                while total >= tier:
                    bin_, total = self._cut(rest, tier), total - tier
                    self.done.append((tier, bin_))
            if total:
                self.done.append((self.longest, self._cut(rest, total)))
        out, self.done = self.done, []
        return out

    @staticmethod
    def _cut(pieces: list[tuple], n: int) -> list[tuple]:
        out = []
        while n:
            row, start, length = pieces.pop()
            take = min(n, length)
            out.append((row, start, take))
            if take < length:
                pieces.append((row, start + take, length - take))
            n -= take
        return out


def step_groups(bins: list[tuple[int, list[tuple]]], step_tokens: int) -> list[int]:
    """A group number for each bin: each tier's bins, heaviest attention first, are dealt in snake order."""
    n = max(1, round(sum(t for t, _ in bins) / step_tokens))
    out, at = [0] * len(bins), 0
    cost = [sum(p[2] * p[2] for p in b) for _, b in bins]
    for i in sorted(range(len(bins)), key=lambda i: (-bins[i][0], -cost[i], i)):
        turn, k = divmod(at, n)
        out[i], at = (k if turn % 2 == 0 else n - 1 - k), at + 1
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    step_tokens: int = 16 * 2048,
    flush_tokens: int = 1 << 21,
    id_col: str = "doc_id",
    text_col: str = "text",
    memo_words: int = 600_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Null and empty texts are one end id. A null id is kept as null. Repeated rows are packed each. Very long texts
    are cut into whole windows. Extra columns are not read. An empty table gives no rows. sequence_id and step_group
    are numbered within the input split (its number in the upper bits), so they follow the table's file layout.
    A worker remembers the ids of at most memo_words words and as many pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, memo_words)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        packer, pid = TierPacker(tiers, step_tokens), TaskContext.get().partitionId()
        seq, group, fresh = pid << 36, pid << 36, 0

        def rows(last: bool) -> pd.DataFrame:
            nonlocal seq, group
            bins, out = packer.pack(last), []
            groups = step_groups(bins, step_tokens)
            for (tier, pieces), g in zip(bins, groups):
                offset = 0
                for (doc_id, ids, n), start, length in pieces:
                    part = np.frombuffer(ids, enc.dtype, length, start * enc.width).astype("<u4")
                    out.append((doc_id, start, length, zlib.crc32(part.tobytes()), n, seq, offset, tier, group + g))
                    offset += length
                seq += 1
            group += max(groups, default=-1) + 1
            return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

        for pdf in batches:
            for doc_id, text in zip(pdf["d"], pdf["t"]):
                ids = enc.encode(text) + end
                packer.add((None if pd.isna(doc_id) else int(doc_id), ids, len(ids) // enc.width))
                fresh += len(ids) // enc.width
                if fresh >= flush_tokens:
                    yield rows(False)
                    fresh = 0
        yield rows(True)
        release(encoders=False)

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInPandas(run, SCHEMA)
