"""Token-id output compressed by a Re-Pair grammar per block, with random-access decoding.

Documents are range-partitioned by id, so shard k's documents precede shard k+1's. A shard's task encodes its
documents in order and closes a block at about `block_ids` ids. Within a block frequent adjacent pairs become
nonterminals, in rounds until no pair is frequent or symbols run out: a round counts all pairs, takes the most frequent
as rules and replaces their occurrences (where two overlap, the more frequent pair's, then the left one; in a run of one
symbol every other). A block stores its rules, the
expansion length of every rule, its documents' offsets and the reduced sequence.

Block layout (little-endian): magic RPG1, then unsigned 32-bit: symbol width in bytes, end id, first nonterminal,
rules, symbols, documents, ids; then rules (left, right) and the sequence in symbol width, expansion lengths
(32 bits), document ids (signed 64 bits; null is the smallest), document offsets in ids (64 bits).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import encoder, release, shuffle_width, staged

MAGIC, NULL_ID = b"RPG1", -(1 << 63)
BLOCKS = "shard int, block int, shard_start long, n_docs long, n_ids long, payload binary"


def build_grammar(ids: np.ndarray, first: int, per_round: int = 2048, least: int = 8):
    """(reduced sequence, rules of shape (n, 2), expansion lengths); symbol `first + k` is rule k."""
    wide = first + per_round > 1 << 16
    seq = ids.astype(np.uint32 if wide else np.uint16)
    half, kind = (32, np.uint64) if wide else (16, np.uint32)
    room = (1 << (8 * seq.itemsize)) - first
    rules, lengths = np.zeros((0, 2), seq.dtype), np.zeros(0, np.uint32)

    def length_of(s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.uint32)
        inner = s >= first
        out[inner] = lengths[s[inner].astype(np.int64) - first]
        return out

    # The most frequent pair is always replaced, so each round shortens the sequence.
    while len(seq) >= 2 and len(rules) < room:
        key = (seq[:-1].astype(kind) << half) | seq[1:]
        order = np.sort(key)
        starts = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        counts = np.diff(np.append(starts, len(order)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")][: min(per_round, room - len(rules))]
        chosen = order[starts[often]]
        bits = 18
        slot = lambda k: ((k * kind(0x9E3779B1)) & kind(0xFFFFFFFF)) >> kind(32 - bits)
        table = np.full(1 << bits, -1, np.int16)
        table[slot(chosen)[::-1]] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int16)
        rank = table[slot(key)]
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        same = chosen[rank] == key[at]
        at, rank = at[same], rank[same]
        touch = at[1:] - at[:-1] == 1
        take = np.ones(len(at), bool)
        take[1:] &= ~touch | (rank[1:] <= rank[:-1])
        take[:-1] &= ~touch | (rank[:-1] <= rank[1:])
        at, rank = at[take], rank[take]
        head = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        run = np.diff(np.append(head, len(at)))
        odd = (np.arange(len(at)) - np.repeat(head, run)) % 2 == 0
        at, rank = at[odd], rank[odd]
        used = np.bincount(rank, minlength=len(chosen))
        keep = used >= max(2, least // 2)
        at, rank = at[keep[rank]], rank[keep[rank]]
        if not len(at):
            break
        new = np.cumsum(keep) - 1 + first + len(rules)
        symbols = new[rank].astype(seq.dtype)
        pairs = chosen[keep]
        added = np.stack([(pairs >> kind(half)), pairs & kind((1 << half) - 1)], axis=1).astype(seq.dtype)
        added_lengths = length_of(added[:, 0]) + length_of(added[:, 1])
        rules, lengths = np.concatenate([rules, added]), np.concatenate([lengths, added_lengths])
        seq[at] = symbols
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
    return seq, rules, lengths


def write_block(ids: np.ndarray, doc_ids: list[int], offsets: list[int], first: int, end_id: int) -> bytes:
    seq, rules, lengths = build_grammar(ids, first)
    head = struct.pack("<7I", seq.itemsize, end_id, first, len(rules), len(seq), len(doc_ids), len(ids))
    return b"".join([MAGIC, head, rules.tobytes(), seq.tobytes(), lengths.astype("<u4").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(offsets, "<i8").tobytes()])


@dataclass
class Block:
    """A decoded header; ids are expanded on demand."""

    first: int
    rules: np.ndarray
    seq: np.ndarray
    lengths: np.ndarray
    doc_ids: np.ndarray
    offsets: np.ndarray
    n_ids: int

    @staticmethod
    def parse(raw: bytes) -> Block:
        if raw[:4] != MAGIC:
            raise ValueError("not an RPG1 block")
        width, _, first, n_rules, n_seq, n_docs, n_ids = struct.unpack_from("<7I", raw, 4)
        kind, at = f"<u{width}", 32
        rules = np.frombuffer(raw, kind, 2 * n_rules, at).reshape(-1, 2)
        at += 2 * n_rules * width
        seq = np.frombuffer(raw, kind, n_seq, at)
        at += n_seq * width
        lengths = np.frombuffer(raw, "<u4", n_rules, at)
        at += 4 * n_rules
        doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        return Block(first, rules, seq, lengths, doc_ids, np.frombuffer(raw, "<i8", n_docs, at + 8 * n_docs), n_ids)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        cells: dict[int, bytes] = {}
        pack = struct.Struct("<I").pack
        todo = set(symbols[symbols >= self.first].tolist())
        need = set(todo)
        while todo:
            todo = {c for s in todo for c in self.rules[s - self.first].tolist() if c >= self.first} - need
            need |= todo
        leaf = lambda c: cells[c] if c >= self.first else pack(c)
        order = sorted(need)
        for s in order:
            a, b = self.rules[s - self.first].tolist()
            cells[s] = leaf(a) + leaf(b)
        # One array holds the rules' expansions and then the symbols themselves; every id is gathered from it.
        flat = np.frombuffer(b"".join(map(cells.__getitem__, order)), "<u4")
        where = np.zeros(len(self.rules), np.int64)
        used = np.array(order, np.int64) - self.first
        where[used] = np.cumsum(self.lengths[used].astype(np.int64)) - self.lengths[used]
        size, at = np.ones(len(symbols), np.int64), len(flat) + np.arange(len(symbols))
        inner = np.flatnonzero(symbols >= self.first)
        rule = symbols[inner].astype(np.int64) - self.first
        size[inner], at[inner] = self.lengths[rule], where[rule]
        ends = np.cumsum(size)
        source = np.concatenate([flat, symbols.astype("<u4")])
        return source[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """Ids start .. start + n: only the symbols that cover them are expanded."""
        stop = self.n_ids if n is None else min(self.n_ids, start + n)
        if start >= stop:
            return np.zeros(0, "<u4")
        if start == 0 and stop == self.n_ids:
            return self._expand(self.seq)
        size = np.ones(len(self.seq), np.int64)
        inner = self.seq >= self.first
        size[inner] = self.lengths[self.seq[inner].astype(np.int64) - self.first]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skip = start - int(ends[a] - size[a])
        return self._expand(self.seq[a : b + 1])[skip : skip + stop - start]

    def document(self, k: int) -> np.ndarray:
        """Ids of the block's k-th document, with its end id."""
        stop = self.offsets[k + 1] if k + 1 < len(self.offsets) else self.n_ids
        return self.ids(int(self.offsets[k]), int(stop - self.offsets[k]))


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, compress and write all documents in ascending id order; returns the written blocks, reread."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        parts: list[bytes] = []
        doc_ids: list[int] = []
        offsets: list[int] = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal block, before, parts, doc_ids, offsets, size
            payload = write_block(np.frombuffer(b"".join(parts), enc.dtype), doc_ids, offsets, enc.tok.get_vocab_size(), end_id)
            out = pd.DataFrame([(shard, block, before, len(doc_ids), size, payload)], columns=["shard", "block", "shard_start", "n_docs", "n_ids", "payload"])
            block, before, parts, doc_ids, offsets, size = block + 1, before + size, [], [], [], 0
            return out

        for pdf in batches:
            for d, ids in zip(pdf["d"], enc.encode_all(pdf["t"].tolist())):
                ids += end
                doc_ids.append(NULL_ID if pd.isna(d) else int(d))
                offsets.append(size)
                parts.append(ids)
                size += len(ids) // enc.width
                if size >= block_ids:
                    yield close()
        if doc_ids:
            yield close()
        release(encoders=False)

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    n = shuffle_width(docs.sparkSession)
    order = [F.col("d").asc_nulls_first(), F.xxhash64("t"), F.col("t")]
    ordered = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    return staged(ordered.mapInPandas(run, BLOCKS), "token-blocks")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Decode written blocks: doc_id, start, n_tokens, ids_crc32.

    Only the shards' id totals come to the driver and are broadcast: one number a shuffle partition, whatever the
    corpus holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw, start in zip(pdf["payload"], pdf["start"]):
                b = Block.parse(raw)
                ids, cut = memoryview(b.ids().tobytes()), [*b.offsets.tolist(), b.n_ids]
                yield pd.DataFrame({
                    "doc_id": pd.array([None if d == NULL_ID else d for d in b.doc_ids.tolist()], dtype="Int64"),
                    "start": b.offsets + int(start),
                    "n_tokens": np.diff(cut).astype("int64"),
                    "ids_crc32": [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(cut, cut[1:])],
                })

    spark = blocks.sparkSession
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    bases = list(zip([s for s, _ in totals], accumulate([n for _, n in totals], initial=0)))
    base = spark.createDataFrame(bases, "shard int, base long")
    placed = blocks.join(F.broadcast(base), "shard").select("payload", (F.col("base") + F.col("shard_start")).alias("start"))
    return placed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, **columns: str) -> DataFrame:
    """Write documents as compressed blocks and report each from the files read back.

    Null and empty texts are the end id alone. Null ids come first. Repeated rows are written each, in order of
    their texts' hashes within an id. A very long text makes its block longer and is never cut. Extra columns are not read. An empty
    table writes no block and gives no rows.
    """
    return read_documents(write_blocks(docs, tokenizer, end_id, **columns))
