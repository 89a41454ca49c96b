"""Word n-gram Jaccard join with a count-vector R-tree.

Shingles are hashed into groups, a document's point is its count in each group, and the overlap of two documents is
at most the sum over groups of the smaller count; a tree node bounds its documents by the largest counts. Points of
unrelated texts of one length lie all about equally far apart, so no node of a tree over a whole corpus excludes
anything. The tree therefore works inside cells that no link can leave. Cells come from an exact necessary condition:
linked sets share a shingle among the first n - ceil(t n) + 1 of any fixed order; documents
that share such a shingle and whose sizes chain within the threshold are in one cell. The order puts shingles of one
document first and those that many share last, so neither passages and boilerplate nor matches by chance tie cells
together: a document with enough shingles of its own is in none. The table of frequencies grows with the corpus. Pairs
whose bound survives are verified on the whole sets.

Equal sets are one document until the end. A large cell first compares its members with a few pivots, chunk by chunk, so
a group of near copies of one text costs about one pass. Members outside the cell's largest component of pivot links are
then compared with the whole cell, but for pairs that share a component, block by block, so no task sees more than two
blocks; that part grows with their number times the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.collisions import Roots, runs_of_groups
from timeweave.llm.common import lean, shuffle_width, staged
from timeweave.llm.graph import components
from timeweave.llm.toxicity import bounded_batches

BASE = 0x100000001B3
GROUPS, LEAF = 256, 8
PIVOTS = 8
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for i, b in enumerate((BASE, inverse)):
            table = np.full(max(n, 1 << 21), b, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles; words split at ASCII white space, A-Z lowered.

    A text of fewer words, but some, has its whole sequence as one shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    up, down = _power_tables(len(buf) + 1)
    blank = _BLANK[buf]
    before = np.r_[True, blank[:-1]]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    value = np.where(blank, np.uint64(0), buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)]
    total = np.r_[np.uint64(0), np.cumsum(value)]
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    length = max(0, len(words) - n + 1)
    runs = np.full(length, n, np.uint64)
    for k in range(n):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + length]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + w
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


BUCKETS, PACKED = 16, 1_000_000  # buckets of keys for each partition of documents; keys that a task packs at a time
LEVELS = tuple(2 << k for k in range(16))  # documents with a shingle, from which its rank goes up
SPARE, WIDEST = 2, 1 << 30  # slots of a level for each of its shingles, if that is not more than WIDEST in all
FULLEST = 0.5  # a level that would fill more of its slots tells shingles apart no longer and is left out


def counted_below(num: int, den: int) -> np.uint64:
    """Hashes under this are counted over the corpus and come first in the order: three times as many as a prefix takes,
    so that it can leave out the frequent ones."""
    return np.uint64(min(2**64 - 1, (3 * (den - num) << 64) // den))


class Ranks:
    """Frequency ranks of counted shingles, by the upper 40 bits of their hashes: how many levels, from the lowest on, a
    shingle is in. A level is a bitmap of slots, each a run of neighbouring hashes, so it holds all shingles of its
    frequency and some others."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]]):
        self.levels = levels  # (documents, bits of a hash below its slot, bitmap)

    def of(self, short: np.ndarray) -> np.ndarray:
        ranks, left = np.zeros(len(short), np.uint8), np.arange(len(short))
        for _, shift, bits in self.levels:
            slot = short[left] >> np.uint64(shift)
            left = left[(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            ranks[left] += 1
        return ranks

    @property
    def tells_single(self) -> bool:
        """Whether a shingle of rank 0 is in one document only."""
        return bool(self.levels) and self.levels[0][0] == 2


def prefixes(sets: list[np.ndarray], ranks: Ranks, num: int, den: int) -> list[np.ndarray]:
    """Of each set the first n - ceil(t n) + 1 hashes in the order: counted ones by rank of frequency, then all by hash.
    Those that are known to be in no other document are left out: nothing is found by them."""
    below, single = counted_below(num, den), ranks.tells_single
    cuts = [int(np.searchsorted(s, below)) for s in sets]
    places = np.cumsum([0, *cuts])
    known = ranks.of(np.concatenate([s[:cut] for s, cut in zip(sets, cuts)]) >> np.uint64(24)) if places[-1] else np.zeros(0, np.uint8)
    out = []
    for s, cut, at in zip(sets, cuts, places.tolist()):
        n = len(s)
        k = n + (-num * n) // den + 1 if n else 0
        rank = known[at : at + cut]
        order = np.argsort(rank, kind="stable")[:k]
        if single:
            order = order[np.count_nonzero(rank == 0) :]
        out.append(np.concatenate([s[order], s[cut : cut + max(0, k - cut)]]))
    return out


def packed_keys(docs: DataFrame, n: int, below: np.uint64, bits: int) -> DataFrame:
    """(bucket, keys): the upper 40 bits of all counted shingles, once a document, sorted into 2^bits buckets by their upper
    bits; the other bits of many keys are packed into one value of 32-bit numbers."""
    low = np.uint64(40 - bits)

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        keys = np.sort(np.concatenate(held))
        bucket = (keys >> low).astype(np.int32)
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)]
        rest = (keys & ((np.uint64(1) << low) - np.uint64(1))).astype("<u4")
        return pd.DataFrame({"bucket": bucket[cuts[:-1]], "keys": [rest[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]})

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in bounded_batches(texts):
                kept = [s[: int(np.searchsorted(s, below))] >> np.uint64(24) for s in shingle_sets(texts[part], n)]
                held.append(np.concatenate(kept))
                size += len(held[-1])
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return docs.select("text").mapInPandas(run, "bucket int, keys binary")


def frequent_keys(docs: DataFrame, n: int, num: int, den: int, bits: int) -> DataFrame:
    """(bucket, keys, tops, sizes): the counted shingles of LEVELS[0] documents and more, sorted, with the place of the highest
    level that each reaches, and how many reach which as their highest."""
    most = np.array(LEVELS)

    def counted(bucket: int, held: list[bytes]) -> pd.DataFrame:
        keys, times = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
        often = times >= LEVELS[0]
        tops = (np.searchsorted(most, times[often], side="right") - 1).astype(np.uint8)
        return pd.DataFrame({"bucket": [bucket], "keys": [keys[often].tobytes()], "tops": [tops.tobytes()], "sizes": [np.bincount(tops, minlength=len(LEVELS)).tolist()]})

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            for bucket, keys in zip(pdf["bucket"].tolist(), pdf["keys"]):
                if bucket != now and held:
                    yield counted(now, held)
                    held = []
                now = bucket
                held.append(keys)
        if held:
            yield counted(now, held)

    packed = packed_keys(docs, n, counted_below(num, den), bits)
    dealt = packed.repartition(shuffle_width(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return staged(dealt.mapInPandas(run, "bucket int, keys binary, tops binary, sizes array<long>"), "frequent")


def frequency_ranks(docs: DataFrame, n: int, num: int, den: int) -> Ranks:
    """The counted shingles of all documents are counted. There are BUCKETS buckets of keys for every partition of docs, so a
    bucket's size does not grow with the table. A level's bitmap has SPARE slots or more for each of its shingles, up to
    WIDEST bits; what comes to the driver are the bitmaps, in pieces."""
    bits = max(8, (BUCKETS * docs.rdd.getNumPartitions() - 1).bit_length())
    low = 40 - bits
    frequent = frequent_keys(docs, n, num, den, bits)
    tops = dict(frequent.select(F.posexplode("sizes").alias("top", "size")).groupBy("top").agg(F.sum("size")).collect())
    span = int(counted_below(num, den) >> np.uint64(24)) + 1
    wanted = []
    for place, times in enumerate(LEVELS):
        size = sum(tops.get(p, 0) for p in range(place, len(LEVELS)))
        # A bucket's slots are whole bytes.
        shift = next((s for s in range(low - 3, 0, -1) if span >> s >= SPARE * size or span >> (s - 1) > WIDEST), 0)
        if size:
            wanted.append((place, times, shift))

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, keys, high in zip(pdf["bucket"].tolist(), pdf["keys"], pdf["tops"]):
                keys, high = np.frombuffer(keys, "<u4"), np.frombuffer(high, np.uint8)
                for place, _, shift in wanted:
                    keys, high = keys[high >= place], high[high >= place]
                    if len(keys):
                        slots = np.zeros((1 << low) >> shift, bool)
                        slots[keys >> np.uint32(shift)] = True
                        yield pd.DataFrame({"bucket": [bucket], "place": [place], "bits": [np.packbits(slots, bitorder="little").tobytes()]})

    maps = {place: np.zeros(((1 << bits) << (low - shift)) >> 3, np.uint8) for place, _, shift in wanted}
    for row in frequent.mapInPandas(run, "bucket int, place int, bits binary").collect():
        maps[row["place"]][row["bucket"] * len(row["bits"]) :][: len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    levels = []
    for place, times, shift in wanted:
        full = int(np.bitwise_count(maps[place]).sum()) / max(1, span >> shift)
        if full <= FULLEST:
            levels.append((times, shift, maps[place]))
    return Ranks(levels)


def signatures(docs: DataFrame, n: int, num: int, den: int, ranks: Ranks) -> DataFrame:
    """(id, n, a, b, keys): set size, two independent hashes of the set, and what of its prefix others may have."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in bounded_batches(texts):
                sets = shingle_sets(texts[part], n)
                ids = pdf["id"].iloc[part]
                yield pd.DataFrame({
                    "id": ids, "n": [len(s) for s in sets], "a": [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets],
                    "b": [int(mix(s + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)) for s in sets], "keys": [p.view(np.int64) for p in prefixes(sets, shared.value, num, den)],
                })

    return docs.mapInPandas(run, "id long, n long, a long, b long, keys array<long>")


def chain_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between documents that follow each other by size under one key, while sizes allow a link, with the number of
    such keys (an edge may come in several rows).

    Rows are range-partitioned by key, size and id and streamed in order, so a key of any number of documents is dealt
    to many tasks and needs the memory of one batch. Only the first and the last row of each task come to the driver,
    where neighbouring tasks are linked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last = TaskContext.get().partitionId(), None
        for pdf in batches:
            if not len(pdf):
                continue
            k, i, m = (pdf[c].to_numpy() for c in ("key", "id", "n"))
            if last is None:
                yield pd.DataFrame({"x": i[:1], "keys": m[:1], "key": k[:1], "place": [2 * task]})
            else:
                k, i, m = np.r_[last[0], k], np.r_[last[1], i], np.r_[last[2], m]
            last = k[-1], i[-1], m[-1]
            near = (k[1:] == k[:-1]) & (m[:-1] * den >= m[1:] * num) & (i[1:] != i[:-1])
            pairs, keys = np.unique(np.stack([i[1:][near], i[:-1][near]], axis=1), axis=0, return_counts=True)
            yield pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1], "keys": keys})
        if last is not None:
            yield pd.DataFrame({"x": [last[1]], "keys": [last[2]], "key": [last[0]], "place": [2 * task + 1]})

    @lean
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in run(batches):
            yield pdf.reindex(columns=["x", "y", "keys", "key", "place"]).astype("Int64")

    width = shuffle_width(rows.sparkSession)
    ordered = rows.repartitionByRange(width, "key", "n", "id").sortWithinPartitions("key", "n", "id")
    found = staged(ordered.mapInPandas(whole, "x long, y long, keys long, key long, place long"), "chains")
    ends = found.where("place IS NOT NULL").orderBy("place").collect()
    across = [(b["x"], a["x"], 1) for a, b in zip(ends, ends[1:]) if a["place"] // 2 != b["place"] // 2 and a["key"] == b["key"] and a["keys"] * den >= b["keys"] * num and a["x"] != b["x"]]
    return found.where("place IS NULL").select("x", "y", "keys").unionByName(rows.sparkSession.createDataFrame(across, "x long, y long, keys long"))


class CountTree:
    """R-tree over count vectors, packed bottom-up from points ordered along one direction."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        points = np.stack([np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32 if max(map(len, sets)) > 65535 else np.uint16)
        direction = np.random.default_rng(1).standard_normal(GROUPS)
        self.order = np.argsort(points @ direction / np.maximum(1, self.size), kind="stable")
        # A level holds, for each node: largest count per group, smallest and largest set size.
        self.levels = [(points[self.order], self.size[self.order], self.size[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def pairs(self, num: int, den: int) -> np.ndarray:
        """Pairs of points (i, j) whose bound allows a link, found by descending pairs of nodes together."""
        nodes = len(self.levels[-1][0])
        a, b = np.triu_indices(nodes)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            keep = []
            for s in range(0, len(a), 4096):
                x, y = a[s : s + 4096], b[s : s + 4096]
                bound = np.minimum(top[x], top[y]).sum(axis=1, dtype=np.int64)
                need = bound * (num + den) >= num * (low[x] + low[y])
                keep.append(need & (high[x] * den >= low[y] * num) & (high[y] * den >= low[x] * num))
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if depth:
                n = len(self.levels[depth - 1][0])
                step = np.arange(LEAF)
                ca = np.repeat(a[:, None] * LEAF + step, LEAF, axis=1).ravel()
                cb = np.tile(b[:, None] * LEAF + step, (1, LEAF)).ravel()
                ok = (ca < n) & (cb < n) & (ca <= cb)
                a, b = ca[ok], cb[ok]
        a, b = self.order[a[a != b]], self.order[b[a != b]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def verify(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, root) of the members of each group g that have a link there; root is the smallest id they reach in it.

    Pairs of role 2 with 2, and of role 0 with 1, are looked at; a pair that is already connected need not be verified.
    Members of one part are connected from the start; null parts connect nothing.
    """
    if "part" not in rows.columns:
        rows = rows.withColumn("part", F.lit(None).cast("long"))

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs_of_groups(batches, ["g"], lambda k: k / 400):
            sets = [s for part in bounded_batches(pdf["text"].tolist()) for s in shingle_sets(pdf["text"].iloc[part].tolist(), n)]
            groups, role, ids = pdf["__group"].to_numpy(), pdf["role"].to_numpy(), pdf["id"].to_numpy()
            parted, parts = pdf["part"].notna().to_numpy(), pdf["part"].fillna(0).to_numpy(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(groups)) + 1, len(groups)]
            out_id, out_root = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                names, place = np.unique(ids[s:e], return_inverse=True)
                roots, hit = Roots(len(names)), set()
                at = np.flatnonzero(parted[s:e])
                first, same = np.unique(parts[s:e][at], return_index=True, return_inverse=True)[1:]
                for p, q in zip(place[at].tolist(), place[at[first[same]]].tolist()):
                    roots.join(p, q)
                for i, j in CountTree(sets[s:e]).pairs(num, den).tolist():
                    if place[i] == place[j] or not (role[s + i] == role[s + j] == 2 or role[s + i] + role[s + j] == 1):
                        continue
                    p, q = int(place[i]), int(place[j])
                    if roots.find(p) != roots.find(q) and linked(sets[s + i], sets[s + j], num, den):
                        roots.join(p, q)
                        hit |= {p, q}
                hit = sorted(hit)
                out_id.append(names[hit])
                out_root.append(names[[roots.find(p) for p in hit]] if hit else names[:0])
            yield pd.DataFrame({"id": np.concatenate(out_id), "root": np.concatenate(out_root)})

    width = shuffle_width(rows.sparkSession)
    return staged(rows.select("g", "role", "id", "part", "text").repartition(width, "g").sortWithinPartitions("g").mapInPandas(run, "id long, root long"), "links")


MARKS = 1 << 26


def likely_members(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts whose id is in members, and a few others: ids set bits in MARKS slots, so that the texts of documents
    that are no members stay where they are. What is broadcast is at most MARKS / 64 rows, whatever the number of members."""
    slot = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    bit = F.expr("shiftleft(1L, CAST(__slot % 64 AS INT))")
    words = members.select("id").withColumn("__slot", slot).groupBy(F.expr("__slot div 64").alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    asked = texts.withColumn("__slot", slot).withColumn("__word", F.expr("__slot div 64"))
    return asked.join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(bit) != 0).select(*texts.columns)


def _with_text(members: DataFrame, texts: DataFrame, broadcast_rows: int) -> DataFrame:
    if members.count() <= broadcast_rows:
        return texts.join(F.broadcast(members), "id")
    return likely_members(members, texts).join(members, "id")


def _all_links(cells: DataFrame, texts: DataFrame, n: int, num: int, den: int, block: int, broadcast_rows: int) -> list[DataFrame]:
    """Verified links of all cells (id, cell, shared), as (id, root). Pivots are, of each of PIVOTS parts of a cell, the
    member with most shared keys for its size: the text that copies were made from has no shingles of its own."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
    best = [F.max_by("id", F.when(bucket == k, F.struct("shared", "id"))) for k in range(PIVOTS)]
    sizes = staged(cells.groupBy("cell").agg(F.count("*").alias("size"), F.array_distinct(F.array_compact(F.array(*best))).alias("pivots")), "cells")
    sized = staged(cells.join(sizes, "cell").select("id", "cell", "size"), "members")
    found = [verify(_with_text(sized.where(F.col("size") <= block).select("id", F.col("cell").alias("g"), F.lit(2).alias("role")), texts, broadcast_rows), n, num, den)]
    large = sized.where(F.col("size") > block)
    if large.isEmpty():
        return found
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")
    chunked = sizes.where(F.col("size") > block).withColumn("own", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pivots = chunked.select("cell", "own", F.explode("pivots").alias("id"))
    chunks = pivots.select("id", F.xxhash64("cell", "own").alias("g"), F.lit(0).alias("role")).unionByName(large.select("id", F.xxhash64("cell", own).alias("g"), F.lit(1).alias("role")))
    reached = verify(_with_text(chunks, texts, broadcast_rows), n, num, den)
    found.append(reached)
    # Pivot links stay inside a cell, so its components do. Of any two components one is not the cell's largest.
    state = staged(large.join(components(reached, "id", "root"), "id", "left").select("id", "cell", "size", F.col("component").alias("part")), "reached")
    largest = staged(state.where("part IS NOT NULL").groupBy("cell", "part").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("part", F.struct("n", "part")).alias("largest")), "largest")
    left = staged(state.join(largest, "cell", "left").where("NOT (part <=> largest) OR part IS NULL").select("id", "cell", "size", "part"), "outside")
    if left.isEmpty():
        return found
    # Members outside the largest component meet all of their cell, in wider blocks: bounds cost less than carrying texts again.
    wide = 4 * block
    blocks = F.ceil(F.col("size") / wide).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("wide")), blocks).cast("int")
    waves = staged(left.groupBy("cell").agg(F.ceil(F.count("*") / wide).cast("int").alias("waves")), "waves")
    wave = F.pmod(F.xxhash64("id", F.lit("wave")), F.col("waves")).cast("int")
    everyone = state.join(waves, "cell").withColumn("wave", F.explode(F.sequence(F.lit(0), F.col("waves") - 1))).select("id", "part", F.xxhash64("cell", own, "wave").alias("g"), F.lit(1).alias("role"))
    some = left.join(waves, "cell").select("id", "cell", "size", "part", wave.alias("wave")).withColumn("own", F.explode(F.sequence(F.lit(0), blocks - 1))).select("id", "part", F.xxhash64("cell", "own", "wave").alias("g"), F.lit(0).alias("role"))
    found.append(verify(_with_text(everyone.unionByName(some), texts, broadcast_rows), n, num, den))
    return found


def _same_id(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (id, root) from ids that have several sets to the documents that stand for those sets."""
    sets = F.struct("a", "b", "n")
    known = signed.where("id IS NOT NULL AND n > 0").select("id", "a", "b", "n")
    several = known.groupBy("id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low <> high").select("id")
    return known.join(several, "id", "left_semi").join(reps, ["a", "b", "n"]).select("id", F.col("rep").alias("root"))


def near_texts(
    docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 128, broadcast_rows: int = 500_000
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when den * |intersection| >= num * |union| of their sets of n-word shingles; component_id is the
    smallest doc_id reachable by links. Null, empty and blank texts have no shingles and link with nothing. Rows with a
    null id keep a null component and link with nothing. Equal texts link by equal sets. Rows that repeat an id are the
    same vertex, whatever their texts. Texts are read whole. Extra columns are not read. An empty table gives no rows.

    Frequency ranks only order the prefixes (frequent shingles last) and leave out what one document has: results do not depend on them. The broadcast of members of cells is used up to broadcast_rows rows, beyond that the join shuffles, with the
    texts of members only.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = staged(signatures(base, n, num, den, frequency_ranks(base, n, num, den)), "signatures")
    reps = staged(signed.where("id is not null and n > 0").groupBy("a", "b", "n").agg(F.min("id").alias("rep")), "sets")
    # A set's first document carries its prefix; copies are left out here.
    keyed = signed.join(reps.select(F.col("rep").alias("id"), "a", "b", "n"), ["id", "a", "b", "n"], "left_semi")
    edges = chain_edges(keyed.select(F.explode("keys").alias("key"), "id", "n"), num, den)
    shared = edges.select(F.explode(F.array("x", "y")).alias("id"), "keys").groupBy("id").agg(F.sum("keys").alias("k"))
    cells = components(edges, "x", "y").join(shared, "id").join(keyed.select("id", "n"), "id")
    cells = staged(cells.select("id", F.col("component").alias("cell"), (F.col("k") / F.col("n")).alias("shared")).dropDuplicates(["id"]), "cells")
    found = _all_links(cells, base, n, num, den, block, broadcast_rows)
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    links = links.unionByName(_same_id(signed, reps))
    parts = components(links, "id", "root")
    named = staged(reps.join(parts, F.col("rep") == F.col("id"), "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component")), "named")
    out = signed.select("id", "n", "a", "b").join(named, ["a", "b", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000, **params) -> DataFrame:
    """The rows of docs, with all their columns, that are their component's smallest id.

    Rows that repeat an id are one document and stay or go together. A row without an id is a document of its own behind
    all others: it goes if anything it links with stays, and of equal texts without ids one row stays. Null, empty and
    blank texts link with nothing and stay. An empty table stays empty. Ids that go are broadcast up to `broadcast_rows` of
    them (8 bytes each), beyond that the join shuffles.
    """
    # Ids of rows without one: two to the 62 and more, from the text.
    own = F.when(F.col(id_col).isNull(), F.lit(1 << 62) + F.pmod(F.xxhash64(text_col), F.lit((1 << 61) - 1))).otherwise(F.col(id_col).cast("long"))
    named = docs.withColumn("__own", own)
    found = staged(near_texts(named.select(F.col("__own").alias("id"), F.col(text_col).alias("text")), id_col="id", text_col="text", **params), "near")
    gone = staged(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__own")).distinct(), "gone")
    kept = named.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, "__own", "left_anti")
    blank = F.coalesce(F.col(text_col).rlike(r"^[\x20\x09-\x0D]*$"), F.lit(True))
    nameless = F.col(id_col).isNull() & ~blank
    return kept.where(~nameless).unionByName(kept.where(nameless).dropDuplicates(["__own"])).drop("__own")
