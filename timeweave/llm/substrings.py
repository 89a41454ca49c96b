"""Exact removal of long repeated substrings by a sampled suffix array.

Sorting every byte's suffix would move each byte hundreds of times. Only chosen suffixes are sorted: a window of
`length` bytes is represented by the suffix at its smallest-hashed `GRAM`-byte string (leftmost if tied), so equal
windows choose the same suffix at the same distance, and every window belongs to exactly one. Chosen suffixes are
range-partitioned by sampled splitters on their leading bytes; a bucket is sorted locally by multikey quicksort on
those bytes, eight at a time, and neighbours that share all of them are kept; the first and last group of a bucket are
settled across boundaries. Only kept suffixes bring their text: inside a group the windows that chose them are
compared, first by hash, then byte by byte. A group of many members is dealt out in parts; each part settles what
repeats inside it and passes on a 128-bit hash per other window for a count over all parts.

Equal texts are searched once: with two or more copies, all of a text of at least `length` bytes is repeated. Texts are
told apart by 124 bits of two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.collisions import runs_of_groups
from timeweave.llm.common import lean, shuffle_width, staged
from timeweave.llm.set_join import _power_tables, mix
from timeweave.llm.toxicity import bounded_batches

GRAM, PLACE_BITS = 32, np.uint64(31)
LEADING = ["w0", "w1", "w2", "w3"]  # a suffix's first GRAM bytes, eight in each, as numbers that sort as the bytes do
KEY = [*LEADING, "t", "s", "pos"]
PLACES = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
SIGN = np.uint64(1 << 63)
SHORT = 1024  # ranges of at most this many rows are not split further
OTHER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # byte values of the second hash


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows by their columns from left to right, by multikey quicksort: a range is split by one column into less
    than, equal to and greater than a middle value, and only the equal rows go on to the next column."""
    order, todo = np.arange(len(keys)), [(0, len(keys), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == keys.shape[1]:
            continue
        rows = order[lo:hi]
        if hi - lo <= SHORT:
            order[lo:hi] = rows[np.lexsort(keys[rows, depth:].T[::-1])]
            continue
        x = keys[rows, depth]
        pivot = np.sort(x[:: len(x) // 9])[5]
        less, same, more = rows[x < pivot], rows[x == pivot], rows[x > pivot]
        order[lo:hi] = np.concatenate([less, same, more])
        a, b = lo + len(less), lo + len(less) + len(same)
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def gram_ids(words: np.ndarray) -> np.ndarray:
    """A number for each row of leading words, for grouping; groups are compared by their bytes later."""
    out = np.zeros(len(words), np.uint64)
    for w in words.T:
        out = mix(out + w.view(np.uint64))
    return out.view(np.int64)


def _encoded(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def window_hashes(buf: np.ndarray, starts: np.ndarray, length: int, values: np.ndarray | None = None) -> np.ndarray:
    up, down = _power_tables(len(buf) + 1)
    bytes_ = buf.astype(np.uint64) + np.uint64(1) if values is None else values[buf]
    prefix = np.r_[np.uint64(0), np.cumsum(bytes_ * up[: len(buf)])]
    return mix((prefix[starts + length] - prefix[starts]) * down[starts])


def chosen_suffixes(raw: list[bytes], length: int):
    """(row, words, pos, first, last) arrays: the suffix at pos of row, whose leading bytes are words (n, 4), stands for the
    windows starting first..last."""
    buf = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    span, none = length - GRAM + 1, np.zeros(0, np.int64)
    if len(buf) < length:
        return none, np.zeros((0, 4), np.int64), none, none, none
    grams = window_hashes(buf, np.arange(len(buf) - GRAM + 1), GRAM)
    low = (grams & ~PLACES) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    owner = np.repeat(np.arange(len(raw)), sizes)[: len(low)]
    whole = np.arange(len(low)) + length <= offsets[owner + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none, np.zeros((0, 4), np.int64), none, none, none
    place = (low[starts] & PLACES).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (owner[starts][1:] != owner[starts][:-1])]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(starts)] - 1
    row, pos = owner[starts[at]], place[at]
    words = (buf[pos[:, None] + np.arange(GRAM)].view(">u8").astype(np.uint64) ^ SIGN).view(np.int64)
    base = offsets[row]
    return row, words, pos - base, starts[at] - base, starts[end] - base


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in bounded_batches(pdf["text"].tolist()):
                rows = pdf.iloc[part]
                row, words, pos, _, _ = chosen_suffixes(_encoded(rows["text"].tolist()), length)
                yield pd.DataFrame(dict(zip(LEADING, words.T)) | {"t": rows["t"].to_numpy()[row], "s": rows["s"].to_numpy()[row], "pos": pos})

    return texts.mapInPandas(run, ", ".join(f"{c} long" for c in KEY))


def _neighbours(suffixes: DataFrame, bucket_rows: int = 500_000) -> DataFrame:
    """(gram, t, s, pos, state): suffixes whose leading bytes a different place has. State 1: settled; 0: alone so far in a
    bucket's first or last group, to be settled with the neighbouring buckets.

    Buckets follow the number of suffixes, so that one is sorted in memory whatever the table holds. Splitters lie in the
    whole key, so that many equal suffixes are dealt to many buckets.
    """

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf[KEY].to_numpy() for pdf in batches if len(pdf)]
        if not parts:
            return
        keys = np.concatenate(parts)
        keys = keys[multikey_order(keys)]
        group = np.cumsum(np.r_[False, (keys[1:, :4] != keys[:-1, :4]).any(axis=1)])
        several = np.bincount(group)[group] > 1
        take = several | (group == 0) | (group == group[-1])
        keys, state = keys[take], several[take].astype(np.int64)
        yield pd.DataFrame({"gram": gram_ids(np.ascontiguousarray(keys[:, :4])), "t": keys[:, 4], "s": keys[:, 5], "pos": keys[:, 6], "state": state})

    width = max(shuffle_width(suffixes.sparkSession), -(-suffixes.count() // bucket_rows))
    return staged(suffixes.repartitionByRange(width, *KEY).mapInPandas(run, "gram long, t long, s long, pos long, state long"), "neighbours")


def _kept(found: DataFrame) -> DataFrame:
    """Settled suffixes, and those at bucket ends whose gram another bucket holds too. There are at most two ends a
    bucket; Spark broadcasts their grams while they are few."""
    ends = staged(found.where("state = 0").select("gram").distinct(), "ends")
    places = found.join(ends, "gram", "left_semi").groupBy("gram").agg(F.count_distinct("t", "s", "pos").alias("places"))
    shared = staged(places.where("places > 1").select("gram"), "shared-ends")
    return found.where("state = 1").drop("state").unionByName(found.where("state = 0").join(shared, "gram", "left_semi").drop("state"))


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in bounded_batches(pdf["text"].tolist()):
                rows = pdf.iloc[part]
                raw = _encoded(rows["text"].tolist())
                row, words, pos, first, last = chosen_suffixes(raw, length)
                wanted = [set(p) for p in rows["places"]]
                take = [k for k, (r, p) in enumerate(zip(row.tolist(), pos.tolist())) if p in wanted[r]]
                row, gram, first, last = row[take], gram_ids(np.ascontiguousarray(words[take])), first[take], last[take]
                yield pd.DataFrame({
                    "gram": gram, "t": rows["t"].to_numpy()[row], "s": rows["s"].to_numpy()[row], "first": first,
                    "context": [raw[r][a : b + length] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist())],
                })

    return texts.mapInPandas(run, "gram long, t long, s long, first long, context binary")


def same_windows(buf: np.ndarray, at: np.ndarray, row: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """A class number for each window of `length` bytes at `at` (rising within a row): equal for equal bytes only.

    Classes are those of equal hashes, checked by comparing bytes with the class's first window. Windows in a row that meet
    windows in a row are compared as one stretch. A class that fails is told apart by its windows' bytes.
    """
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    model = first[inverse]
    mine = np.flatnonzero(model != np.arange(len(at)))
    if not len(mine):
        return inverse
    step = np.r_[True, (np.diff(mine) != 1) | (np.diff(model[mine]) != 1) | (np.diff(row[mine]) != 0) | (np.diff(row[model[mine]]) != 0)]
    heads = np.flatnonzero(step)
    sizes = np.diff(np.r_[heads, len(mine)]) + length - 1
    left, right = at[mine[heads]], at[model[mine[heads]]]
    wrong, block = [], np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + 1, 4_000_000))
    for lo, hi in zip(block, [*block[1:], len(sizes)]):
        if hi <= lo:
            continue
        n = sizes[lo:hi]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = buf[np.repeat(left[lo:hi], n) + place] != buf[np.repeat(right[lo:hi], n) + place]
        if differs.any():
            wrong += (lo + np.unique(np.repeat(np.arange(hi - lo), n)[differs])).tolist()
    if wrong:
        runs = np.cumsum(step) - 1
        bad = np.isin(inverse, np.unique(inverse[mine[np.isin(runs, wrong)]]))
        names: dict[tuple, int] = {}
        for k in np.flatnonzero(bad).tolist():
            inverse[k] = len(first) + names.setdefault((int(inverse[k]), buf[at[k] : at[k] + length].tobytes()), len(names))
    return inverse


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """kind 0: window starts first..last of a text repeat; kind 1: a window alone in its part; kind 2: a hash that repeats
    in its part. Kinds 1 and 2 come only from groups of several parts."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs_of_groups(batches, ["gram", "part"], lambda k: k / 2000):
            pdf = pdf[~pdf.duplicated(["gram", "part", "t", "s", "first"])].reset_index(drop=True)
            raw = pdf["context"].tolist()
            sizes = np.array([len(r) for r in raw], np.int64)
            offsets = np.r_[0, np.cumsum(sizes)]
            counts = sizes - length + 1
            row = np.repeat(np.arange(len(raw)), counts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            buf, at = np.frombuffer(b"".join(raw), np.uint8), offsets[row] + step
            hashes = window_hashes(buf, at, length)
            group = mix(pdf["gram"].to_numpy().view(np.uint64) + mix(pdf["part"].to_numpy().astype(np.uint64) + np.uint64(5)))[row]
            inverse = same_windows(buf, at, row, hashes + group, length)
            _, lead, inverse, times = np.unique(inverse, return_index=True, return_inverse=True, return_counts=True)
            twice = times[inverse] > 1
            new = twice & np.r_[True, ~twice[:-1] | (row[1:] != row[:-1])]
            end = twice & np.r_[~twice[1:] | (row[1:] != row[:-1]), True]
            start, many = pdf["first"].to_numpy()[row] + step, (pdf["parts"].to_numpy() > 1)[row]
            a, b = np.flatnonzero(new), np.flatnonzero(end)
            single, shared = np.flatnonzero(many & ~twice), lead[(times > 1) & many[lead]]
            rows = np.r_[a, single, shared]
            second = window_hashes(buf, at, length, OTHER)[rows] if len(single) + len(shared) else np.zeros(len(rows), np.uint64)
            yield pd.DataFrame({
                "kind": np.repeat([0, 1, 2], [len(a), len(single), len(shared)]), "t": pdf["t"].to_numpy()[row[rows]], "s": pdf["s"].to_numpy()[row[rows]], "first": start[rows],
                "last": np.r_[start[b], start[single], start[shared]], "hash": hashes[rows].view(np.int64), "second": second.view(np.int64),
            })

    width = shuffle_width(contexts.sparkSession)
    return staged(contexts.repartition(width, "gram", "part").sortWithinPartitions("gram", "part").mapInPandas(run, "kind long, t long, s long, first long, last long, hash long, second long"), "repeats")


def _one_each(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """One row (text, t, s) of each text, so that a text of many copies has each of its suffixes once: the row with the
    smallest id; of rows that repeat a text under one id any."""
    twice = staged(copies.where("copies > 1").select("t", "s", "rep", "rows"), "copied")
    chosen = texts.join(twice, ["t", "s"], "left").where("rep IS NULL OR number = rep")
    one = chosen.where("rows IS NULL OR rows = 1").select("text", "t", "s")
    if twice.where("rows > 1").isEmpty():
        return one
    return one.unionByName(chosen.where("rows > 1").select("text", "t", "s").dropDuplicates(["t", "s"]))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", part: int = 128) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte goes when a string of `length` bytes that covers it starts anywhere else in the corpus, the same text
    included. Null texts are empty; texts shorter than `length` lose nothing. `kept` is what is left, as bytes (a cut may fall inside a
    character). Null and repeated ids are kept as they are: rows are told apart by text. Extra columns are not read. Texts are read whole. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    other = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"), other.alias("s"), F.octet_length(text).cast("long").alias("n"))
    long_ones, number = base.where(F.col("n") >= length), F.coalesce(F.col("id").cast("long"), F.lit(-1))
    by_id = long_ones.groupBy("t", "s", number.alias("rep")).agg(F.count("*").alias("rows"))
    copies = staged(by_id.groupBy("t", "s").agg(F.sum("rows").alias("copies"), F.min("rep").alias("rep"), F.min_by("rows", "rep").alias("rows")), "copies")
    kept = staged(_kept(_neighbours(staged(_suffixes(_one_each(long_ones.withColumn("number", number), copies), length), "suffixes"))), "kept")
    parts = staged(kept.groupBy("gram").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1"), "parts")
    places = staged(kept.groupBy("t", "s").agg(F.collect_set("pos").alias("places")).join(copies, ["t", "s"]).select("t", "s", "rep", "places"), "places")
    # One row of each text brings the context: the one with the smallest id; rows repeated under one id are dropped later.
    wanted = long_ones.join(places, ["t", "s"]).where(number == F.col("rep"))
    contexts = _contexts(wanted.select("text", "t", "s", "places"), length)
    dealt = contexts.join(parts, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("t", "first"), F.col("parts")).cast("int"))
    found = _repeats(dealt, length)
    over = found.where("kind > 0")
    again = over.groupBy("hash", "second").agg(F.count("*").alias("k")).where("k > 1").select("hash", "second")
    ranges = found.where("kind = 0").select("t", "s", "first", "last").unionByName(over.where("kind = 1").join(again, ["hash", "second"]).select("t", "s", "first", "last"))
    spans = staged(ranges.groupBy("t", "s").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans")), "spans")
    marks = staged(copies.where("copies > 1").select("t", "s", F.lit(True).alias("whole")).join(spans, ["t", "s"], "full").select("t", "s", F.coalesce("whole", F.lit(False)).alias("whole"), "spans"), "marks")
    joined = base.join(marks, ["t", "s"], "left").select("id", "text", "n", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(~F.col("whole"), F.col("spans")).alias("spans"))

    @lean
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, n, whole, spans in zip(pdf["id"], pdf["text"], pdf["n"], pdf["whole"], pdf["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = [[0, n]] if whole else []
                for s in spans if spans is not None and not whole else ():
                    a, b = s["first"], s["last"] + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), n]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((i, n, n - len(left), len(merged), hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": pdf["id"].dtype})

    return joined.mapInPandas(cut, f"doc_id {dict(base.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
