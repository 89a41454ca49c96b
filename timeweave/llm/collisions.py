"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors of a label are projected on many random directions. Two vectors collide on a direction when one lies in
a window centred on the other; a pair that collides often enough is verified by its cosine. Window and least count
come from the wanted recall of pairs exactly at the threshold. So that no task compares a whole label, each of
several tables first cuts a few further directions into cells whose number follows the row count; pairs are counted
inside cells, in the first table only where both vectors share a cell. A cell over `block` vectors is cut into blocks, and
each pair of blocks is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import lean, shuffle_width, staged
from timeweave.llm.graph import components

CELL_WIDTH = 8.0  # cell edges, in standard deviations of a threshold pair's difference


def _below(x: float) -> float:
    """Share of a centred normal within x standard deviations."""
    return math.erf(x / math.sqrt(2))


def calibrate(recall: float, directions: int, window: float = 2.0) -> int:
    """Least count of collisions that a pair at the threshold reaches with the wanted probability."""
    p, tail = _below(window), 0.0
    for least in range(directions, 0, -1):
        tail += math.comb(directions, least) * p**least * (1 - p) ** (directions - least)
        if tail >= recall:
            return least
    return 1


def split_chance(sigma: float, width: float) -> float:
    """Chance that a cell edge falls between two values whose difference is normal with deviation sigma."""
    return min(1.0, sigma * math.sqrt(2 / math.pi) / width)


def plan(rows: int, threshold: float, target: int, recall: float) -> tuple[int, int]:
    """(cut directions a table, tables): cells of about `target` vectors, tables for the wanted recall."""
    sigma = math.sqrt(2 * (1 - threshold))
    cells = max(1.0, math.sqrt(12) / (CELL_WIDTH * sigma) * 1.6)  # about how many cells one direction makes
    cuts = max(0, math.ceil(math.log(max(1.0, rows / target)) / math.log(max(cells, 1.5))))
    together = (1 - split_chance(sigma, CELL_WIDTH * sigma)) ** cuts
    return cuts, 1 if not cuts else max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def colliding_pairs(values: np.ndarray, groups: np.ndarray, window: float, least: int, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that collide on at least `least` of the directions (columns of values)."""
    n, codes = len(values), []
    span = float(np.ptp(values)) + 2 * window + 1
    shift = groups.astype(np.float64) * span
    for d in range(values.shape[1]):
        line = values[:, d] + shift
        order = np.argsort(line, kind="stable")
        line = line[order]
        ends = np.searchsorted(line, line + window, "right")
        width = ends - np.arange(1, n + 1)
        a = np.repeat(np.arange(n), width)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
        a, b = order[a], order[b]
        codes.append(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b))
    pairs, counts = np.unique(np.concatenate(codes), return_counts=True)
    pairs = pairs[counts >= least]
    a, b = pairs // n, pairs % n
    ok = allowed(a, b)
    return a[ok], b[ok]


class Roots:
    """Union by smallest id over a task's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def runs_of_groups(batches: Iterator[pd.DataFrame], keys: list[str], weight) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches into frames of whole groups; `weight(sizes)` bounds how many groups make a frame."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
        last = (whole[keys] == whole[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(whole) - int(last[::-1].argmin() if not last.all() else len(whole))
        if cut:
            yield from _parts(whole.iloc[:cut].reset_index(drop=True), keys, weight)
        held = [whole.iloc[cut:].reset_index(drop=True)]
    if held and len(held[0]):
        yield from _parts(pd.concat(held, ignore_index=True), keys, weight)


def _parts(pdf: pd.DataFrame, keys: list[str], weight) -> Iterator[pd.DataFrame]:
    new = np.r_[True, (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)]
    starts = np.append(np.flatnonzero(new), len(pdf))
    cost, at = np.cumsum(weight(np.diff(starts))), 0
    while at < len(starts) - 1:
        base = cost[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(cost, base + 1.0, "right")))
        part = pdf.iloc[starts[at] : starts[stop]].reset_index(drop=True)
        part["__group"] = np.cumsum(new[starts[at] : starts[stop]]) - 1
        yield part
        at = stop


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, recall: float = 0.99, directions: int = 24, seed: int = 11, target: int = 64, block: int = 128, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null label or id link
    with nothing. Vectors of different length never link. Equal vectors are searched once and count as links of each
    other. Rows that repeat an id are vectors of their own, equal or not. Extra columns are not read. Empty tables give no rows.
    Links found have a cosine of at least `threshold`; a pair at the threshold is found with about `recall`, closer
    pairs more often.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    own = raw.withColumn("ok", F.coalesce(sound, F.lit(False)))
    distinct = own.where("ok").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    reps = staged(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cuts, tables = plan(largest, threshold, target, math.sqrt(recall))
    sigma = math.sqrt(2 * (1 - threshold))
    window, least = 2.0 * sigma, calibrate(math.sqrt(recall), directions)

    def matrix(dim: int, kind: int, columns: int) -> np.ndarray:
        return np.random.default_rng([seed, kind, dim]).standard_normal((dim, max(1, columns)))

    def unit(v: pd.Series) -> list[np.ndarray]:
        out = []
        for x in v:
            x = np.asarray(x, float)
            x = x / np.abs(x).max()
            out.append(x / np.linalg.norm(x))
        return out

    @lean
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each vector length, once a task
        for pdf in batches:
            vectors, keys = unit(pdf["v"]), np.empty((len(pdf), tables), np.int64)
            lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for dim in np.unique(lengths):
                if dim not in drawn:
                    offset = np.random.default_rng([seed, 1, dim]).random(max(1, cuts) * tables) * CELL_WIDTH * sigma
                    drawn[dim] = (matrix(dim, 0, tables * cuts), offset)
                (directed, offset), rows = drawn[dim], np.flatnonzero(lengths == dim)
                proj = np.stack([vectors[i] for i in rows]) @ directed if cuts else np.zeros((len(rows), tables))
                cells = np.floor((proj + offset) / (CELL_WIDTH * sigma)).astype(np.int64).reshape(len(rows), tables, -1)
                mixed = np.full((len(rows), tables), dim, np.uint64)
                for c in range(cells.shape[2]):
                    mixed = (mixed ^ cells[:, :, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                keys[rows] = mixed.view(np.int64)
            yield pd.DataFrame({"label": pdf["label"], "rep": pdf["rep"], "copies": pdf["copies"], "v": pdf["v"], "keys": list(keys)})

    label_type = dict(reps.dtypes)["label"]
    routed = staged(reps.select("label", "rep", "copies", "v").mapInPandas(route, f"label {label_type}, rep long, copies long, v array<double>, keys array<long>"), "routed")
    spread = routed.select("label", "rep", "copies", "v", "keys", F.posexplode("keys").alias("t", "cell")).withColumn("cell", F.xxhash64("label", "cell", "t"))
    sizes = staged(spread.groupBy("t", "cell").count().where("count > 1").select("t", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "cells")
    placed = spread.join(sizes, ["t", "cell"])
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    grouped = placed.select("t", "cell", "rep", "copies", "v", "keys", mine.alias("mine"), other)
    grouped = grouped.select("t", F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "rep", "copies", "v", "keys", "mine", (F.col("mine") != F.col("other")).alias("cross"))

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs_of_groups(batches, ["t", "g"], lambda n: n * n / 400_000):
            groups = pdf["__group"].to_numpy()
            size = np.bincount(groups)[groups]
            pdf = pdf[size > 1].reset_index(drop=True)
            if not len(pdf):
                continue
            for _, part in pdf.groupby(pdf["v"].str.len(), sort=False):
                x = np.stack(unit(part["v"]))
                keys, t = np.stack(part["keys"].to_numpy()), part["t"].to_numpy()
                mine, cross, groups = part["mine"].to_numpy(), part["cross"].to_numpy(), part["__group"].to_numpy()

                def allowed(a, b, keys=keys, t=t, mine=mine, cross=cross):
                    first = (keys[a] == keys[b]).argmax(axis=1)
                    return (first == t[a]) & (~cross[a] | (mine[a] != mine[b]))

                a, b = colliding_pairs(x @ matrix(x.shape[1], 2, directions), groups, window, least, allowed)
                close = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[close], b[close]
                rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
                links = np.bincount(a, copies[b], len(part)) + np.bincount(b, copies[a], len(part))
                order = np.argsort(rep, kind="stable")
                rank = np.empty(len(rep), np.int64)
                rank[order] = np.arange(len(rep))
                roots = Roots(len(rep))
                for i, j in zip(rank[a].tolist(), rank[b].tolist()):
                    roots.join(i, j)
                hit = np.flatnonzero(links > 0)
                yield pd.DataFrame({"rep": rep[hit], "links": links[hit].astype(np.int64), "root": rep[order[[roots.find(r) for r in rank[hit].tolist()]]] if len(hit) else np.zeros(0, np.int64)})

    found = staged(grouped.repartition(shuffle_width(spark), "t", "g").sortWithinPartitions("t", "g").mapInPandas(count, "rep long, links long, root long"), "links")
    per_rep = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "root").select(F.col("id").alias("rep"), F.col("component").alias("part"))
    named = staged(reps.select("label", "v", "rep", "least", "copies").join(per_rep, "rep", "left").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "parts")
    least = named.groupBy("part").agg(F.min("least").alias("component"))
    linked = staged(named.join(least, "part").select("label", "v", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component"), "linked")
    out = own.join(linked.withColumn("ok", F.lit(True)), ["ok", "label", "v"], "left")
    links = F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
