"""Merkle manifest of a dataset: a tree of digests for each language, a tree of their roots, proofs and re-checks.

A leaf is the digest of a row's fields. Leaves of a group ascend by id; every `FAN` consecutive nodes have one parent, the
digest of their digests in a row, until one node is left. The groups' roots, in group order, have a tree of their own.

Texts are hashed where they are read and only digests travel. Leaves are range-partitioned, so a group of any size has its
places without a task that sees all of it; aligned blocks of `FAN ** depth` places are whole subtrees, each built by one
task, and their roots are nodes of the next, so many times smaller table. A parent keeps a copy of its hash state from
before each child: to fold a replaced leaf, a level resumes the state at its place and takes the replacement and the siblings
to its right only. Above its own block a node's path is the same for all leaves of the block; its states are kept there
once. States do not leave the process, a block's task makes those on its path from the siblings to their left.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timeweave.llm.common import ASCII_LOWER, ASCII_UPPER, lower_ascii, staged

FAN, DEPTH = 8, 4
PATH = "array<struct<left:binary,right:binary>>"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def depth_of(n: int, most: int) -> int:
    """Levels above the nodes of a block, in a group of n nodes."""
    levels = 0
    while levels < most and FAN**levels < n:
        levels += 1
    return levels


class Subtree:
    """The tree over one block's nodes: digests of each level, and the hash state before each child."""

    def __init__(self, digests: list[bytes], depth: int):
        self.levels, self.states = [digests], []
        for _ in range(depth):
            row, states, above = self.levels[-1], [], []
            for start in range(0, len(row), FAN):
                h = sha256()
                for digest in row[start : start + FAN]:
                    states.append(h.copy())
                    h.update(digest)
                above.append(h.hexdigest().encode())
            self.states.append(states)
            self.levels.append(above)

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> Iterator[tuple[bytes, bytes]]:
        """Siblings to the left and to the right, level by level."""
        for row in self.levels[:-1]:
            start = at - at % FAN
            yield b"".join(row[start:at]), b"".join(row[at + 1 : start + FAN])
            at //= FAN

    def fold(self, at: int, digest: bytes) -> bytes:
        """The root with another digest at a place."""
        for row, states in zip(self.levels, self.states):
            h = states[at].copy()
            h.update(digest + b"".join(row[at + 1 : at - at % FAN + FAN]))
            digest, at = h.hexdigest().encode(), at // FAN
        return digest


class Chain:
    """A path above a block: the states before the path's own child, and what is to its right."""

    def __init__(self, path: list[tuple[bytes, bytes]]):
        self.parts = [(sha256(left), left + right, right) for left, right in path]

    def fold(self, digest: bytes) -> bytes:
        for state, _, right in self.parts:
            h = state.copy()
            h.update(digest + right)
            digest = h.hexdigest().encode()
        return digest


def field(c: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, g, leaf, changed) of documents: g orders as lang with null first, `changed` is the digest after tampering,
    null for rows that stay."""
    whole = lambda text: F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("g"),
        whole(F.col("text")).alias("leaf"), F.when(hit, whole(lower_ascii(F.col("text")))).alias("changed"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place within their group g by `order`, and n, the group's rows. A group may be spread over any
    number of tasks; a row for each group and task has the counts."""
    sorted_ = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
    sorted_ = staged(sorted_, "placed").withColumn("part", F.shiftright("at", 33))
    counts = sorted_.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = F.sum("rows").over(W.partitionBy("g").orderBy("part")) - F.col("rows")
    starts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(W.partitionBy("g")).alias("n"))
    return sorted_.join(starts, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def block_of(pos: str, depth: int) -> Column:
    return F.floor(F.col(pos) / FAN**depth).cast("long")


def block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """(g, pos, digest, n) of the blocks of nodes (g, pos, digest, n)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree = Subtree([d.encode() for d in pdf["digest"]], depth_of(n := int(pdf["n"].iloc[0]), depth))
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "pos": pdf["block"].iloc[:1], "digest": tree.root.decode(), "n": -(-n // FAN**depth)})

    blocks = nodes.select("g", "pos", "digest", "n", block_of("pos", depth).alias("block"))
    return staged(blocks.groupBy("g", "block").applyInPandas(build, "g string, pos long, digest string, n long"), "roots")


def paths(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """For nodes (g, pos, digest, n), which are few beside the leaves: (g, pos, path up to the group's root), (g, root)."""
    up = block_roots(nodes, depth)
    if up.where("n > 1").isEmpty():
        tails, roots = up.select("g", "pos", F.array().cast(PATH).alias("path")), up.select("g", F.col("digest").alias("root"))
    else:
        tails, roots = paths(up, depth)

    def walk(mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("pos")
        tree = Subtree([d.encode() for d in mine["digest"]], depth_of(int(mine["n"].iloc[0]), depth))
        tail = list(above["path"].iloc[0])
        steps = [[{"left": a, "right": b} for a, b in tree.path(k)] + tail for k in range(len(mine))]
        return pd.DataFrame({"g": mine["g"], "pos": mine["pos"], "path": steps})

    grouped = nodes.withColumn("block", block_of("pos", depth)).groupBy("g", "block")
    above = tails.withColumnRenamed("pos", "block").groupBy("g", "block")
    return staged(grouped.cogroup(above).applyInPandas(walk, f"g string, pos long, path {PATH}"), "paths"), roots


def manifest(leaves: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """From leaf rows (doc_id, g, leaf, changed): the same rows with pos and n, and of each block of a group
    (g, block, path up to the root over all groups, subroot, root)."""
    rows = staged(placed(leaves, ["doc_id", "leaf"]), "leaves")
    blocks = block_roots(rows.select("g", "pos", F.col("leaf").alias("digest"), "n"), depth)
    if blocks.where("n > 1").isEmpty():
        inner, subroots = blocks.select("g", "pos", F.array().cast(PATH).alias("path")), blocks.select("g", F.col("digest").alias("root"))
    else:
        inner, subroots = paths(blocks, depth)
    groups = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")), ["name"])
    groups = staged(groups, "groups")
    outer, root = paths(groups.select("g", "pos", "digest", "n"), depth)
    top = groups.join(outer, ["g", "pos"]).join(root, "g").select(F.col("name").alias("g"), F.col("path").alias("outer"), F.col("digest").alias("subroot"), "root")
    tails = inner.join(top, "g").select("g", F.col("pos").alias("block"), F.concat("path", "outer").alias("path"), "subroot", "root")
    return rows, staged(tails, "tails")


def verify(docs: DataFrame, proofs: bool = False, depth: int = DEPTH) -> DataFrame:
    """One row per document row: doc_id, leaf, subroot, root, proof_sha256 of the untampered dataset, folded_root from the
    tampered row where it is tampered with, and whether that is the root; with `proofs`, the siblings too, a row's
    digests end to end.

    Nulls are fields of their own (`-`); a null lang is a group before all others; null ids come first and are never
    tampered with. Rows that share an id stand in the order of their digests, equal rows in any (their digests are equal,
    their proofs are those of their places). Long texts are hashed whole in one scan. An empty table gives no rows. Other
    columns are not read.
    """
    rows, tails = manifest(leaf_rows(docs), depth)

    def prove(mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine, top = mine.sort_values("pos"), above.iloc[0]
        tree = Subtree([d.encode() for d in mine["leaf"]], depth_of(int(mine["n"].iloc[0]), depth))
        chain, root = Chain([(bytes(x["left"]), bytes(x["right"])) for x in top["path"]]), top["root"]
        out = []
        for k, (doc_id, leaf, changed) in enumerate(zip(mine["doc_id"], mine["leaf"], mine["changed"])):
            proof = b"".join([a + b for a, b in tree.path(k)] + [both for _, both, _ in chain.parts])
            folded = chain.fold(tree.fold(k, (leaf if pd.isna(changed) else changed).encode())).decode()
            out.append((None if pd.isna(doc_id) else int(doc_id), leaf, top["subroot"], root, sha256(proof).hexdigest(), folded, folded == root, *([proof.decode()] if proofs else [])))
        names = [c.split()[0] for c in PROVED.split(", ")] + ["proof"] * proofs
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    # Ids travel as text: a null would turn a pandas column of them into floats.
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "g", "leaf", "changed", "pos", "n", block_of("pos", depth).alias("block"))
    return rows.groupBy("g", "block").cogroup(tails.groupBy("g", "block")).applyInPandas(prove, PROVED + ", proof string" * proofs)


def crc32_sql(key: str) -> str:
    """crc32 of an ASCII string in DuckDB: a fold over its bytes with the usual table, made from its polynomial."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ 0xEDB88320 * (k & 1)
        table.append(k)
    step = f"xor(a >> 8, CAST({table} AS BIGINT[])[(xor(a, b) & 255) + 1])"
    codes = f"list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {step}), 4294967295)"


def _levels(name: str, levels: int) -> str:
    """CTEs over {name}0 (g, i, d) and {name}f0 (g, i, n, cur, proof, k): a tree of up to FAN ** levels nodes a group, and every
    k's fold and proof up to {name}f<levels>; {name}<levels> has the roots."""
    out = []
    for k in range(levels):
        a, b = f"{name}{k}", f"{name}{k + 1}"
        out.append(f"{a}r AS (SELECT g, i // {FAN} AS j, list(d ORDER BY i) AS ds, any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {a}) GROUP BY 1, 2)")
        out.append(f"{b} AS (SELECT g, j AS i, CASE WHEN c > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {a}r)")
        left, right = f"array_to_string(ds[1:i % {FAN}], '')", f"array_to_string(ds[i % {FAN} + 2:], '')"
        out.append(f"""{name}f{k + 1} AS (SELECT f.k, f.g, f.i // {FAN} AS i, CASE WHEN c > 1 THEN sha256({left} || f.cur || {right}) ELSE f.cur END AS cur, CASE WHEN c > 1 THEN f.proof || {left} || {right} ELSE f.proof END AS proof
  FROM {name}f{k} f JOIN {a}r r ON r.g = f.g AND r.j = f.i // {FAN})""")
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    one = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(one(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Trees of up to 8 ** 8 documents a language and 8 ** 4 languages.
ORACLE_SQL = f"""WITH base AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_leaf_sql('text')} AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}')")} END AS changed FROM documents),
  docs AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS k FROM base),
  t0 AS (SELECT g, i, leaf AS d FROM docs), tf0 AS (SELECT k, g, i, coalesce(changed, leaf) AS cur, '' AS proof FROM docs),
  {_levels("t", 8)},
  s0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS name FROM t8),
  sf0 AS (SELECT f.k, s.g, s.i, f.cur, f.proof FROM tf8 f JOIN s0 s ON s.name = f.g),
  {_levels("s", 4)}
  SELECT d.doc_id, d.leaf, t.d AS subroot, r.d AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = r.d AS verified FROM docs d JOIN sf4 f USING (k) JOIN t8 t ON t.g = d.g CROSS JOIN s4 r"""
