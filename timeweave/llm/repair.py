"""Repair of conversation structure by the cheapest edits, found with a checkpointed dynamic program.

A conversation's rows, in the order of their turns, are edited until the initials of their roles read `(s?(ua)+)?`: a row is
kept, given another role or deleted, and empty rows may be put in. The cost of the best edits from a row on depends only on
what was read so far, one of four states, so a row has a vector of four costs. Vectors are kept at checkpoints only, a square
root of the rows apart; walking forward, the vectors between two checkpoints are made again and the first letter of
D, I, K, R that is on a cheapest way is taken.

Conversations of any length are dealt out: rows are range-partitioned by conversation and turn and cut into blocks, whose
ends are checkpoints too. A block's costs from state to state (a small matrix) tell the vector at its start from that at its
end, from the last block to the first; its walk tells the state at its end from that at its start, from the first to the last.
Only conversations in more than one block need these two passes, over matrices and states alone. Equal rows of one turn
are one row with a count, so many copies of a row are as cheap as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import staged
from timeweave.llm.merkle import crc32_sql

SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
#: States are nothing yet, after s, after u, after a; the state behind a role's initial (s, u, a, other) or none.
AFTER = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: The state behind a row that is put in or given another role, and that row's role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
END = (0, 10, 5, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

BLOCK = "g string, block long, codes binary, copies array<long>, turns array<long>, roles array<string>, texts array<string>, costs array<long>"
EDITED = "g string, block long, audit string, roles array<string>, texts array<string>, cost long, blank long, duplicate long, truncated long, illegal long, first int, last int, low long, high long, distinct long"
REPAIRED = "g string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def back(code: int, copies: int, v: tuple) -> tuple:
    """Costs before a row from those behind it. The row's further copies are deleted."""
    more = 2 * (copies - 1)
    v = [x + more for x in v]
    initial, fault = code & 3, code >> 2
    u = [2 + x for x in v]
    if fault not in (BLANK, DUPLICATE):
        add = 5 if fault == TRUNCATED else 0
        for q in range(4):
            to = AFTER[q][initial]
            u[q] = min(u[q], 1 + add + v[NEXT[q]], NEVER if to is None else add + v[to])
    u2, u3 = min(u[2], 5 + u[3]), min(u[3], 5 + u[2])
    return min(u[0], 5 + u2), min(u[1], 5 + u2), u2, u3


def matrix(codes: bytes, copies: list[int]) -> list[int]:
    """Cheapest cost from each state before a block to each behind it, row by row."""
    columns = []
    for p in range(4):
        v = tuple(0 if q == p else NEVER for q in range(4))
        for code, n in zip(reversed(codes), reversed(copies)):
            v = tuple(min(x, NEVER) for x in back(code, n, v))
        columns.append(v)
    return [columns[p][q] for q in range(4) for p in range(4)]


def walk(codes: bytes, copies: list[int], end: tuple, q: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """Edits (letter, row, state before) of a block on the way of least letters, and the state behind it."""
    n = len(codes)
    gap = max(1, isqrt(n))
    marks, v = {n: end}, end
    for i in range(n - 1, -1, -1):
        v = back(codes[i], copies[i], v)
        if i % gap == 0:
            marks[i] = v
    edits = []
    for start in range(0, n, gap):
        stop = min(n, start + gap)
        vectors = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(back(codes[i], copies[i], vectors[-1]))
        for i in range(start, stop):
            here, more = vectors[stop - i], 2 * (copies[i] - 1)
            behind = [x + more for x in vectors[stop - i - 1]]
            while here[q] != 2 + behind[q] and here[q] == 5 + here[NEXT[q]]:
                edits.append(("I", i, q))
                q = NEXT[q]
            fault, to = codes[i] >> 2, AFTER[q][codes[i] & 3]
            add = 5 if fault == TRUNCATED else 0
            if here[q] == 2 + behind[q]:
                edits.append(("D", i, q))
            elif to is not None and here[q] == add + behind[to]:
                edits.append(("K", i, q))
                q = to
            else:
                edits.append(("R", i, q))
                q = NEXT[q]
            if copies[i] > 1:
                edits.append(("D" * (copies[i] - 1), i, q))
    while last and end[q] > 0:
        edits.append(("I", n, q))
        q = NEXT[q]
    return edits, q


def key(c: str) -> Column:
    """A value as a group's name, apart from null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def damage(conversations: DataFrame) -> DataFrame:
    """(g, turn, role, text, copies): rows as the query damages them; a dropped row keeps its conversation with 0 copies."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    x = conversations.select(key("conv_id").alias("g"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    text = F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return x.select("g", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def coded(rows: DataFrame) -> DataFrame:
    """Rows (g, turn, role, text, copies) once each, with a digest that orders rows of one turn and a code: the role's
    initial (s, u, a, other: 0 to 3) and four times the first copy's fault."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    x = rows.groupBy("g", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", digest)
    stripped = F.rtrim("text", F.lit(SPACE))
    x = x.withColumn("blank", stripped == "").withColumn("cut", ~F.right(stripped, F.lit(1)).isin(".", "!", "?"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = x.where("copies > 0 AND NOT blank").groupBy("g", "digest").agg(F.count("*").alias("times"), F.min(place).alias("earliest"))
    x = x.join(said.where("times > 1").drop("times"), ["g", "digest"], "left")
    again = ~F.col("blank") & F.coalesce(place > F.col("earliest"), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    initial = F.when(F.left("role", F.lit(1)) == "s", 0).when(F.left("role", F.lit(1)) == "u", 1).when(F.left("role", F.lit(1)) == "a", 2).otherwise(3)
    return x.select("g", "turn", "digest", "role", "text", "copies", (fault * 4 + initial).cast("int").alias("code"))


def blocks(rows: DataFrame, most_rows: int, most_bytes: int = 8 << 20) -> DataFrame:
    """Coded rows in order, a row for each block of a conversation; `block` ascends within a conversation."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def row() -> list:
            held_ = [r for r in held if r[5] > 0]
            codes, copies = bytes(r[6] for r in held_), [int(r[5]) for r in held_]
            turns = [None if pd.isna(r[2]) else int(r[2]) for r in held_]
            return [held[0][0], held[0][1], codes, copies, turns, [r[3] for r in held_], [r[4] for r in held_], matrix(codes, copies)]

        for pdf in batches:
            out = []
            for r in zip(*(pdf[c] for c in ("g", "at", "turn", "role", "text", "copies", "code"))):
                if held and (r[0] != held[0][0] or len(held) >= most_rows or size >= most_bytes):
                    out.append(row())
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])
        if held:
            yield pd.DataFrame([row()], columns=[c.split()[0] for c in BLOCK.split(", ")])

    order = ["g", "turn", "digest"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # Turns travel as text: a null would turn a pandas column of them into floats.
    return staged(sorted_.select("g", "at", F.col("turn").cast("string").alias("turn"), "role", "text", "copies", "code").mapInPandas(cut, BLOCK), "blocks")


def _runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches, one after the other."""
    for pdf in batches:
        yield from zip(*(pdf[c] for c in columns))


def _chunked(rows: Iterator[tuple], names: list[str], most: int = 2000) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def block_ends(cut: DataFrame) -> DataFrame:
    """Of blocks of conversations with several: (g, block, end, entry, last), the costs behind a block and the state before it."""
    spread = cut.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    several = cut.join(spread, "g", "left_semi")

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run() -> Iterator[tuple]:
            for g, rows in groupby(_runs(batches, ["g", "block", "costs"]), key=lambda r: r[0]):
                v, last = END, True
                for _, block, costs in rows:
                    yield g, block, list(v), last
                    v, last = tuple(min(costs[4 * q + p] + v[p] for p in range(4)) for q in range(4)), False

        yield from _chunked(run(), ["g", "block", "end", "last"])

    ends = several.select("g", "block", "costs").repartition("g").sortWithinPartitions("g", F.desc("block")).mapInPandas(backward, "g string, block long, end array<long>, last boolean")
    ends = staged(ends, "ends")

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            to = [[walk(bytes(c), list(n), tuple(e), q, False)[1] for q in range(4)] for c, n, e in zip(pdf["codes"], pdf["copies"], pdf["end"])]
            yield pd.DataFrame({"g": pdf["g"], "block": pdf["block"], "to": to})

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run() -> Iterator[tuple]:
            for g, rows in groupby(_runs(batches, ["g", "block", "to"]), key=lambda r: r[0]):
                q = 0
                for _, block, to in rows:
                    yield g, block, q
                    q = int(to[q])

        yield from _chunked(run(), ["g", "block", "entry"])

    to = several.select("g", "block", "codes", "copies").join(ends, ["g", "block"]).select("g", "block", "codes", "copies", "end").mapInPandas(exits, "g string, block long, to array<int>")
    entries = to.repartition("g").sortWithinPartitions("g", "block").mapInPandas(forward, "g string, block long, entry int")
    return staged(ends.join(entries, ["g", "block"]), "entries")


def edited_blocks(rows: DataFrame, most_rows: int = 1024) -> DataFrame:
    """A row for each block of a conversation: its edits' letters, the rows that come out of it, and its counts."""
    cut = blocks(coded(rows), most_rows)

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                codes, copies, whole = bytes(r.codes), [int(n) for n in r.copies], r.end is None
                edits, _ = walk(codes, copies, END if whole else tuple(r.end), 0 if whole else int(r.entry), whole or bool(r.last))
                roles, texts, cost = [], [], 0
                for letter, i, q in edits:
                    cost += {"I": 5, "K": 0, "R": 1}.get(letter, 2 * len(letter))
                    if letter in ("K", "R"):
                        cost += 5 * (codes[i] >> 2 == TRUNCATED)
                    if letter[0] != "D":
                        roles.append(r.roles[i] if letter == "K" else ROLE[q])
                        texts.append("" if letter == "I" else r.texts[i])
                faults = [c >> 2 for c in codes]
                blank = sum(n for f, n in zip(faults, copies) if f == BLANK)
                again = sum(n - (f != DUPLICATE) for f, n in zip(faults, copies) if f != BLANK)
                pairs = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:])) + sum(n - 1 for n in copies)
                turns = sorted({t for t in r.turns if t is not None and t == t})
                low, high = (int(turns[0]), int(turns[-1])) if turns else (None, None)
                out.append((r.g, r.block, "".join(e[0] for e in edits), roles, texts, cost, blank, again, faults.count(TRUNCATED), pairs, codes[0] & 3 if codes else None, codes[-1] & 3 if codes else None, low, high, len(turns)))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])
            yield made.astype({"first": "Int32", "last": "Int32", "low": object, "high": object})

    # Arrays of turns without nulls stay exact; a null turn counts for nothing here.
    known = cut.withColumn("turns", F.filter("turns", lambda t: t.isNotNull())).drop("costs")
    return known.join(block_ends(cut), ["g", "block"], "left").mapInPandas(edit, EDITED)


def repaired_turns(edited: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, block and pos give their order."""
    rows = edited.select("g", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r"))
    return rows.select(F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30)).alias("conv_id"), "block", "pos", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def reports(edited: DataFrame) -> DataFrame:
    """A row for each conversation from its edited blocks, which pass by in order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EDITED.split(", ")]

        def run() -> Iterator[tuple]:
            for g, rows in groupby(_runs(batches, names), key=lambda r: r[0]):
                sums, audit, digest, any_row, before = [0] * 5, [], sha256(), False, None
                low = high = None
                distinct = 0
                for r in rows:
                    r = dict(zip(names, r))
                    audit.append(r["audit"])
                    for role, text in zip(r["roles"], r["texts"]):
                        digest.update(f"{chr(10) * any_row}{role}:{text}".encode())
                        any_row = True
                    sums = [a + int(r[c]) for a, c in zip(sums, ("blank", "duplicate", "truncated", "illegal", "cost"))]
                    if not pd.isna(r["first"]):
                        sums[3] += before is not None and (before, int(r["first"])) not in LEGAL
                        before = int(r["last"])
                    if r["low"] is not None and not pd.isna(r["low"]):
                        at, to = int(r["low"]), int(r["high"])
                        distinct += int(r["distinct"]) - (high == at)
                        low, high = at if low is None else low, to
                yield g, 0 if low is None else high - low + 1 - distinct, *sums, "".join(audit), digest.hexdigest()

        yield from _chunked(run(), [c.split()[0] for c in REPAIRED.split(", ")])

    # Numbers that may be null travel as text.
    flat = edited.withColumns({c: F.col(c).cast("string") for c in ("first", "last", "low", "high")})
    return flat.repartition("g").sortWithinPartitions("g", "block").mapInPandas(fold, REPAIRED)


def repair(conversations: DataFrame, most_rows: int = 1024) -> DataFrame:
    """The query: damages the rows, repairs the conversations and reports each, conversations without a row left too.

    A null conv_id is a conversation, a null role or text one space, a null turn comes first. Rows of one turn stand in
    the order of a digest of role and text, equal ones together. A role that is empty, or begins otherwise than the three,
    is never kept. Texts are whole, however long (a block closes after 8 MB of text). Other columns are not read. An empty
    table gives no rows.
    """
    out = reports(edited_blocks(damage(conversations), most_rows))
    conv_id = F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30).cast("long"))
    return out.select(conv_id.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _costs(q: int) -> str:
    """Costs in state q before a row with code columns f (fault), c (initial) from b[1..4] behind it."""
    keep = " ".join(f"WHEN c = {c} THEN b[{to + 1}]" for c, to in enumerate(AFTER[q]) if to is not None)
    add = "CASE WHEN f = 3 THEN 5 ELSE 0 END"
    return f"least(2 + b[{q + 1}], CASE WHEN f NOT IN (1, 2) THEN 1 + {add} + b[{NEXT[q] + 1}] END, CASE WHEN f NOT IN (1, 2) THEN {add} + CASE {keep} END END)"


_STEP = "[least(u[1], 5 + least(u[3], 5 + u[4])), least(u[2], 5 + least(u[3], 5 + u[4])), least(u[3], 5 + u[4]), least(u[4], 5 + u[3])]"
_KEPT = "CASE " + " ".join(f"WHEN q = {q} AND c = {c} THEN {to}" for q in range(4) for c, to in enumerate(AFTER[q]) if to is not None) + " END"
_WS = "E' \\t\\n\\x0b\\x0c\\r'"
ORACLE_SQL = rf"""WITH RECURSIVE k AS (SELECT coalesce('=' || conv_id, '-') AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
  d AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
  o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS i, rtrim(text, {_WS}) AS bare FROM d),
  x AS (SELECT g, i, turn, role, text, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS c FROM o),
  n AS (SELECT k.g, any_value(k.conv_id) AS conv_id, coalesce(any_value(m.n), 0) AS n FROM k LEFT JOIN (SELECT g, max(i) AS n FROM x GROUP BY 1) m USING (g) GROUP BY 1),
  v AS (SELECT g, n + 1 AS i, CAST({list(END)} AS BIGINT[]) AS b FROM n
    UNION ALL SELECT g, i - 1, {_STEP} FROM (SELECT x.g, v.i, [{", ".join(_costs(q) for q in range(4))}] AS u FROM v JOIN x ON x.g = v.g AND x.i = v.i - 1)),
  w AS (SELECT g, CAST(1 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM n
    UNION ALL SELECT g, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE other END, audit || edit,
      CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END) END
    FROM (SELECT *, CASE WHEN f IS NOT NULL AND a[q + 1] = 2 + b[q + 1] THEN 'D' WHEN a[q + 1] = 5 + a[other + 1] THEN 'I' WHEN f IS NULL THEN NULL WHEN f NOT IN (1, 2) AND kept IS NOT NULL AND a[q + 1] = b[kept + 1] + CASE WHEN f = 3 THEN 5 ELSE 0 END THEN 'K' ELSE 'R' END AS edit
      FROM (SELECT w.*, x.role, x.text, x.f, here.b AS a, behind.b AS b, {_KEPT} AS kept, CASE WHEN q = 2 THEN 3 ELSE 2 END AS other FROM w JOIN v here ON here.g = w.g AND here.i = w.i LEFT JOIN x ON x.g = w.g AND x.i = w.i LEFT JOIN v behind ON behind.g = w.g AND behind.i = w.i + 1)) WHERE edit IS NOT NULL),
  last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY length(audit) DESC) = 1),
  y AS (SELECT *, lag(c) OVER (PARTITION BY g ORDER BY i) AS p FROM x),
  s AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (p IS NOT NULL AND (p, c) NOT IN ((0, 1), (1, 2), (2, 1))) AS illegal FROM y GROUP BY 1)
  SELECT n.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, v.b[1] AS cost, last.audit, sha256(array_to_string(last.said, chr(10))) AS repaired_sha256
  FROM n JOIN v ON v.g = n.g AND v.i = 1 JOIN last ON last.g = n.g LEFT JOIN s ON s.g = n.g"""
