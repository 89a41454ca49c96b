"""Conversation repair, Merkle manifests and pattern packing against plain versions."""

import random
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timeweave.llm import merkle, patterns, queries, repair
from timeweave.llm.encoding import ByteEncoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# Conversation repair


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """(counts, cost, audit, repaired) of rows (turn, role, text) by trying every edit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, room):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for role in ("user", "assistant"):
            if room and (to := go.get((state, role[0]))):
                cost, audit, said = best(i, to, room - 1)
                found.append((5 + cost, "I" + audit, (f"{role}:", *said)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, said = best(i + 1, state, 2)
            found.append((2 + cost, "D" + audit, said))
            if faults[i] not in ("blank", "duplicate"):
                add = 5 * (faults[i] == "truncated")
                for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if to := go.get((state, new[:1])):
                        cost, audit, said = best(i + 1, to, 2)
                        found.append((add + (letter == "R") + cost, letter + audit, (f"{new}:{text}", *said)))
        return min(found, default=(10**9, "", ()))

    cost, audit, said = best(0, "", 2)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(said).encode()).hexdigest()


CONVERSATION = "conv_id long, turn long, role string, text string, g string, block long, at long"


def conversation_rows(seed, n=40):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.choice([0, 1, 2, 3, 5, 9])):
            turn = r.choice([turn, turn, turn, 3 * turn, None, -turn])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ubot"])
            rows.append((conv, turn, role, r.choice(["Yes.", "No", "Why? ", "ok!\n", " \t", "", None, "a.b", "é…", "Yes."])))
    return rows


@pytest.mark.parametrize("most_rows", [1024, 1, 3])
def test_repair_is_the_cheapest(spark, most_rows):
    rows = conversation_rows(most_rows)
    df = spark.createDataFrame([(*r, "g", 1, 2) for r in rows], CONVERSATION)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, most_rows).collect()}
    assert got == {conv: plain_repair(kept) for conv, kept in plain_damage(rows).items()}


def test_repair_of_one_conversation_over_many_tasks(spark):
    """Ten thousand turns of one conversation, a third of them copies of one row, cut into blocks of 64."""
    df = spark.range(10_000).select(F.lit(1).cast("long").alias("conv_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("turn"), F.when(F.col("id") % 3 == 0, "user").when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), F.when(F.col("id") % 3 == 0, "same.").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("."))).alias("text"))
    small, large = (repair.repair(df, n).collect() for n in (64, 1 << 20))
    assert small == large and len(small) == 1
    blocks = repair.blocks(repair.coded(repair.damage(df)), 64)
    sizes = [len(r["codes"]) for r in blocks.select("codes").collect()]
    assert max(sizes) <= 64 and sum(sizes) < 7000


def test_vectors_of_a_walk_are_kept_at_checkpoints_only(monkeypatch):
    codes, copies = bytes(random.Random(4).choices(range(16), k=400)), [1] * 400
    calls, real = [], repair.back
    monkeypatch.setattr(repair, "back", lambda *a: calls.append(1) or real(*a))
    edits, _ = repair.walk(codes, copies, repair.END, 0, True)
    assert len(calls) == 800 and "".join(e[0] for e in edits).count("I") + 400 == len(edits)


def test_repaired_turns_have_the_form(spark, sf):
    edited = repair.edited_blocks(repair.damage(spark.read.parquet(f"{sf}/conversations.parquet")))
    rows = repair.repaired_turns(edited).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "pos", "role"))), lambda x: F.left(x["role"], F.lit(1))), "").alias("s"))
    assert rows.where("NOT s RLIKE '^s?(ua)+$'").count() == 0 and rows.count() > 0


def test_no_conversations(spark):
    assert repair.repair(spark.createDataFrame([], CONVERSATION)).collect() == []


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest"])
def test_query_agrees_with_sql(agree, name):
    agree(queries.QUERIES[name], queries.ORACLE_SQL[name])


# Merkle manifest


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(field, r))  # noqa: E731  rows are doc_id, source, lang, n_chars, text
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    top, out = plain_tree([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            changed = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            at, proof, now = i, "", leaf(changed)
            for levels, start in ((trees[g], i), (top, k)):
                at = start
                for row in levels[:-1]:
                    run, slot = row[at - at % 8 : at - at % 8 + 8], at % 8
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    now = digest(*run[:slot], now, *run[slot + 1 :])
                    at //= 8
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], digest(proof), now, now == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, pos long, n int"


@pytest.mark.parametrize("depth", [4, 1])
def test_manifest_is_the_plain_tree(spark, depth):
    """With blocks of one level, paths go through several tables of roots."""
    r = random.Random(depth)
    rows = [(i, "s", r.choice(["en"] * 9 + ["de", "fr", "", "é"]), 3, r.choice(["Ab", "ab", "ÀB", ""])) for i in r.sample(range(-500, 5000), 700)]
    rows += [(None, None, None, None, None), (None, None, None, None, "Ab"), (7, "s", "en", 1, None), (7, "s", "en", 1, None), (7, "s", "en", 1, "Zz"), (1 << 62, "s", "zz", 1, "X" * 100_000)]
    df = spark.createDataFrame([(*x, "g", "leaf", 1, 2) for x in rows], DOCS)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(merkle.verify(df, depth=depth).collect()) == order(plain_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_small_manifests(spark, n):
    rows = [(i, "s", "en", 1, "T") for i in range(n)]
    df = spark.createDataFrame([(*x, "g", "leaf", 1, 2) for x in rows], DOCS)
    got = merkle.verify(df, proofs=True).collect()
    assert sorted(tuple(r)[:-1] for r in got) == plain_manifest(rows)
    assert all(digest(r["proof"]) == r["proof_sha256"] and len(r["proof"]) % 64 == 0 for r in got)


def test_a_fold_takes_right_siblings_only():
    tree = merkle.Subtree([digest(str(k)).encode() for k in range(100)], 3)
    want = [tree.fold(k, b"x" * 64) for k in range(100)]
    for k in range(100):
        hidden = merkle.Subtree.__new__(merkle.Subtree)
        hidden.states, hidden.levels = tree.states, []
        at = k
        for row in tree.levels:  # what is left of the path is not looked at
            hidden.levels.append([b"?" if i <= at else d for i, d in enumerate(row)])
            at //= 8
        assert hidden.fold(k, b"x" * 64) == want[k]


# Pattern packing


def test_byte_encoder_is_the_library():
    tok, enc, r = Tokenizer.from_file(BYTES), ByteEncoder(BYTES), random.Random(5)
    alphabet = list("abcXYZ0129 .,'\n\t\r  \n\n'’éß中文😀<|>-_") + ["'s", "'ll", " 's", "<|endoftext|>", "\xa0", " ", "\x1c", "\x85", "  ", "\x0b", "\x0c", "\0", "²", "١", "word ", " the"]
    for _ in range(20_000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 24)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids
    enc.most_bytes = 1000
    for _ in range(2000):
        text = " ".join("".join(r.choices("abcdef.", k=5)) for _ in range(9))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


def check_packing(got, docs, size):
    """Every id of every document lies in one piece, and sequences have neither gaps nor more than `size` tokens."""
    tok = Tokenizer.from_file(BYTES)
    want = []
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values(), default=0) <= size
    return len(ends), -(-sum(ends.values()) // size)


def test_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op13_pattern_packing(spark, sf).collect()
    used, bound = check_packing(got, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)
    assert used <= 1.02 * bound


def test_packing_of_awkward_rows(spark):
    rows = [(None, "no id"), (None, None), (3, "one two three"), (3, "one two three"), (5, ""), (1 << 60, "z " * 9000), (8, "a"), (9, " x\n\n y  ")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, length long, part int, at long, place long, n long")
    got = patterns.pack(df, BYTES, 2, 64, ids=True).collect()
    check_packing(got, rows, 64)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert patterns.pack(df.limit(0), BYTES, 2, 64).collect() == []


@pytest.mark.parametrize("counts", ["even", "short", "long", "one", "few", "millions"])
def test_plans_use_every_piece(counts):
    r, size = np.random.default_rng(1), 256
    c = np.zeros(size + 1, np.int64)
    if counts in ("even", "millions"):
        c[1:] = r.integers(0, 50, size) * (1 if counts == "even" else 100_000)
    elif counts == "short":
        c[1:20] = 1000
    elif counts == "long":
        c[200:] = r.integers(0, 9, size + 1 - 200)
    elif counts == "one":
        c[100] = 1001
    else:
        c[[3, 90, 200, 256]] = 1
    plan = patterns.make_plan(c, size)
    used = np.zeros(size + 1, np.int64)
    for pattern, times in zip(plan.patterns, plan.repeats):
        assert sum(n * uses for n, uses in pattern) <= size
        for n, uses in pattern:
            used[n] += uses * times
    assert (used == c).all() and not plan.counts.any()
    lengths, bound = np.arange(size + 1), max(-(-(c * np.arange(size + 1)).sum() // size), c[size // 2 + 1 :].sum())
    if counts == "one":
        bound = 501
    assert sum(plan.repeats) <= 1.02 * bound + 2, (sum(plan.repeats), bound, lengths[c > 0][:5])


def test_fit_takes_up_the_histogram():
    """Counts that were made from patterns are taken up by them, but for rounding."""
    r, size = np.random.default_rng(2), 128
    c = np.zeros(size + 1, np.int64)
    for a in range(1, 64):
        n = int(r.integers(50, 500))
        c[a] += n
        c[size - a] += n
    found = patterns.exact_patterns(size, c)
    assert (found.sum(1) == size).all() and ((found > 0).sum(1) >= 2).all()
    x = patterns.nonnegative_fit(found, c.astype(float))
    total = np.bincount(found.ravel(), ((found > 0) * x[:, None]).ravel(), minlength=size + 1)
    assert (x >= 0).all() and np.abs(total - c)[1:].sum() < 0.02 * c.sum()
    assert isinstance(patterns.make_plan(c, size).entries(), pd.DataFrame)
