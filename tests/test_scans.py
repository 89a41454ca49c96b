"""Scans batch by batch and block by block against plain loops over a whole chunk."""

import random

import pytest
from pyspark.sql import functions as F

from timeweave.operators import sequences, speakers, split


def chunk(seed, n):
    """Rows whose gaps, lengths, marks and labels make every rule fire."""
    r, t, rows = random.Random(seed), 0, []
    talk = r.choice([0.02, 0.3])
    for i in range(n):
        t += r.choice([0, 30, 300, 450]) if r.random() > talk else r.choice([500, 1499, 1501, 4000])
        d = r.choice([80, 200, 900, 2500])
        rows.append({"word_idx": i, "start_ms": t, "end_ms": t + d, "mark": r.random() < talk / 3, "speaker": r.choice("AABBC")})
        t += d
    return rows


RULES = {
    "gap": (lambda: split.SplitGapSegments(1500, 400, 3000, 15000), "segment"),
    "punct": (lambda: split.SplitPunctSegments(12000, 30), "segment"),
    "short": (lambda: split.SplitPunctSegments(5000, 3), "segment"),
    "aba": (lambda: split.SplitSmoothAba("word_idx", "speaker"), "speaker"),
}


def columns(rows):
    return {c: [r[c] for r in rows] for c in rows[0]}


def run(rule, blocks, out):
    got = []
    for b in blocks:
        got += rule.take(columns(b)).get(out, [])
    return got + rule.close().get(out, [])


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("seed", range(6))
def test_blocks_cut_anywhere_give_the_rows_of_the_whole(name, seed):
    make, out = RULES[name]
    r, rows = random.Random(seed), chunk(seed, 700)
    whole = run(make(), [rows], out)
    for _ in range(12):
        cuts = sorted(r.sample(range(1, len(rows)), r.choice([1, 5, 60])))
        blocks = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        assert run(make(), blocks, out) == whole
        state, got = make().state(), []
        for k, b in enumerate(blocks):
            rule = make()
            rule.resume(state)
            got += rule.take(columns(b)).get(out, []) + (rule.close().get(out, []) if k == len(blocks) - 1 else [])
            state = make().behind(make().table(columns(b)), state)
            assert state == rule.state() or k == len(blocks) - 1
        assert got == whole


def test_tables_are_short():
    """A map has entries for about fifteen seconds of words or thirty words, whatever the block's length."""
    rows = columns([{"start_ms": 200 * i, "end_ms": 200 * i + 150, "mark": False} for i in range(20_000)])
    assert len(RULES["gap"][0]().table(rows)[2]) < 100 and len(RULES["punct"][0]().table(rows)[1]) < 100


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_one_chunk_over_many_tasks(spark, block_rows):
    rows = [{"chunk_id": c, "word": "w." if r["mark"] else "w"} | r for c, n in ((1, 5000), (2, 3), (3, 1)) for r in chunk(c, n)]
    df = spark.createDataFrame(rows, "chunk_id long, word string, word_idx long, start_ms long, end_ms long, mark boolean, speaker string")
    for one, many in ((sequences.gap_segments(df), split.gap_segments(df, block_rows=block_rows)), (sequences.punct_segments(df), split.punct_segments(df, block_rows=block_rows)), (sequences.smooth_aba(df, "word_idx"), split.smooth_aba(df, "word_idx", block_rows=block_rows))):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def plain_cuts(rows, every, slack, tail):
    total, target, cuts = max(e for _, e in rows), every, []
    gaps = [(b[0] - a[1], -a[1], (a[1] + b[0]) // 2) for a, b in zip(rows, rows[1:]) if b[0] > a[1]]
    while target < total:
        near = [g for g in gaps if -g[1] >= target - slack and g[0] - g[1] <= min(target + slack, total - tail)]
        cuts.append(max(near)[2] if near else target)
        target = cuts[-1] + every
    return cuts


@pytest.mark.parametrize("seed", range(20))
def test_silence_cuts_batch_by_batch(seed):
    r, t, rows = random.Random(seed), 0, []
    for _ in range(r.choice([1, 5, 200])):
        t += r.choice([-300, 0, 100, 700, 2000, 9000])
        d = r.choice([200, 3000, 20000])
        rows.append((t, t + d))
        t += d
    rows.sort()
    for size in (1, 3, 1000):
        rule, got = sequences.SilenceCuts(20_000, 5000, 1000), []
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            got += rule.take({"start_ms": [x for x, _ in part], "end_ms": [y for _, y in part]})["cut_ms"]
        out = rule.close()
        assert got + out.get("cut_ms", []) == plain_cuts(rows, 20_000, 5000, 1000)
        assert len(rule.gaps) < 60


def test_scans_take_a_long_chunk_in_batches(spark):
    """A million rows of one chunk; no call gets more than an Arrow batch."""

    class Largest(sequences.Scan):
        def __init__(self):
            self.most, self.n = 0, 0

        def take(self, c):
            self.most, self.n = max(self.most, len(c["id"])), self.n + len(c["id"])
            return {}

        def close(self):
            return {"most": [self.most], "n": [self.n]}

    rows = spark.range(1_000_000).select(F.lit(7).cast("long").alias("chunk_id"), "id")
    (row,) = sequences.scan(rows, ["id"], Largest, "chunk_id long, most long, n long").collect()
    assert row["n"] == 1_000_000 and row["most"] <= 10_000


def test_scans_of_awkward_keys(spark):
    rows = spark.createDataFrame([(None, 1, 5, 6), (None, 2, 8000, 8001), (4, 0, 5, 6)], "chunk_id long, word_idx long, start_ms long, end_ms long")
    assert sorted(map(str, map(tuple, sequences.gap_segments(rows).collect()))) == ["(4, 0, 0)", "(None, 1, 0)", "(None, 2, 1)"]
    assert sequences.gap_segments(rows.limit(0)).collect() == []


def test_vector_means_are_summed_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    means = speakers.mean_vectors(df.repartition(4), ["k"])
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "partial_summarizer" in plan.lower() or "partial_aggregate_metrics" in plan.lower() or plan.count("ObjectHashAggregate") == 2, plan
    assert "Generate" not in plan
    got = {r["k"]: r["centroid"] for r in means.collect()}
    for k in range(3):
        m = sum(range(k, 10_000, 3)) / len(range(k, 10_000, 3))
        assert got[k] == pytest.approx([m / (m * m + 1) ** 0.5, 1 / (m * m + 1) ** 0.5])
