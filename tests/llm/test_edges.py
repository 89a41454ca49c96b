"""Plain versions of the batched operators, and null, repeated, clashing and very long rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import collisions, decontaminate, line_dedup, packing, quality, queries, set_join, substrings, token_output, toxicity, warc

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, id long, x string, p int, h boolean, key string, w string, bucket int"


def awkward(spark, rows):
    """(doc_id, text) rows with columns whose names are used inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 9, "x", 3, True, "k", "w", 2) for i, t in rows], AWKWARD)


ROWS = [(None, "no id at all"), (None, None), (3, "one two three"), (3, "one two three"), (3, "another text under the same id"), (5, ""), (6, "z " * 60_000)]


def test_multikey_order_is_lexicographic():
    r = np.random.default_rng(1)
    for n, top in ((0, 2), (1, 2), (50, 3), (30_000, 2), (30_000, 5), (20_000, 1 << 40)):
        keys = r.integers(-top, top, (n, 4))
        assert (keys[substrings.multikey_order(keys)] == keys[np.lexsort(keys.T[::-1])]).all()


def test_leading_words_sort_as_bytes_do():
    raw = bytes(random.Random(2).choices(b"\x00a\x7f\x80\xff", k=3000))
    _, words, pos, _, _ = substrings.chosen_suffixes([raw], 200)
    order = [tuple(w) for w in words.tolist()]
    assert sorted(range(len(pos)), key=lambda k: order[k]) == sorted(range(len(pos)), key=lambda k: raw[pos[k] : pos[k] + 32])


@pytest.mark.parametrize("same", [True, False])
def test_windows_of_equal_hash_are_told_apart_by_bytes(same):
    r = random.Random(3)
    texts = [bytes(r.choices(b"ab", k=40)) for _ in range(30)]
    texts += [t[5:35] for t in texts[:10]]
    buf, length = np.frombuffer(b"".join(texts), np.uint8), 20
    starts = np.cumsum([0] + [len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), [len(t) - length + 1 for t in texts])
    at = np.concatenate([starts[k] + np.arange(len(t) - length + 1) for k, t in enumerate(texts)])
    hashes = np.zeros(len(at), np.uint64) if same else substrings.window_hashes(buf, at, length)
    got = substrings.same_windows(buf, at, row, hashes, length)
    names = {}
    want = [names.setdefault(buf[a : a + length].tobytes(), len(names)) for a in at]
    assert len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(names)


def test_substrings_do_not_rely_on_hashes(spark, monkeypatch):
    rows = [(1, "a" * 60 + "b" * 200), (2, "c" * 60 + "b" * 150 + "d" * 50), (3, "b" * 200 + "e")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(awkward(spark, rows)).collect()}
    assert got == {1: 200, 2: 0, 3: 200}


def test_toxicity_batches_are_the_plain_loop():
    """Windows of many texts at once score as each window does alone, step by step, one number at a time."""
    net = toxicity.BiGru.fresh(4)
    r = random.Random(4)
    texts = [" ".join(r.choices(["good", "vile", "thing", "über", "a" * 40, "毒無空白"], k=n)) for n in (0, 1, 5, 31, 32, 33, 90)]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def plain(words):
        best = None
        for s in toxicity.windows_of(len(words)):
            part = words[s : s + toxicity.WINDOW]
            word, chars, weight = toxicity.word_inputs(part)
            x = [np.concatenate([p["word"][w], sum(wt * p["char"][c] for c, wt in zip(cs, ws))]) for w, cs, ws in zip(word, chars, weight)]
            states = {}
            for k, steps in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                h = np.zeros(toxicity.HIDDEN)
                for t in steps:
                    a, g, n = x[t] @ p[f"W{k}"] + p[f"c{k}"], h @ p[f"U{k}"], toxicity.HIDDEN
                    z, u = 1 / (1 + np.exp(-(a[:n] + g[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + g[n : 2 * n])))
                    h = (1 - z) * np.tanh(a[2 * n :] + u * g[2 * n :]) + z * h
                    states[k, t] = h
            H = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(part))])
            score = np.exp(np.tanh(H @ p["A"] + p["a"]) @ p["v"])
            logit = (score / score.sum()) @ H @ p["o"] + p["bias"][0]
            best = logit if best is None else max(best, logit)
        return 0.0 if best is None else 1 / (1 + np.exp(-best))

    want = [plain(toxicity.words_of(t)) for t in texts]
    assert np.allclose(toxicity.score_texts(net, texts, most_windows=3), want, atol=1e-4)


def test_quality_over_the_table_is_the_plain_loop(spark):
    """Means, gradients and the histogram that tasks add up are those of one array."""
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcxyz%&,.", k=r.randrange(1, 9))) for _ in range(r.randrange(1, 60))) for _ in range(80)]
    docs = awkward(spark, list(enumerate(texts))).repartition(5)
    made = quality.featurise(docs)
    x = np.stack([quality.features(t) for t in texts]).astype(float)
    assert np.allclose(quality._summed(made, lambda b: b.sum(axis=0, dtype=float), quality.FEATURES), x.sum(axis=0), atol=1e-3)
    net = quality.fit_pu(x[:20], x, 0.6, epochs=2)
    s, g = quality._part(net, net.scaled(x))
    flat = quality._summed(made, lambda b: quality._part(net, net.scaled(b))[1]["w1"].ravel(), g["w1"].size)
    assert np.allclose(flat, g["w1"].ravel(), atol=1e-4)
    quality._placed(net, made, 0.6)
    got = {row["doc_id"]: row["score"] for row in quality.score(docs, net, made=made).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], net.score(x), atol=1e-5)
    for row in quality.score(docs, net, made=made).collect():
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)


def test_gradient_of_the_risk():
    r = np.random.default_rng(6)
    xp, xu = r.standard_normal((7, quality.FEATURES)), r.standard_normal((9, quality.FEATURES))
    net = quality.fit_pu(xp, xu, 0.4, np.zeros(quality.FEATURES), np.ones(quality.FEATURES), epochs=0)
    for prior in (0.4, 1.9):  # the second makes the bracket negative

        def risk():
            s_p, s_u = quality._part(net, net.scaled(xp))[0].mean(), quality._part(net, net.scaled(xu))[0].mean()
            rest = s_u - prior * s_p
            return prior * (1 - s_p) + rest if rest >= 0 else -rest

        sides = [(s.mean(), {k: v / len(x) for k, v in g.items()}) for x in (xp, xu) for s, g in [quality._part(net, net.scaled(x))]]
        g = quality._combine(net, prior, *sides, 0.0)
        for name in ("w1", "b1", "w2"):
            value = getattr(net, name)
            at = np.unravel_index(int(np.argmax(np.abs(g[name]))), value.shape)
            keep = value[at]
            value[at] = keep + 1e-5
            up = risk()
            value[at] = keep - 1e-5
            down = risk()
            value[at] = keep
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_valley_is_the_emptiest_stretch():
    counts = np.zeros(400, int)
    counts[40:100], counts[260:380] = 10, 10
    assert 150 < quality.valley(counts, 1 / 3) < 210


def test_scores_of_awkward_rows(spark):
    docs = awkward(spark, ROWS)
    labels = spark.createDataFrame([(3, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for got in (quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels))):
        rows = got.collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
        assert len({r["score"] for r in rows if r["doc_id"] == 3}) <= 2


def test_token_rows_of_repeated_ids(spark):
    rows = token_output.token_output(awkward(spark, ROWS).repartition(4), queries.word_vocabulary()).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 3, 3, 3, 5, 6]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:])) and rows[0]["start"] == 0
    again = sorted(token_output.token_output(awkward(spark, ROWS[::-1]), queries.word_vocabulary()).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_packing_of_repeated_ids(spark):
    got = packing.pack(awkward(spark, ROWS), queries.word_vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).collect()
    n = {r["doc_id"]: r["n"] for r in got}
    assert set(n) == {None, 3, 5, 6} and n[5] == 1 and n[6] == 60_001 and n[3] == 2 * 4 + 7


@pytest.mark.parametrize("rows", [10_000, 0])
def test_decontamination_of_repeated_ids(spark, rows):
    items = spark.createDataFrame([(1, "one two three"), (2, "same id"), (3, "z z")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(awkward(spark, ROWS), items, broadcast_rows=rows).collect()}
    # Three rows share id 3: words 0..2 are hit in two of them, 4..5 in the third.
    assert got == {None: (4, 0, 0), 3: (12, 5, 2), 5: (0, 0, 0), 6: (60_000, 60_000, 1)}
    kept = decontaminate.keep_uncontaminated(awkward(spark, ROWS), items)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "None", "None"] and kept.columns == awkward(spark, []).columns


def test_vectors_that_share_an_id(spark):
    v = lambda *x: [float(a) for a in x]
    rows = [(7, v(1, 0, 0), 1), (7, v(0, 1, 0), 1), (8, v(1, 0.01, 0), 1), (9, v(0.01, 1, 0), 1), (None, v(1, 0, 0), 1), (4, v(0, 0, 1), None)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "vec_id long, embedding array<double>, label int, rep long, part string")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in collisions.near_vectors(df).collect())
    assert got == Counter([(7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7), (None, 0, None), (4, 0, 4)])


def test_lines_of_repeated_and_long_rows(spark):
    rows = [(i, f"menu\nbody {i}\n" + "long " * 30_000 * (i == 3)) for i in range(9)] + [(3, "menu"), (None, "menu\nx"), (4, None)]
    got = line_dedup.strip_boilerplate(awkward(spark, rows), ratio=0.5).collect()
    assert len(got) == len(rows) and all(r["text"] is None or "menu" not in r["text"] for r in got)


def test_warc_folds_ends_and_decodes_rare_and_common_entities(spark):
    """A blank before a last line separator that is no line end stays; names stand for themselves wherever rare ones are."""
    said = ["a \u2028", " \n a \t b\r\n \n", "&hellip;&amp;lt; &#38;lt; &&#108;t;&eacute;", "&amp;lt;&copy;&amp;#38;", "&lt&#38;amp;", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", warc.folded(F.col("t")), warc.decode_entities(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in rows[:2]] == ["a \u2028", "a b"]

    def decoded(t):
        for name, char in [("&&#108;", "&l"), *warc.ENTITIES]:
            t = t.replace(name, char)
        return t

    assert [r[2] for r in rows] == [decoded(t) if t is not None else None for t in said]


def test_warc_of_awkward_pages(spark):
    pages = spark.createDataFrame([(None, "u", "<p>a"), (1, "u", "<p>a"), (1, "u", "<p>a"), (2, "u", "<script>" * 2000 + "x"), (3, "u", "<p>" + "w &#8217;&#x41; " * 20_000)], "page_id long, url string, html string")
    rows = warc.page_derivatives(pages).where("warc_type = 'conversion'").collect()
    by = Counter((r["page_id"], r["derived_id"]) for r in rows)
    assert len(rows) == 5 and max(by.values()) == 2 and len(by) == 4
    text = {r["page_id"]: r["block"] for r in rows}
    assert text[None] == text[1] == "a" and len(text[3]) == 5 * 20_000 - 1 and text[3].startswith("w ’A w")


def test_pipeline_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(9)
    long = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(500)) for _ in range(n))
    base = [long(60) for _ in range(6)]
    items = [" ".join(f"q{i}" for i in range(12))]
    texts = [None, "", " \n ", *base, base[0], base[1] + " tail", base[2] + " " + items[0], "menu\n" + base[3][:200], "z " * 40_000]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, base[4], "en", None, 1), (1, "", None, "s", 0), (1, "", None, "s", 0)]
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    labels = "doc_id long, quality int, toxic int"
    for name, part in (("full", rows), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(part, docs).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(k, items[0]) for k in range(len(part) and 1)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 0, 0)][: len(part)], labels).write.parquet(f"{sf}/labels.parquet")
        got = cp.run(spark, sf).collect()
        if not part:
            assert got == []
            continue
        kept = Counter(r["doc_id"] for r in got if r["start"] == 0)
        # Of base[0] and base[1] one document each stays, base[2] with the item goes, and so does the copy of base[4] without an id.
        assert 9 not in kept and 10 not in kept and 11 not in kept and kept[0] == 1 and kept[1] == 3 and kept[7] == 1 and kept[None] == 0
        assert set(kept) == {0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 13}


def test_set_join_of_awkward_rows(spark):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.near_texts(awkward(spark, ROWS)).collect())
    assert got == Counter([(None, 1, None), (None, 0, None), (3, 1, 3), (3, 1, 3), (3, 3, 3), (5, 0, 5), (6, 1, 6)])


@pytest.mark.parametrize("seed", [1, 2])
def test_long_chains_stay_whole(spark, seed):
    """Chains of 200 texts that move on by five of 103 words: neighbours have a Jaccard of .90, texts farther apart do not link."""
    r = random.Random(seed)
    ids = list(range(8 * 200))
    r.shuffle(ids)
    rows, want = [], {}
    for chain in range(8):
        stream = [f"w{r.randrange(10**9)}" for _ in range(103 + 5 * 199)]
        own = ids[200 * chain : 200 * chain + 200]
        rows += [(i, " ".join(stream[5 * k : 5 * k + 103])) for k, i in enumerate(own)]
        want |= {i: min(own) for i in own}
    got = set_join.near_texts(awkward(spark, rows).repartition(4)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_long_labelled_texts_teach_in_slices(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (2, "".join(chr(97 + i // 40) for i in range(800))), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), {0: 5, 1: 5}, most_chars=80, slices=4)
    assert dict(zip(got["id"], got["y"])) == {1: 0, 2: 1}
    text = dict(zip(got["id"], got["text"]))
    whole = "".join(chr(97 + i // 40) for i in range(800))
    assert text[1] == "a" * 50 and text[2].split("\n") == [whole[s : s + 20] for s in (0, 260, 520, 780)]


def test_toxicity_cut_has_the_fewest_errors():
    out, y = np.array([-3.0, -2, -1, 0.5, 2, 4]), np.array([0, 0, 1, 0, 1, 1])
    error, cut = toxicity._cut(out, y)
    assert error == 1 / 6 and ((out >= cut) != y).sum() == 1
    assert toxicity._cut(np.array([-1.0, 2.0]), np.array([0, 1])) == (0, 0)


def test_toxic_stems_generalise_to_unseen_words():
    r = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(600):
        words = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(40)]
        if i % 5 == 0:
            words[7:7] = ["grolk" + "".join(r.choice(list("abcdefghij"), 4)) for _ in range(3)]  # no word twice, one stem
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    net = toxicity.train(texts[:450], np.array(labels[:450]))
    got, want = toxicity.score_texts(net, texts[450:]) >= 0.5, np.array(labels[450:]) == 1
    assert (got == want).mean() >= 0.97


def test_an_epoch_is_the_mean_of_the_tasks_walks(spark):
    r = np.random.default_rng(3)
    x = r.random((70, quality.FEATURES)).astype(np.float32)
    made = spark.createDataFrame(spark.sparkContext.parallelize([(i, x[i].tolist()) for i in range(70)], 3), "id long, x array<float>")
    net = quality.fit_pu(x[:20], x, 0.6, epochs=1)
    mean, after = quality.epoch(net, made, x[:20], 0.6)
    walks = [quality.walk(net, iter([block]), x[:20], 0.6) for block in (x[:23], x[23:46], x[46:])]
    assert mean == pytest.approx(quality.sigmoid(net.logits(x)).mean())
    assert [n for n, _, _ in walks] == [23, 23, 24]
    for k in quality.WEIGHTS:
        assert np.allclose(getattr(after, k), sum(n * getattr(own, k) for n, _, own in walks) / 70)
        assert not np.allclose(getattr(after, k), getattr(net, k))


def test_epochs_read_rows_beyond_the_sample(spark):
    """Weights start from ten rows; the epochs over all rows lower the risk over all rows."""
    good, junk = "The quick brown fox jumps over the lazy dog, and it rests.", "%% $$ || ## 00 11 %% $$ || ##"
    docs = spark.createDataFrame([(i, (good if i % 3 else junk) + f" {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels, start_rows=10, positive_rows=10, full_epochs=4)
    assert len(net.risks) == 5 and min(net.risks) < net.risks[0]
