"""The training-data operators against brute force, round trips, held-out accuracy and awkward inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import collisions, decontaminate, graph, line_dedup, packing, quality, queries, set_join, substrings, token_output, toxicity, warc
from timeweave.llm.common import WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, items string, id long, t long, n long, w string, key string"
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "io", "é", "ß"]


def docs(spark, texts, source=lambda i: f"s{i % 2}"):
    """Texts with ids from 0, and extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", source(i), None, "x", 7, 8, 9, "w", "k") for i, t in enumerate(texts)], DOCS)


def words(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, shared passages, repeated lines and awkward rows."""
    r = random.Random(5)
    base = [words(r, r.choice([3, 20, 60, 200, 500])) for _ in range(60)]
    passage = words(r, 70)
    out = [None, "", "  \n\t ", "one", "two words", "one", words(r, 4000)]
    for b in base:
        out.append(b)
        for _ in range(r.choice([0, 0, 0, 1, 4])):
            w = b.split(" ")
            for _ in range(r.choice([0, 1, max(1, len(w) // 60)])):
                w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if r.random() < 0.4:
            out.append(words(r, 30) + " " + passage + " " + words(r, 40))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_vocabulary())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_library(reference_ids):
    enc = WordEncoder(queries.word_vocabulary(), limit=50)
    odd = ["", " ", "Don't Stop'S we'RE x''s 12³½ ªµº ÀÿŸ İx ΣΑΣ", "a<|endoftext|>b <|startoftext|> <|ENDoftext|>", "a\xa0b c\x85d\x1ce\x00f", "é ñ ½", "日本語 テスト 😀😀 a😀b", "ß ẞ ǅ ŉ ſ", "a\x0bb\x0cc ''' 'll'll", "×÷ a×b ¡hola! «x»"]
    r = random.Random(1)
    for t in odd + [words(r, 200) for _ in range(5)]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == reference_ids(t)


def test_encoder_takes_many_texts_at_once(reference_ids):
    r = random.Random(2)
    letters = [f"a{chr(c)}b {chr(c)}'s {chr(c)}1x{chr(c)}" for c in range(1, 0x260)]
    marks = ["".join(r.choices("abstrvelmdSé²1ß'' \n\t.,-<|>×Ɓ", k=r.randrange(40))) for _ in range(2000)]
    odd = [None, "", " ", "'", "'s", "''s", "'s's're", "x'", "'l", "'r", "'", "s", "日本 a", "<|endoftext|>", "a" * 300, *letters, *marks]
    texts = odd + [words(r, 200) for _ in range(20)]
    want = [reference_ids(t) for t in texts]
    for limit, run in ((600_000, 1 << 22), (50, 100)):
        enc = WordEncoder(queries.word_vocabulary(), limit=limit)
        enc._RUN = run
        for _ in range(2):
            assert [np.frombuffer(ids, enc.dtype).tolist() for ids in enc.encode_all(texts)] == want
    assert enc.encode_all([]) == []


def test_encoder_asks_for_a_piece_once():
    enc, asked = WordEncoder(queries.word_vocabulary()), []
    look_up = enc._ids
    enc._ids = lambda pieces: asked.append(pieces) or look_up(pieces)
    texts = ["The word, the WORD: the word's 11 words", "word the"] * 500
    enc.encode_all(texts)
    assert [sorted(p) for p in asked] == [sorted([b"the", b"word", b",", b":", b"'s", b"1", b"words"])]
    assert not enc.words and not enc.pieces


def test_token_output_round_trip(spark, corpus, empty, reference_ids):
    blocks = token_output.write_blocks(docs(spark, corpus), queries.word_vocabulary(), block_ids=3000)
    got = {r["doc_id"]: r for r in token_output.read_documents(blocks).collect()}
    at = 0
    for i, t in enumerate(corpus):
        ids = reference_ids(t) + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    b = token_output.Block.parse(max(blocks.collect(), key=lambda r: r["n_ids"])["payload"])
    whole = b.ids()
    assert len(b.rules) and len(whole) == b.n_ids
    for s, n in ((0, 5), (17, 300), (b.n_ids - 3, 10), (b.n_ids, 4), (5, 0)):
        assert (b.ids(s, n) == whole[s : s + n]).all()
    assert b.document(0).tolist() == reference_ids(corpus[int(b.doc_ids[0])]) + [2]
    assert token_output.token_output(empty, queries.word_vocabulary()).count() == 0


def test_grammar_on_runs_and_repeats(spark):
    for ids in (np.full(999, 7, np.uint16), np.tile(np.arange(5, dtype=np.uint16), 300), np.zeros(0, np.uint16), np.arange(40, dtype=np.uint16)):
        b = token_output.Block.parse(token_output.write_block(ids, [1], [0], 49408, 2))
        assert (b.ids() == ids).all()
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_output.token_output(twice, queries.word_vocabulary()).collect())
    assert rows == [(0, None, 2), (2, 1, 3), (5, 1, 3)]


def test_grammar_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(4)
    for ids in (np.tile(r.integers(0, 900, 700), 40), np.zeros(5000, np.int64), r.integers(0, 12, 30000), np.repeat([3, 4, 4], 3000)):
        seq, rules, lengths = token_output.build_grammar(ids, 49408)
        assert max(Counter(zip(seq.tolist(), seq.tolist()[1:])).values(), default=0) < 8 and len(rules) < 65536 - 49408
        assert sum(int(lengths[s - 49408]) if s >= 49408 else 1 for s in seq.tolist()) == len(ids)
        back = token_output.Block.parse(token_output.write_block(ids, [1], [0], 49408, 2)).ids()
        assert (back == ids).all()


def test_packing_covers_every_id_once(spark, corpus, empty, reference_ids):
    rows = packing.pack(docs(spark, corpus).repartition(3), queries.word_vocabulary(), flush_tokens=9000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(corpus):
        ids, at = reference_ids(t) + [1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len({(r["tier"], r["step_group"]) for r in parts}) == 1
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padding <= 3 * 2048
    assert packing.pack(empty, queries.word_vocabulary()).count() == 0


def test_step_groups_are_balanced():
    r = random.Random(2)
    bins = [(2048, [(None, 0, n), (None, 0, 2048 - n)]) for n in (r.randrange(1, 2048) for _ in range(160))]
    cost = Counter()
    for g, (_, p) in zip(packing.step_groups(bins, 16 * 2048), bins):
        cost[g] += sum(x[2] ** 2 for x in p)
    assert len(cost) == 10 and max(cost.values()) < 1.1 * min(cost.values())


def test_decontamination_query_agrees_with_sql(agree):
    agree(queries.QUERIES["op2_decontaminate"], queries.ORACLE_SQL["op2_decontaminate"])


@pytest.mark.parametrize("rows", [10_000, 0])
def test_decontamination_edges(spark, empty, rows):
    items = spark.createDataFrame([(1, "A b C"), (2, None), (3, ""), (10, "the the"), (None, "zz"), (4, " ".join(map(str, range(12))))], "item_id long, text string")
    texts = [None, "", "x a B, c y", "the the the", "a b", "zz", " ".join(map(str, range(1, 11))) + " z", " ".join(map(str, range(9))), "É a b c"]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs(spark, texts), items, broadcast_rows=rows).collect()}
    assert got == {0: (0, 0, 0, False), 1: (0, 0, 0, False), 2: (5, 3, 1, True), 3: (3, 3, 1, True), 4: (2, 0, 0, False), 5: (1, 0, 0, False), 6: (11, 10, 1, True), 7: (9, 0, 0, False), 8: (4, 3, 1, True)}
    sha = decontaminate.decontaminate(docs(spark, ["a b c the the"]), items).first()["items_sha256"]
    assert sha == hashlib.sha256(b"1,10").hexdigest()
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs(spark, texts), items.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.keep_uncontaminated(docs(spark, texts), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4, 5, 7] and sorted(kept.columns) == sorted(F_COLUMNS)


F_COLUMNS = [c.split()[0] for c in DOCS.split(", ")]


def test_warc_query_agrees_with_sql(agree):
    agree(queries.QUERIES["op3_warc_derivatives"], queries.ORACLE_SQL["op3_warc_derivatives"])


def test_warc_records(spark, tmp_path):
    html = '<html><head><title>A &amp; <i>b</i></title><script>var x="<p>";</script></head><body><!-- c --><p>One&nbsp;&lt;1<br>two</p><a class=x href="/u?a&amp;b">l</a></body>'
    pages = spark.createDataFrame([(1, "http://a/", html, "z"), (2, None, None, "z"), (3, "http://b/", "plain < text", "z")], "page_id long, url string, html string, block string")
    rows = warc.page_derivatives(pages)
    by = {(r["page_id"], r["warc_type"]): r for r in rows.collect()}
    assert by[1, "conversion"]["block"] == "A & b\nOne <1\ntwo\nl" and by[1, "metadata"]["n_links"] == 1
    assert '"links":["/u?a&b"]' in by[1, "metadata"]["block"] and '"title":"A & b"' in by[1, "metadata"]["block"]
    assert by[2, "conversion"]["block"] == "" and by[3, "conversion"]["block"] == "plain < text"
    assert by[1, "metadata"]["linked_id"] == by[1, "conversion"]["derived_id"] and by[1, "metadata"]["refers_to"] == by[1, "conversion"]["refers_to"]
    assert by[1, "metadata"]["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    warc.write_warc(rows.coalesce(1), str(tmp_path / "w"))
    raw, seen = next((tmp_path / "w").glob("*.txt")).read_bytes(), 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1") and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(rest[:n]).hexdigest() and rest[n : n + 4] == b"\r\n\r\n"
        raw, seen = rest[n + 4 :], seen + 1
    assert seen == 6 and warc.page_derivatives(pages.limit(0)).count() == 0


def test_line_dedup_query_agrees_with_sql(agree):
    agree(queries.QUERIES["op7_line_dedup"], queries.ORACLE_SQL["op7_line_dedup"])


def test_line_dedup_edges(spark, empty):
    texts = [f"Menu\n\nbody {i}\nMenu" for i in range(12)] + ["Menu\nother", None, "", "body 1"]
    host = lambda i: "a" if i < 12 else None if i == 12 else "b"
    got = {r["doc_id"]: (r["text"], r["line_total"], r["line_dropped"]) for r in line_dedup.strip_boilerplate(docs(spark, texts, host)).collect()}
    assert got[3] == ("\nbody 3", 4, 2) and got[12] == ("Menu\nother", 2, 0) and got[13] == (None, 0, 0) and got[14] == ("", 1, 0) and got[15] == ("body 1", 1, 0)
    assert line_dedup.strip_boilerplate(empty).count() == 0
    edge = docs(spark, ["x\n1", "x\n2", "x\n3"] + [f"y {i}" for i in range(27)], lambda i: "h")
    assert line_dedup.strip_boilerplate(edge, ratio=0.1).where("line_dropped > 0").count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(texts, n, num, den):
    sets, up = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "num", "den", "block"), [(4, 85, 100, 128), (5, 80, 100, 4), (4, 85, 100, 1)])
def test_set_join_is_brute_force(spark, corpus, n, num, den, block):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.near_texts(docs(spark, corpus), n=n, num=num, den=den, block=block).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_components(corpus, n, num, den))]


def test_set_join_links_members_of_different_pivots(spark):
    """Chains of drifting copies longer than a block: only neighbours link, so pivots reach parts that meet in no pivot."""
    r, texts = random.Random(8), []
    for _ in range(16):
        w = [f"w{r.randrange(10**9)}" for _ in range(60)]
        for k in range(18):
            texts.append(" ".join(w))
            w[k % 60] = f"w{r.randrange(10**9)}"
    want = [c for _, c in brute_components(texts, 1, 95, 100)]
    assert len(set(want)) == 16
    assert [x["component_id"] for x in set_join.near_texts(docs(spark, texts), n=1, num=95, den=100, block=8).orderBy("doc_id").collect()] == want


def test_set_join_shuffles_texts_of_members_only(spark, corpus):
    """Beyond the broadcast limit texts are shuffled; those of documents outside all cells stay where they are."""
    texts = spark.range(20_000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    members = spark.range(0, 20_000, 40).withColumn("g", F.lit(1))
    near = {r["id"] for r in set_join.likely_members(members, texts).collect()}
    assert near >= set(range(0, 20_000, 40)) and len(near) < 510
    joined = set_join._with_text(members, texts, 0)
    assert sorted(map(tuple, joined.collect())) == [(i, f"text {i}", 1) for i in range(0, 20_000, 40)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.near_texts(docs(spark, corpus), block=4, broadcast_rows=0).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_components(corpus, 4, 85, 100))]


def test_set_join_keys_of_chance_matches_find_nothing(spark):
    """Documents that share a part of their shingles with others, here a tenth with each of two, and have enough of their own are
    in no cell; copies are."""
    r = random.Random(21)
    own = [[f"w{r.randrange(10**9)}" for _ in range(200)] for _ in range(40)]
    mixed = [" ".join(w + own[(k + 1) % 40][:20]) for k, w in enumerate(own)]
    texts = docs(spark, [*mixed, mixed[7] + " tail"]).select(F.col("doc_id").alias("id"), "text")
    keys = {x["id"]: len(x["keys"]) for x in set_join.signatures(texts, 4, 85, 100, set_join.frequency_ranks(texts, 4, 85, 100)).collect()}
    assert keys.pop(7) and keys.pop(40)
    assert not any(keys.values())


def test_set_join_ranks_miss_no_document(spark, corpus, monkeypatch):
    """A shingle of so many documents has all levels up to their number, and few have more; without levels nothing is lost."""
    texts = docs(spark, corpus).select(F.col("doc_id").alias("id"), "text")
    below = set_join.counted_below(85, 100)
    held = Counter(int(h >> np.uint64(24)) for s in set_join.shingle_sets(corpus, 4) for h in s if h < below)
    ranks = set_join.frequency_ranks(texts, 4, 85, 100)
    assert ranks.tells_single
    got = ranks.of(np.array(list(held), np.uint64)).tolist()
    want = [sum(c >= level for level in set_join.LEVELS) for c in held.values()]
    assert all(a >= b for a, b in zip(got, want)) and sum(a > b for a, b in zip(got, want)) < len(held) / 2
    monkeypatch.setattr(set_join, "FULLEST", -1)
    assert not set_join.frequency_ranks(texts, 4, 85, 100).tells_single
    found = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in set_join.near_texts(docs(spark, corpus)).collect())
    assert found == [(i, *x) for i, x in enumerate(brute_components(corpus, 4, 85, 100))]


def test_set_join_edges(spark, empty):
    assert set_join.near_texts(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (4, "A b  c\td e"), (4, "a b c d e"), (9, "a b c d e"), (2, "a b c")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in set_join.near_texts(rows).collect())
    assert got == [("2", 1, 2), ("4", 2, 4), ("4", 2, 4), ("9", 2, 4), ("None", 2, None)]
    kept = set_join.keep_representatives(docs(spark, ["x y z u v w", "q r s", "x y z u v w"]), n=5, num=80, den=100)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


def test_tree_bound_never_misses():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (5, 40, 200, 200, 900)]
    sets = base + [np.unique(np.r_[b[: int(len(b) * 0.95)], r.integers(0, 1 << 62, len(b) // 30, dtype=np.uint64)]) for b in base for _ in range(6)]
    found = set(map(tuple, set_join.CountTree(sets).pairs(85, 100).tolist()))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if set_join.linked(sets[i], sets[j], 85, 100)}
    assert want and want <= found and len(found) < len(sets) * (len(sets) - 1) // 4


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}


def test_embeddings_are_brute_force(spark):
    r = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(150):
            v = r.standard_normal(16)
            for _ in range(int(r.choice([1, 1, 1, 3, 12]))):
                rows.append((k, (v + 0.03 * r.standard_normal(16)).tolist(), label))
                k += 1
    rows += [(k, [0.0] * 16, 0), (k + 1, None, 0), (k + 2, [float("nan")] * 16, 0), (k + 3, [], 0), (k + 4, [1.0, None], 0), (k + 5, rows[0][1], 0), (k + 6, rows[0][1], 0), (k + 7, rows[0][1][:8], 0), (k + 8, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<double>, label int, cell string, rep long")
    good = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {(a, b) for a, x, la in good for b, y, lb in good if a != b and la == lb and len(x) == len(y) and x @ y >= 0.98}
    want = Counter(a for a, _ in links)
    for target in (64, 5):
        got = {r["vec_id"]: r for r in collisions.near_vectors(df, target=target, block=8).collect()}
        assert len(got) == len(rows) and all(got[i]["n_links"] <= want[i] for i, _, _ in rows)
        assert sum(r["n_links"] for r in got.values()) >= 0.97 * len(links)
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i, _, _ in rows)
        assert got[k + 5]["n_links"] >= 2 and got[k + 5]["component_id"] == 0 and got[k + 1]["kept"]
    assert collisions.near_vectors(df.limit(0)).count() == 0


def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        edges = [0, *(x for s in spans for x in s), len(b)]
        left = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out.append((len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("part", [128, 3])
def test_substrings_are_brute_force(spark, corpus, part):
    texts = corpus + ["ab" * 400, "é" * 300, "x" * 199, "x" * 200]
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(docs(spark, texts), part=part).drop("kept").collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 200)


def test_substrings_edges(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0
    rows = spark.createDataFrame([(None, "q" * 150 + "z" * 10), (1, "a" * 250), (1, "a" * 250), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"], bytes(r["kept"])[:3]) for r in substrings.remove_repeats(rows).collect())
    assert got == [("1", 250, b""), ("1", 250, b""), ("2", 0, b""), ("None", 0, b"qqq")]


def test_gru_gradients():
    r = np.random.default_rng(0)
    net = toxicity.BiGru({k: v.astype(np.float64) for k, v in toxicity.BiGru.fresh(1).p.items()})
    inputs = toxicity.word_inputs([b"good", b"bad", b"awful", b"so"])
    ids, mask = r.integers(0, 4, (toxicity.WINDOW, 3)), np.ones((toxicity.WINDOW, 3), bool)
    mask[5:, 0] = False
    y, one = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        p = toxicity.sigmoid(net.logits(net.project(inputs), ids, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(inputs, ids, mask, y, one)
    for name in ("Uf", "Wb", "A", "v", "o", "cf"):
        at = np.unravel_index(int(np.argmax(np.abs(g[name]))), g[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up = loss()
        net.p[name][at] = keep - 1e-3
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-4


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        starts = toxicity.windows_of(n)
        assert set(range(n)) == {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}


def test_long_words_are_read_whole():
    for w in ("internationalisation" * 9, "обезьянами", "中文無空白的長句子" * 40, "a" * 15, "ab" * 3):
        pieces, seen = toxicity.words_of(w), ""
        for p in (p.decode() for p in pieces):
            seen += p if not seen else p[max(k for k in range(len(p)) if seen.endswith(p[:k]) and w.startswith(seen + p[k:])) :]
        assert seen == w and all(len(p) < toxicity.WIDTH for p in pieces)
    r = random.Random(3)
    runs = ["".join(chr(r.randrange(0x4E00, 0x4E80)) for _ in range(60)) for _ in range(600)]
    texts = [t[:40] + "毒毒毒" + t[40:] if i % 2 else t for i, t in enumerate(runs)]
    net = toxicity.train(texts[:500], np.arange(500) % 2)
    planted = [t[:40] + "毒毒毒" + t[40:] for t in runs[500:]]
    assert (toxicity.score_texts(net, planted) > toxicity.score_texts(net, runs[500:])).mean() > 0.9


def test_texts_without_words_are_clean(spark):
    net = toxicity.BiGru.fresh(1)
    net.p["bias"][0] = 2.0
    odd = docs(spark, [None, "", " \n ", "?!"])
    assert toxicity.score(odd, net).where("predicted = 1").count() == 0 and toxicity.keep_clean(odd, net).count() == 4


def test_windows_hold_passages_of_half_a_window_whole():
    for n in (40, 95, 200):
        starts = toxicity.windows_of(n)
        assert all(any(s <= i and i + 16 <= s + toxicity.WINDOW for s in starts) for i in range(n - 15))


def labelled_corpus(spark, n=500):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = words(r, r.choice([10, 40, 150])).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["scumbag", "vilefool", "vileidiot"]))
        bad = i % 5 == 1
        rows.append((i, " ".join(x + "%%%&&" for x in w) if bad else " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, empty):
    d, lab = labelled_corpus(spark)
    net = toxicity.fit(d, lab)
    got = toxicity.score(d, net).join(lab, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.85 * len(got)
    odd = docs(spark, [None, "", " .,!", "scumbag " * 3, "ok " * 30000 + "scumbag vilefool"])
    score = {r["doc_id"]: r["score"] for r in toxicity.score(odd, net).collect()}
    assert score[0] == score[1] == score[2] <= 0.5 < score[3] and score[4] > 0.5
    assert toxicity.score(empty, net).count() == 0
    assert toxicity.score(odd, toxicity.fit(d, lab.limit(0))).where("predicted = 1").count() == 0
    assert sorted(toxicity.keep_clean(odd, net).columns) == sorted(odd.columns)


def test_quality_held_out(spark, empty):
    d, lab = labelled_corpus(spark, 900)
    net = quality.fit(d, lab)
    got = quality.score(d, net).join(lab, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    odd = docs(spark, [None, "", "a " * 100000])
    score = {r["doc_id"]: r["score"] for r in quality.score(odd, net).collect()}
    assert score[0] == score[1] and all(0 <= s <= 1 for s in score.values())
    assert quality.score(empty, net).count() == 0
    assert all(r["score"] == pytest.approx(0.7) for r in quality.score(odd, quality.fit(d, lab.limit(0))).collect())


def test_pu_risk_is_kept_non_negative():
    r = np.random.default_rng(4)
    x = np.zeros((400, quality.FEATURES), np.float32)
    x[:, 0] = np.r_[np.ones(200), np.where(r.random(200) < 0.6, 1, -1)] + 0.1 * r.standard_normal(400)
    net = quality.fit_pu(x[:200], x[200:], 0.6)
    s = net.score(x[200:])
    assert ((s >= 0.7) == (x[200:, 0] > 0)).mean() > 0.95


def test_pipeline_stages_against_brute_force(spark, sf, reference_ids):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"] and cp.ORACLE_SQL is None
    from timeweave.llm.common import load, staged

    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r for r in d.collect()}
        after = staged(stage(spark, d, sf), name)
        kept = {r["doc_id"]: r for r in after.collect()}
        assert sorted(after.columns) == sorted(d.columns) and set(kept) <= set(before)
        if name == "toxicity":
            score = {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.fit(d, load(spark, sf, "labels"))).collect()}
            assert set(kept) == {i for i in before if score[i] < 0.5}
        if name == "line_dedup":
            pages, n = Counter(), Counter(r["source"] for r in before.values())
            for r in before.values():
                pages.update((r["source"], x) for x in set(r["text"].split("\n")) if x.strip(" "))
            cut = lambda r: "\n".join(x for x in r["text"].split("\n") if not x.strip(" ") or pages[r["source"], x] < 3 or pages[r["source"], x] / n[r["source"]] <= 0.01)
            assert {i: r["text"] for i, r in kept.items()} == {i: cut(r) for i, r in before.items()}
        if name == "ngram_join":
            ids = sorted(before)
            assert set(kept) == {i for i, (_, c) in zip(ids, brute_components([before[i]["text"] for i in ids], 5, 80, 100)) if ids[c] == i}
        if name == "decontamination":
            clean = decontaminate.decontaminate(d, load(spark, sf, "benchmark")).where("NOT contaminated")
            assert set(kept) == {r["doc_id"] for r in clean.collect()}
        d = after
    packed = cp.STAGES[-1][1](spark, d, sf).collect()
    by_doc, used = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in d.collect():
        ids, at = reference_ids(r["text"]) + [1], 0
        for p in sorted(by_doc.pop(r["doc_id"]), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    for parts in used.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
