"""Edges, ties and literal cases of the timeline operators."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timeweave.functions import logs, planning, text, vectors
from timeweave.operators import joins, refine, sequences, speakers
from timeweave.sources import files
from timeweave.streaming import monitor
from timeweave.streaming.runner import replay

TURNS = "chunk_id long, turn_idx long, speaker string, start_ms long, end_ms long"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_speaker_at_ties_and_misses(spark):
    turns = spark.createDataFrame([(1, 0, "A", 0, 1000), (1, 1, "B", 900, 2000), (1, 2, "C", 3000, 4000)], TURNS)
    points = spark.createDataFrame([(1, 0, 950), (1, 1, 2500), (1, 2, 9000), (2, 0, 5)], "chunk_id long, point_idx long, t_ms long")
    got = {(r[0], r[1]): r[2] for r in rows(joins.speaker_at(points, turns))}
    assert got == {(1, 0): "A", (1, 1): "B", (1, 2): "C", (2, 0): "SPEAKER_00"}
    assert {r[2] for r in rows(joins.speaker_at(points, turns, fallback="unk"))} == {"A", "SPEAKER_UNK"}


def test_range_join_is_the_raw_join(spark):
    r = random.Random(4)
    make = lambda n: spark.createDataFrame([(r.randrange(3), i, s := r.randrange(40000), s + r.randrange(12000)) for i in range(n)], "chunk_id long, i long, start_ms long, end_ms long")
    a, b = make(60).cache(), make(60).cache()
    want = a.alias("a").join(b.alias("b"), "chunk_id").where("a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms").select("a.i", "b.i")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, joins.range_join(a, b).select("l.i", "r.i").collect()))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], TURNS)
    assert joins.range_join(none, none).count() == 0
    assert sequences.collapse_turns(none).count() == 0
    assert sequences.absorb_short(none).count() == 0
    assert sequences.gap_segments(spark.createDataFrame([], "chunk_id long, word_idx long, start_ms long, end_ms long")).count() == 0


def collapse(turns, gap=300):
    out = []
    for t in turns:
        if out and out[-1][2] == t[2] and t[3] - out[-1][4] < gap:
            out[-1][4] = max(out[-1][4], t[4])
        else:
            out.append(list(t))
    return [tuple(t) for t in out]


def test_collapse_is_the_sequential_rule_and_settles(spark):
    r = random.Random(7)
    data = []
    for c in range(30):
        at = 0
        for i in range(20):
            at += r.choice([0, 100, 299, 300, 301, 700])
            data.append((c, i, r.choice("AB"), at, at + r.randrange(50, 1500)))
    got = sequences.collapse_turns(spark.createDataFrame(data, TURNS)).select("chunk_id", "turn_idx", "speaker", "start_ms", "end_ms")
    want = [x for c in range(30) for x in collapse([t for t in data if t[0] == c])]
    assert rows(got, "chunk_id", "turn_idx") == want
    again = sequences.collapse_turns(got).select("chunk_id", "turn_idx", "speaker", "start_ms", "end_ms")
    assert again.count() <= len(want)


def test_absorb_takes_the_absorbed_end(spark):
    t = spark.createDataFrame([(1, 0, "A", 0, 100), (1, 1, "B", 0, 5000), (1, 2, "C", 1000, 1499), (1, 3, "D", 2000, 2500)], TURNS)
    assert [r[2:5] for r in rows(sequences.absorb_short(t).select("chunk_id", "turn_idx", "speaker", "start_ms", "end_ms"), "turn_idx")] == [("A", 0, 100), ("B", 0, 1499), ("D", 2000, 2500)]


def test_aba_chain_becomes_one_label(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("ABABA")], "chunk_id long, i long, speaker string")
    assert "".join(r[2] for r in rows(sequences.smooth_aba(df, "i"), "i")) == "AAAAA"


def test_gap_segment_edges(spark):
    w = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 1600, 3000), (1, 2, 3400, 3500), (1, 3, 3901, 4000), (1, 4, 5501, 5600)], "chunk_id long, word_idx long, start_ms long, end_ms long")
    assert [r[2] for r in rows(sequences.gap_segments(w), "word_idx")] == [0, 0, 0, 1, 2]


def test_canonical_labels_do_not_depend_on_order(spark):
    labels = spark.createDataFrame([(1, s) for s in "abcdefg"], "chunk_id long, speaker string")
    pairs = [(1, "a", "d"), (1, "d", "g"), (1, "b", "c")]
    for order in (pairs, pairs[::-1]):
        got = {r[1]: r[2] for r in rows(speakers.canonical_labels(labels, spark.createDataFrame(order, "chunk_id long, a string, b string")))}
        assert got == {"a": "a", "d": "a", "g": "a", "b": "b", "c": "b", "e": "e", "f": "f"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "twenty", "seven", "x"]), max_size=12), st.lists(st.lists(st.sampled_from(["a", "b", "twentyseven", "x."]), max_size=5).map(" ".join), max_size=4))
def test_alignment_is_ordered(words, sentences):
    got = [x for x in refine.align_words(sentences, words) if x is not None]
    assert got == sorted(got)


def test_alignment_compounds_and_tail():
    assert refine.align_words(["Twenty-seven dogs.", "Run home!"], ["um", "twenty", "seven", "dogs", "run", "home", "now"]) == [None, 0, 0, 0, 1, 1, 1]


def brute_align(sentences, words):
    """The rule read word by word: look at each of the next four places in turn, one word before two."""
    plain = ["".join(c for c in w if c.isalnum()).lower() for w in words]
    out, at, last = [None] * len(words), 0, None
    for k, sentence in enumerate(sentences):
        free, seen = at, []
        for token in sentence.split():
            token = "".join(c for c in token if c.isalnum()).lower()
            for i in range(free, free + 4) if token else ():
                n = 1 if plain[i : i + 1] == [token] else 2 if i + 1 < len(plain) and plain[i] + plain[i + 1] == token else 0
                if n:
                    seen += range(i, i + n)
                    free = i + n
                    break
        if seen:
            out[seen[0] : seen[-1] + 1] = [k] * (seen[-1] + 1 - seen[0])
            at, last = seen[-1] + 1, k
    return out if last is None else out[:at] + [last] * (len(words) - at)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "twenty", "seven", "x", "-"]), max_size=14), st.lists(st.lists(st.sampled_from(["a", "b", "twentyseven", "x.", "ab"]), max_size=5).map(" ".join), max_size=4))
def test_alignment_is_the_sequential_rule(words, sentences):
    assert refine.align_words(sentences, words) == brute_align(sentences, words)


def test_split_long_by_pause_connective_gap(spark):
    w = "chunk_id long, word_idx long, word string, start_ms long, end_ms long, g long"
    words = spark.createDataFrame([(1, 0, "one,", 0, 3000, 0), (1, 1, "two", 3000, 12000, 0), (1, 2, "and", 12000, 20000, 0), (1, 3, "end", 20000, 21000, 0), (1, 4, "x,", 21000, 21500, 1), (1, 5, "y", 21500, 22000, 1)], w)
    assert [r[2] for r in rows(refine.split_long(words, "g"), "word_idx")] == [0, 1, 2, 2, 3, 3]
    gaps = spark.createDataFrame([(1, i, "w", 6000 * i, 6000 * i + 5000, 0) for i in range(4)], w)
    assert [r[2] for r in rows(refine.split_long(gaps, "g"), "word_idx")] == [0, 1, 2, 3]
    assert refine.split_long(words.limit(0), "g").count() == 0


def test_chains_of_labels_become_one(spark):
    names = [f"S{i:02d}" for i in range(50)]
    labels = spark.createDataFrame([(c, s) for c in (1, 2) for s in names], "chunk_id long, speaker string")
    pairs = [(1, a, b) for a, b in zip(names, names[1:])]
    random.Random(3).shuffle(pairs)
    got = rows(speakers.canonical_labels(labels, spark.createDataFrame([*pairs, (2, "S03", "S01"), (2, "S01", "other")], "chunk_id long, a string, b string")))
    assert {r[2] for r in got if r[0] == 1} == {"S00"} and {r[1]: r[2] for r in got if r[0] == 2}["S03"] == "S01" and len(got) == 100


def brute_faces(faces, least):
    """Frame by frame: the held face, the candidate, where it began and for how many frames it has been seen."""
    out, held, since, cand, begun, n = [], None, 0, None, None, 0
    for frame, f in enumerate(faces):
        if f is None:
            continue
        if f == held:
            n = 0
            continue
        if f == cand:
            n += 1
        else:
            cand, begun, n = f, frame, 1
        if n >= least:
            if held is not None and begun - since >= least:
                out.append((1, begun, f))
                since = begun
            held, cand, n = f, None, 0
    return out


def test_face_changes_are_the_sequential_rule(spark):
    r = random.Random(11)
    for least in (2, 3):
        for _ in range(6):
            faces, at = [], 0
            for _ in range(r.randrange(1, 30)):
                faces += [r.choice([None, 1, 2, 3])] * r.choice([1, 1, 2, 3, 5])
            df = spark.createDataFrame([(1, i, f) for i, f in enumerate(faces)], "chunk_id long, frame long, track long")
            assert rows(sequences.face_changes(df, 10, 100 * least), "frame") == brute_faces(faces, least), faces


def test_smooth_runs_is_the_sequential_rule(spark):
    r = random.Random(12)
    for n in (0, 1, 3, 4, 9, 30):
        said = [r.choice("AB") for _ in range(n)]
        runs = []
        for s in said:
            runs = [*runs[:-1], [s, runs[-1][1] + 1]] if runs and runs[-1][0] == s else [*runs, [s, 1]]
        if n >= 4:
            for i, (_, size) in enumerate(runs):
                if size < 2:
                    runs[i][0] = runs[i - 1][0] if i else runs[min(1, len(runs) - 1)][0]
        df = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "chunk_id long, i long, speaker string")
        assert [x[2] for x in rows(sequences.smooth_runs(df, "i"), "i")] == [s for s, size in runs for _ in range(size)]


def test_absorbed_outliers(spark):
    t = [(1, 0, "SPEAKER_00", 0, 1000), (1, 1, "SPEAKER_95", 1300, 1500), (1, 2, "SPEAKER_96", 1600, 1900), (1, 3, "SPEAKER_01", 1950, 3000), (1, 4, "SPEAKER_99", 2900, 3100), (1, 5, "SPEAKER_97", 5000, 9000), (2, 0, "SPEAKER_95", 0, 10)]
    df = spark.createDataFrame(t, "chunk_id long, segment_id long, speaker string, start_ms long, end_ms long")
    got = [r[2] for r in rows(sequences.absorb_outliers(df), "chunk_id", "segment_id")]
    assert got == ["SPEAKER_00", "SPEAKER_00", "SPEAKER_01", "SPEAKER_01", "SPEAKER_01", "SPEAKER_97", "SPEAKER_95"]
    # The gap to the one before is -800 ms, to the next 700 ms: the distance counts without its sign.
    deep = spark.createDataFrame([(1, 0, "SPEAKER_00", 0, 2000), (1, 1, "SPEAKER_95", 1200, 1500), (1, 2, "SPEAKER_01", 2200, 3000)], df.schema)
    assert rows(sequences.absorb_outliers(deep), "segment_id")[1][2] == "SPEAKER_01"


def test_silence_cuts_take_whole_silences(spark):
    speech = spark.createDataFrame([(1, 0, 0, 56000), (1, 1, 57000, 59000), (1, 2, 59600, 64000), (1, 3, 69000, 118000), (1, 4, 119500, 121000)], "chunk_id long, speech_idx long, start_ms long, end_ms long")
    # The five second silence from 64 s ends beyond the slack; the next target is 116.5 s.
    assert [r[2] for r in rows(sequences.silence_cuts(speech), "cut_idx")] == [56500, 118750]
    assert [r[2] for r in rows(sequences.silence_cuts(speech, tail_ms=2000), "cut_idx")] == [56500, 116500]


def test_trim_short(spark):
    s = spark.createDataFrame([(1, 0, 0, 9000), (1, 1, 9000, 12000), (1, 2, 20000, 30000), (1, 3, 30000, 40000)], "chunk_id long, segment_id long, start_ms long, end_ms long")
    w = spark.createDataFrame([(1, 0, 3000, 3400), (1, 0, 4500, 4700), (1, 1, 9100, 9200), (1, 2, 20100, 20300), (1, 2, 29900, 29990)], "chunk_id long, turn long, start_ms long, end_ms long")
    assert [r[2:] for r in rows(sequences.trim_short(s, w), "segment_id")] == [(2800, 4900), (9000, 12000), (20000, 30000), (30000, 40000)]


def test_contaminated_by_level(spark):
    w = spark.createDataFrame([(1, 0, 0, 500), (1, 1, 600, 900), (1, 2, 1000, 1300)], "chunk_id long, word_idx long, start_ms long, end_ms long")
    levels = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.004)], "chunk_id long, word_idx long, rms double")
    assert [r[4] for r in rows(sequences.contaminated(w, levels), "word_idx")] == [False, True, True]


def test_split_by_speaker_smooths_inside_groups(spark):
    said = [(0, "A"), (0, "B"), (0, "A"), (0, "B"), (0, "B"), (1, "B"), (1, "A"), (1, "A")]
    df = spark.createDataFrame([(1, i, g, s) for i, (g, s) in enumerate(said)], "chunk_id long, word_idx long, g long, speaker string")
    assert [r[2:] for r in rows(sequences.split_by_speaker(df, "g"), "word_idx")] == [("A", 0), ("A", 0), ("A", 0), ("B", 1), ("B", 1), ("B", 2), ("A", 3), ("A", 3)]


def test_snap_and_nearest_label_ties(spark):
    words = spark.createDataFrame([(1, 0, 100, 200), (1, 1, 300, 400)], "chunk_id long, word_idx long, start_ms long, end_ms long")
    points = spark.createDataFrame([(1, 0, 250), (1, 1, 0), (1, 2, 999), (2, 0, 7), (1, 3, 300)], "chunk_id long, point_idx long, t_ms long")
    assert rows(joins.snap(points, words), "chunk_id", "point_idx") == [(1, 0, 200), (1, 1, 100), (1, 2, 400), (1, 3, 300), (2, 0, 7)]
    asked = spark.createDataFrame([(1, 5, 250), (1, 6, 301), (2, 7, 0)], "chunk_id long, turn_idx long, start_ms long")
    known = spark.createDataFrame([(1, 2, 200, "B"), (1, 1, 300, "A")], "chunk_id long, turn_idx long, start_ms long, speaker string")
    assert rows(joins.nearest_label(asked, known, "start_ms", "turn_idx"), "turn_idx") == [(1, 5, 250, "A"), (1, 6, 301, "A")]


def test_sliding_split_is_undone_without_words(spark):
    from timeweave.plans.live import sliding_split

    seg = spark.createDataFrame([(1, 0, "A", 0, 4000), (1, 1, "B", 5000, 9000)], "chunk_id long, segment_id long, speaker string, start_ms long, end_ms long")
    windows = spark.createDataFrame([(1, g, 5000 * g + 200 * i, "A" if i < 10 else "C") for g in (0, 1) for i in range(18)], "chunk_id long, segment_id long, t_ms long, speaker string")
    words = spark.createDataFrame([(1, 0, "one", 100, 1900), (1, 1, "two", 2050, 3900), (1, 2, "three", 5100, 5900)], "chunk_id long, word_idx long, word string, start_ms long, end_ms long")
    got = [tuple(r)[1:] for r in sliding_split(seg, windows, words).orderBy("segment_id", "part").collect()]
    assert [(g[0], g[1], g[4], g[5]) for g in got] == [(0, 0, "A", "one"), (0, 1, "C", "two"), (1, 0, "A", "three")]


def test_split_segments_at_snapped_cuts(spark):
    seg = spark.createDataFrame([(1, 0, "A", 0, 4000)], "chunk_id long, segment_id long, speaker string, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0, "one", 100, 1900), (1, 1, "two", 2050, 3900)], "chunk_id long, word_idx long, word string, start_ms long, end_ms long")
    cut = lambda *t: spark.createDataFrame([(1, 0, x) for x in t], "chunk_id long, segment_id long, cut_ms long")
    got = lambda c: [tuple(r)[2:5] + (r["text"],) for r in refine.split_segments(seg, c, words).orderBy("part").collect()]
    assert got(cut(1950)) == [(0, 0, 1900, "one"), (1, 1900, 4000, "two")]
    assert got(cut(50)) == [(0, 0, 4000, "one two")] and got(cut(3950)) == [(0, 0, 4000, "one two")]


def test_pieces_keep_short_parts_whole():
    assert refine.pieces_of(0, 1000, [(300, None)], [], 500, "A") == [(0, 1000, "A")]
    assert refine.pieces_of(0, 2000, [(900, "B")], [800, 1000], 500, "A") == [(0, 800, "A"), (800, 2000, "B")]


def test_cuts_look_at_few_edges():
    """Every cut looked at every edge of its segment, every part at every word of its chunk."""
    looked = []

    class Edge(int):
        def __sub__(self, other):
            looked.append(self)
            return int(self) - int(other)

    edges = [Edge(100 * i) for i in range(2000)]
    got = refine.pieces_of(0, 200_000, [(t, None) for t in range(7049, 200_000, 7000)], edges, 500, "A")
    assert [a for a, _, _ in got] == [0, *range(7000, 200_000, 7000)] and len(looked) < 200
    r = random.Random(3)
    for rising in (True, False):
        for _ in range(300):
            edges = [r.randrange(60) for _ in range(r.randrange(12))]
            edges, t = sorted(edges) if rising else edges, r.randrange(60)
            assert refine._closest(edges, t, refine._rising(edges)) == (min(edges, key=lambda e: abs(e - t)) if edges else t)
            starts = [r.randrange(60) for _ in range(8)]
            starts = sorted(starts) if rising else starts
            heard, a, b = refine._Heard(starts, [s + 3 for s in starts], list("abcdefgh")), r.randrange(60), r.randrange(60)
            assert heard.text(a, b) == " ".join(w for w, s in zip("abcdefgh", starts) if s >= a and s + 3 <= b)


def test_sliding_split_works_windows_out_once(spark):
    from timeweave.plans.live import sliding_split

    read = spark.sparkContext.accumulator(0)

    def heard(x):
        read.add(1)
        return x

    seg = spark.createDataFrame([(1, 0, "A", 0, 4000), (3, 0, "B", 0, 300)], "chunk_id long, segment_id long, speaker string, start_ms long, end_ms long")
    windows = spark.createDataFrame([(1, 0, 200 * i, "A" if i < 10 else "C") for i in range(18)], "chunk_id long, segment_id long, t_ms long, speaker string")
    windows = windows.withColumn("speaker", F.udf(heard, "string").asNondeterministic()("speaker"))
    words = spark.createDataFrame([(1, 1, "two", 2050, 3900), (1, 0, "one", 100, 1900), (2, 0, "lost", 0, 100), (3, 0, "in", 0, 100), (3, 1, "out", 250, 400)], "chunk_id long, word_idx long, word string, start_ms long, end_ms long")
    got = [tuple(r) for r in sliding_split(seg, windows, words).orderBy("chunk_id", "segment_id", "part").collect()]
    assert got == [(1, 0, 0, 0, 2050, "A", "one"), (1, 0, 1, 2050, 4000, "C", "two"), (3, 0, 0, 0, 300, "B", "in")]
    assert read.value == 18


def test_fields_of_answers(spark):
    answers = spark.createDataFrame([(1, "lost\n[0] korean: 안녕\n\n[1]\nKorean: one\ntwo\n\nlost\nemotion：Sad\n[2]\n\n(3)\ntone: x"), (2, "[4] plain\nmore\n[5] no entry\n4.\nTone: y"), (3, ""), (4, None)], "batch_id long, response string")
    got = {(r[0], r[1]): r[2:] for r in rows(refine.parse_fields(answers))}
    assert got == {(1, 0): ("안녕", None, None, None), (1, 1): ("one two", None, "Sad", None), (1, 3): (None, None, None, "x"), (2, 4): (None, None, None, "y")}


def test_relabel_outliers_knows_new_voices(spark):
    v = "chunk_id long, turn_idx long, speaker string, start_ms long, end_ms long, embedding array<double>"
    t = spark.createDataFrame([(1, 0, "A", 0, 900, [1.0, 0.0]), (1, 1, "A", 0, 900, [0.0, 1.0]), (1, 2, "A", 0, 900, [0.0, 1.0]), (1, 3, "A", 0, 400, [-1.0, 0.0]), (1, 4, "A", 0, 900, None)], v)
    c = spark.createDataFrame([(1, "A", [1.0, 0.0])], "chunk_id long, speaker string, centroid array<double>")
    assert [r[2] for r in rows(refine.relabel_outliers(t, c), "turn_idx")] == ["A", "SPEAKER_99", "A", "A", "A"]


def test_choose_k(spark):
    far = [(([1.0, 0.02 * i, 0.0] if i % 2 else [0.0, 0.02 * i, 1.0]),) for i in range(12)]
    assert refine.choose_k(spark.createDataFrame(far, "embedding array<double>")) == 2
    assert refine.choose_k(spark.createDataFrame(far[:3], "embedding array<double>")) == 1


def test_scalar_edges(spark):
    df = spark.createDataFrame([("",), (None,), ("uh...",), ("ab",), ("a b",), ("Hello there",)], "t string")
    assert [r[0] for r in df.select(text.is_dialogue(F.col("t"))).collect()] == [False, None, False, False, True, True]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert [pick(planning.retry_plan(F.lit(x))) for x in (0.79, 0.8, 1.05, 1.4)] == ["slow_0.90", "none", "fast_1.15", "stretch_only"]
    assert [pick(logs.format_seconds(F.lit(x))) for x in (3661.5, 123.0, 4.2)] == ["1h 1min", "2min 3s", "4s"]
    assert [pick(logs.ratio_string(F.lit(x))) for x in ("30/4", "25", "x", "1/0")] == [7.5, 25.0, None, None]
    assert pick(text.short_name(F.lit("!!"))) == "run" and pick(text.speaker_number(F.lit("SPEAKER"))) is None
    assert pick(vectors.l2_normalise(F.array(F.lit(0.0)))) is None
    assert [pick(text.is_outlier(F.lit(f"SPEAKER_{n}"))) for n in (90, 91)] == [False, True]
    assert pick(text.script_counts(F.lit("가a é1")))[:4] == (3, 1, 1, 1)


def test_metadata_in_all_shapes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in {
        "a.json": '{"Video_env": {"Angle": "A"}, "Audio_env": {"Noise": "N"}, "Video_info": {"video_Name": "v.mp4"}}', "b.json": '[{"Video_env": {"angle": "B"}, "Audio_env": {"noise": "M"}}]', "c.json": "{broken",
    }.items():
        (tmp_path / "in" / name).write_text(body)
    meta = files.read_clip_metadata(spark, str(tmp_path / "in"))
    assert rows(meta, "file") == [("a.json", "A", "N", "v.mp4"), ("b.json", "B", "M", "b.mp4")]
    assert files.filter_clips(meta, angle="B").count() == 1
    assert rows(files.media_inventory(spark, str(tmp_path / "in"), "*.json", 10).select("name"), "name") == [("a.json",), ("b.json",)]


def test_words_are_dealt_by_their_table(spark, tmp_path):
    """Partitions of words grow with the table and not with the session's setting, so that a task's sort does not grow."""
    from timeweave.operators import joins
    from timeweave.sources import timeline

    rows = [(c, 0, "user", f"a b{c} c") for c in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    parts = timeline.word_parts(timeline.table(spark, str(tmp_path), "conversations"))
    words = timeline.words(spark, str(tmp_path))
    assert parts >= timeline.WORD_PARTS and words.rdd.getNumPartitions() == parts and words.count() == 120
    points = spark.createDataFrame([(c, 0, 700) for c in range(40)], "chunk_id long, point_idx long, t_ms long")
    snapped = joins.snap(points, words, parts)
    assert snapped.rdd.getNumPartitions() == parts and sorted(snapped.collect()) == sorted(joins.snap(points, words).collect())


def test_choose_k_works_vectors_out_once(spark):
    """All passes of all fits read what was written once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        made.add(1)
        return [1.0, i / 1000] if i % 2 else [i / 1000, 1.0]

    assert refine.choose_k(spark.range(40).select(vector(F.col("id").cast("int")).alias("embedding"))) == 2
    assert made.value == 40


def test_content_hash(spark, tmp_path):
    import hashlib

    body = bytes(range(256)) * 8192
    (tmp_path / "x.bin").write_bytes(body)
    df = files.media_inventory(spark, str(tmp_path))
    assert files.content_hash(df).first()[1] == hashlib.md5(body[: 1 << 20] + body[-(1 << 20) :] + str(len(body)).encode()).hexdigest()[:16]


def test_run_ids_and_scores(spark):
    assert files.new_run_id("my-file name.mp4", datetime.datetime(2024, 1, 2, 3, 4, 5)).startswith("20240102_030405_myfilename_")

    def scorer(model, items):
        if "bad" in items:
            raise ValueError
        return [model + len(i) for i in items]

    df = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "x string").coalesce(1)
    assert sorted(r[0] for r in df.select(files.score_with(df, "x", scorer, lambda: 1)).collect()) == [0.0, 2.0, 4.0]


def test_late_words_are_dropped(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "chunk_id long, word_idx long, ts timestamp"
    for n, seconds in enumerate(([0, 1, 60], [2, 61], [130])):
        spark.createDataFrame([(1, 10 * n + i, at(s)) for i, s in enumerate(seconds)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{n}"))
    source = tmp_path / "in"
    source.mkdir()
    out, names = [], []
    stream = monitor.silent_utterances(spark.readStream.schema(schema).parquet(str(source)))
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: out.extend(map(tuple, df.select("n", "first_word").collect()))).start()
    for n in range(3):
        for part in (tmp_path / f"b{n}").glob("*.parquet"):
            part.rename(source / f"{n}-{part.name}")
        query.processAllAvailable()
        names.append(n)
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
    query.stop()
    assert (2, 0) in out and dropped >= 1


def test_diverging_logs(spark):
    x = spark.createDataFrame([("a", i, 90 + i, 0.5 if i < 5 else 2.0, 100, 100) for i in range(30)], "log string, seq long, step long, loss double, used long, free long")
    got = replay(x, monitor.alert_stream, "append").orderBy("seq").collect()
    losses = [0.5 if i < 5 else 2.0 for i in range(30)]
    assert [r["diverging"] for r in got] == [90 + i > 100 and sum(losses[: i + 1]) / (i + 1) > 1 for i in range(30)]


def test_resent_results_once(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "content string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert replay(df, monitor.drop_resent, "append").count() == 2


def test_nms_ties(spark):
    box = "chunk_id long, frame long, track long, x1 double, y1 double, x2 double, y2 double, score double"
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 1.0), (1, 0, 1, 1.0, 1.0, 11.0, 11.0, 1.0), (1, 0, 2, 50.0, 50.0, 60.0, 60.0, 0.1), (1, 1, 1, 1.0, 1.0, 11.0, 11.0, 1.0)], box)
    assert rows(sequences.nms(df), "frame", "track") == [(1, 0, 0), (1, 0, 2), (1, 1, 1)]


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_driver_contract(name):
    import __spark_entry__ as e

    assert callable(getattr(e, name)) and set(e.oracle_sql()) <= set(e.queries())
