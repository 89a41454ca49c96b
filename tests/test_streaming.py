"""Streams that stop and go on: exactly-once output, state and timers, growing files, late rows."""

import datetime
import glob
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timeweave.functions.logs import is_crash
from timeweave.sources import files
from timeweave.sources.tail import TailReader, tail
from timeweave.streaming import monitor, runner

WORD = "chunk_id long, word_idx long, word string, start_ms long, end_ms long, ts timestamp"


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def said(spark, rows):
    return spark.createDataFrame([(c, i, f"w{i}" if i is not None else None, s, e, at(s or 0) if t is None else at(t)) for c, i, s, e, t in rows], WORD)


def arrive(spark, folder, batches, transform, out, state, **how):
    """Each batch is written and drained by a query of its own that goes on from the checkpoint."""
    ended = []
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(folder)
        stream = transform(spark.readStream.schema(b.schema).parquet(folder))
        ended.append(runner.drain(stream, out, state, **how))
    return runner.read_out(spark, stream, out), ended


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "state")]


def test_a_batch_that_fails_after_its_write_is_written_once(spark, places):
    source, out, state = places
    write, calls = runner.once(out, "append"), []

    def dies_once(batch, number):
        write(batch, number)
        calls.append(number)
        if calls == [0, 1]:
            raise RuntimeError("lost between write and commit")

    rows = [spark.range(10 * k, 10 * k + 10) for k in range(3)]
    rows[0].write.parquet(source)
    stream = spark.readStream.schema(rows[0].schema).parquet(source)
    runner.drain(stream, out, state, sink=dies_once)
    rows[1].write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost between write and commit"):
        runner.drain(stream, out, state, sink=dies_once)
    assert runner.read_out(spark, stream, out).count() == 20  # what the failed batch wrote is there
    rows[2].write.mode("append").parquet(source)
    runner.drain(stream, out, state, sink=dies_once)
    assert calls[:3] == [0, 1, 1]
    assert sorted(r[0] for r in runner.read_out(spark, stream, out).collect()) == list(range(30))


def test_complete_mode_keeps_the_last_result(spark, places):
    batches = [spark.range(5), spark.range(7)]
    got, _ = arrive(spark, places[0], batches, lambda s: s.groupBy().count(), *places[1:], mode="complete")
    assert got.collect() == [(12,)]


def test_settings_come_back(spark):
    name = next(iter(runner.STATE))
    before = spark.conf.get(name, None)
    with pytest.raises(ZeroDivisionError), runner.settings(spark, runner.STATE):
        assert spark.conf.get(name) == runner.STATE[name]
        _ = 1 // 0
    assert spark.conf.get(name, None) == before


def test_utterances_close_once_by_word_length_and_timer(spark, places):
    batches = [
        said(spark, [(1, 0, 0, 900, None), (1, 1, 1000, 8000, None), (1, 2, 8100, 15500, None)]),
        said(spark, [(1, 3, 15600, 16000, None), (2, 0, 15000, 15100, None)]),
        said(spark, [(2, 1, 18000, 18100, None), (1, None, None, None, 17000)]),
        said(spark, [(3, 0, 60000, 60100, None)]),
        said(spark, [(3, 1, 61000, 61100, None), (None, 5, 61000, 61100, None)]),
        said(spark, [(-1, None, None, None, 900_000)]),
    ]
    got, _ = arrive(spark, places[0], batches, monitor.utterances, *places[1:])
    assert sorted(map(tuple, got.collect())) == [
        (1, 0, 15500, 3, 0, 2, "w0 w1 w2"), (1, 15600, 16000, 1, 3, 3, "w3"), (2, 15000, 15100, 1, 0, 0, "w0"), (2, 18000, 18100, 1, 1, 1, "w1"), (3, 60000, 61100, 2, 0, 1, "w0 w1"),
    ]
    # Chunk 2's first utterance was closed by a later word, the others' last ones by timers in batches without their words.
    closed = {int(p.split("batch=")[1].split("/")[0]): 1 for p in glob.glob(f"{places[1]}/batch=*/*.parquet")}
    assert len(closed) >= 3


@pytest.mark.parametrize("seed", [1, 2])
def test_utterances_do_not_depend_on_the_batches(spark, tmp_path, seed):
    r, rows, want = random.Random(seed), [], []
    for chunk in range(4):
        t = 0
        for i in range(60):
            t += r.choice([50, 200, 1600, 9000])
            rows.append((chunk, i, t, t + 100, None))
            t += 100
    for chunk in range(4):
        now = None
        for c, i, s, e, _ in rows:
            if c == chunk:
                if now and (s - now[1] > 1500 or now[1] - now[0] >= 15000):
                    want.append((chunk, now[0], now[1], len(now[2])))
                    now = None
                now = (now[0], e, [*now[2], i]) if now else (s, e, [i])
        want.append((chunk, now[0], now[1], len(now[2])))
    rows.sort(key=lambda x: x[2])
    cuts = sorted(r.sample(range(1, len(rows)), 3))
    batches = [said(spark, rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [said(spark, [(-1, None, None, None, 10**9)])]
    places = [str(tmp_path / x) for x in ("in", "out", "state")]
    got, _ = arrive(spark, places[0], batches, monitor.utterances, *places[1:])
    assert sorted(tuple(x)[:4] for x in got.collect()) == sorted(want)


def test_neighbouring_chunks_share_a_state_and_close_on_their_own(spark, places):
    """A call of Python for every chunk and batch made a stream of many chunks slow."""
    batches = [
        said(spark, [(c, 0, 0, 100 + c, None) for c in range(64)]),
        said(spark, [(0, 1, 1000, 1100, None), (7, 2, 4000, 4100, None), (7, 1, 200, 300, None), (-3, 0, 30000, 30100, None)]),
        said(spark, [(5, 1, 31000, 31100, None), (-3, 1, 31000, 31100, None)]),
        said(spark, [(-1, None, None, None, 900_000)]),
    ]
    got, ended = arrive(spark, places[0], batches, monitor.utterances, *places[1:])
    assert max(p["stateOperators"][0]["numRowsTotal"] for q in ended for p in q.recentProgress) <= 3
    want = [(c, 0, 100 + c, 1) for c in range(64) if c not in (0, 7)] + [(0, 0, 1100, 2), (7, 0, 300, 2), (7, 4000, 4100, 1), (5, 31000, 31100, 1), (-3, 30000, 31100, 2)]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert {r["text"] for r in got.where("chunk_id = 7").collect()} == {"w0 w1", "w2"}


def test_late_words_are_counted(spark, places):
    batches = [said(spark, [(1, 0, 0, 100, None), (1, 2, 60000, 60100, None)]), said(spark, [(1, 1, 1000, 1100, None), (1, 3, 61000, 61100, None), (1, 4, 54999, 55000, None), (1, 5, 55001, 55002, None)]), said(spark, [(-1, None, None, None, 900_000)])]
    got, ended = arrive(spark, places[0], batches, monitor.utterances, *places[1:])
    assert [runner.dropped_late(q) for q in ended] == [(2, 0), (4, 2), (1, 0)]
    assert got.agg(F.sum("n")).first()[0] == 4


# Growing files


def grow(folder, name, more):
    with open(f"{folder}/{name}", "ab") as f:
        f.write(more)


def lines(frame):
    return [(r["log"], r["seq"], r["line"]) for r in frame.orderBy("log", "seq").collect()]


def test_tail_reads_new_whole_lines(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    stream, steps = None, []
    for pieces in ([("a.log", b"one\rtwo\r\nthr"), ("b.log", b"no end"), (".hidden.log", b"x\n"), ("c.txt", b"other\n")], [("a.log", b"ee\n\n\nfour\n")], [("b.log", b" yet\n"), ("a.log", "fünf".encode() + b"\xff\n")], []):
        for name, more in pieces:
            grow(folder, name, more)
        stream = tail(spark, str(folder), suffix=".log")
        runner.drain(stream, out, state)
        steps.append(lines(runner.read_out(spark, stream, out)))
    assert steps[0] == [("a", 0, "one"), ("a", 4, "two")]
    assert steps[1] == [("a", 0, "one"), ("a", 4, "two"), ("a", 9, "three"), ("a", 17, "four")]
    assert steps[2] == [*steps[1], ("a", 22, "fünf�"), ("b", 0, "no end yet")]
    assert steps[3] == steps[2]


@pytest.mark.parametrize("piece", [1, 3, 7, 64])
def test_pieces_give_every_line_once(tmp_path, piece):
    r = random.Random(piece)
    body = b"".join(bytes(r.choices(b"ab", k=r.randint(0, 9))) + r.choice([b"\n", b"\r", b"\r\n"]) for _ in range(60))
    grow(tmp_path, "x.log", body + b"open")
    reader = TailReader({"path": str(tmp_path), "piecebytes": str(piece)})
    end = reader.latestOffset()
    assert list(end.values()) == [len(body)]
    got = [row for p in reader.partitions({}, end) for row in reader.read(p)]
    whole = TailReader({"path": str(tmp_path)})
    assert got == [row for p in whole.partitions({}, end) for row in whole.read(p)]
    assert [x[2] for x in got] == [x for x in body.decode().replace("\r", "\n").split("\n") if x]


def test_short_files_share_a_task(tmp_path):
    for i in range(30):
        grow(tmp_path, f"{i:02d}.log", b"one\ntwo\n")
    (tmp_path / "sub").mkdir()
    grow(tmp_path / "sub", "x.log", b"three\n" * 40)
    reader = TailReader({"path": str(tmp_path), "piecebytes": "100"})
    end = reader.latestOffset()
    assert end["00.log"] == 8 and end["sub/x.log"] == 240
    parts = reader.partitions({}, end)
    assert len(parts) <= 6
    assert sorted(row for p in parts for row in reader.read(p)) == sorted([(f"{i:02d}", at, w) for i in range(30) for at, w in ((0, "one"), (4, "two"))] + [("x", 6 * k, "three") for k in range(40)])
    assert reader.partitions(end, end) == []


def test_tail_bound_and_replaced_files(tmp_path):
    grow(tmp_path, "x.log", b"0123456789\n" * 5)
    reader = TailReader({"path": str(tmp_path), "tailbytes": "15"})
    first = reader.latestOffset()
    assert [x[2] for p in reader.partitions({}, first) for x in reader.read(p)] == ["789", "0123456789"]
    (tmp_path / "x.log").write_bytes(b"new\n")
    after = reader.latestOffset()
    assert [x[2] for p in reader.partitions(first, after) for x in reader.read(p)] == ["new"]


def test_log_status_of_growing_files_is_the_batch_state(spark, tmp_path):
    """A crash line, a benign fault and other lines; the log goes on between batches."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    step = lambda i: f"Steps:  1%|#  | {i}/9 [01:23<02:34,  2.5it/s, step_loss=0.{i}]\r".encode()
    parts = [step(1) + step(2) + b"saving\n" + step(3)[:20], step(3)[20:] + b"RuntimeError: fp16\n" + step(4), b"RuntimeError: CUDA error\n"]
    seen = []
    for part in parts:
        grow(folder, "run.log", part)
        grow(folder, "idle.log", b"no progress\n")
        stream = monitor.log_status(tail(spark, str(folder)))
        runner.drain(stream, out, state)
        last = runner.read_out(spark, stream, out).groupBy("log").agg(F.max_by(F.struct("step", "total", F.round("mean_loss", 3).alias("m"), F.round("eta_s", 3).alias("e"), "done", "crashed"), "seq").alias("s")).orderBy("log").select("s.*").collect()
        seen.append([tuple(r) for r in last])
    none = (None, None, None, None, False, False)
    assert seen == [[none, (2, 9, 0.15, 2.8, False, False)], [none, (4, 9, 0.25, 2.0, False, False)], [none, (4, 9, 0.25, 2.0, False, True)]]
    batch = files.read_train_log(spark, str(folder)).where("log = 'run'")
    assert batch.count() == 7 and batch.where(is_crash(F.col("line"))).count() == 1


def test_texts_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\r"), ("b", "")], "name string, content string")
    for _ in range(2):
        files.write_texts(df, str(tmp_path / "t"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "t").iterdir()} == {"a.log": b"x\r", "b.log": b""}


def test_read_out_of_a_stream_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], StructType().add("x", "long"))
    assert runner.read_out(spark, empty, str(tmp_path / "nothing")).collect() == []
