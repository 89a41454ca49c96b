"""Streaming twins of the monitor, levels, words and de-duplication.

Each takes a streaming DataFrame (readStream of any source) and returns a streaming DataFrame; event time is a column
named ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timeweave.functions.logs import is_crash, parse_step

ALERTS = "log string, seq long, peak long, memory boolean, growth boolean, disk boolean, diverging boolean, stalled boolean"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


STATUS = "log string, seq long, step long, total long, mean_loss double, eta_s double, done boolean, crashed boolean"


def log_status(lines: DataFrame, keep: int = 100) -> DataFrame:
    """Of each log with new lines (log, seq, line): latest step and total, mean of the last `keep` losses, seconds left, whether
    it is done or has crashed. Append mode, one row a log and batch; the row of the largest seq is the latest state.

    State is the last `keep` losses, step, total, speed and the crash flag of a log.
    """
    p = lines.select("log", "seq", parse_step(F.col("line")).alias("p"), is_crash(F.col("line")).alias("crash")).select("log", "seq", "p.*", "crash")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        losses, at, total, speed, crashed = (list(state.get[0]), *state.get[1:]) if state.exists else ([], None, None, None, False)
        got = sorted(r for pdf in batches for r in zip(*(pdf[c].tolist() for c in ("seq", "step", "total", "loss", "speed", "crash"))))
        known = [r for r in got if not pd.isna(r[1])]
        if known:
            at, total, speed = int(known[-1][1]), int(known[-1][2]), float(known[-1][4])
        losses = [*losses, *(r[3] for r in known)][-keep:]
        crashed = bool(crashed or any(r[5] for r in got))
        state.update((losses, at, total, speed, crashed))
        left = None if at is None or not speed or total <= at else (total - at) / speed
        mean = sum(losses) / len(losses) if losses else None
        yield pd.DataFrame([(key[0], int(got[-1][0]), at, total, mean, left, at is not None and at >= total, crashed)], columns=[c.split()[0] for c in STATUS.split(", ")])

    state = "losses array<double>, step long, total long, speed double, crashed boolean"
    return p.groupBy("log").applyInPandasWithState(step, STATUS, state, "append", GroupStateTimeout.NoTimeout)


def alert_stream(snapshots: DataFrame, total_mb: int = 16000, keep: int = 100) -> DataFrame:
    """Alerts over snapshots (log, seq, step, loss, used, free): running peak, growth over five snapshots, disk, mean of the
    last `keep` losses over 1 after step 100, stall.

    State is the last five peaks, last three steps and last losses of a log. Rows of a batch are taken in seq order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peaks, steps, losses = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            peaks = [*peaks, max([*peaks[-1:], r.used])][-5:]
            steps, losses = [*steps, r.step][-3:], [*losses, r.loss][-keep:]
            growth = len(peaks) == 5 and peaks[0] > 0 and peaks[-1] > 1.1 * peaks[0]
            diverging = r.step > 100 and sum(losses) / len(losses) > 1.0
            rows.append((key[0], r.seq, peaks[-1], peaks[-1] > 0.92 * total_mb, growth, 0 < r.free < 50, diverging, len(steps) == 3 and len(set(steps)) == 1 and steps[0] > 0))
        state.update((peaks, steps, losses))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALERTS.split(", ")])

    return snapshots.groupBy("log").applyInPandasWithState(step, ALERTS, "peaks array<long>, steps array<long>, losses array<double>", "append", GroupStateTimeout.NoTimeout)


def level_stream(samples: DataFrame, late: str = "2 seconds") -> DataFrame:
    """Level and peak of each clip and second; seconds close when the watermark passes."""
    w = samples.withWatermark("ts", late).groupBy("clip_id", F.window("ts", "1 second"))
    return w.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak")).select("clip_id", F.col("window.start").alias("second"), "rms", "peak")


def speaker_windows(points: DataFrame, late: str = "2 seconds") -> DataFrame:
    """Counts of each speaker in windows of 600 ms every 200 ms."""
    w = points.withWatermark("ts", late).groupBy("chunk_id", "speaker", F.window("ts", "600 milliseconds", "200 milliseconds"))
    return w.agg(F.count("*").alias("n")).select("chunk_id", "speaker", F.col("window.start").alias("start"), "n")


UTTERANCES = "chunk_id long, start_ms long, end_ms long, n long, first_word long, last_word long, text string"
OPEN = "open array<struct<chunk_id: long, due_ms: long, start_ms: long, end_ms: long, n: long, first_word: long, last_word: long, text: string>>"
NEIGHBOURS = 32  # chunks with neighbouring ids that share a state: a call of Python costs as much as a thousand words


def utterances(words: DataFrame, gap_ms: int = 1500, most_ms: int = 15000, late: str = "5 seconds") -> DataFrame:
    """Words (chunk_id, word_idx, word, start_ms, end_ms, ts) closed by a silence, or once most_ms long. Append mode.

    Every utterance comes once, when it is closed: by a later word, or by timer when the watermark passes the silence after
    its last word. Rows without a word number are heartbeats: they move the watermark only (a last one closes what is open
    when a recording ends). Words later than the watermark are dropped and counted.

    State is the open utterances of a few chunks with neighbouring ids, each with the time that closes it; the first of those
    times is the state's timer. It travels with the rows, so the store is not asked while words are read.
    """
    kept = words.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    # A filter that names the event time stays above the watermark, which therefore sees heartbeats.
    heard = kept.where(F.when(F.col("word_idx").isNotNull() & F.col("chunk_id").isNotNull(), F.col("ts")).isNotNull()).select(F.expr(f"chunk_id div {NEIGHBOURS}").alias("near"), "chunk_id", "word_idx", F.coalesce("word", F.lit("")).alias("word"), "start_ms", "end_ms", "at_ms", "ts")

    def walk(now: tuple | None, got: list[tuple], out: list[tuple], chunk: int, mark: int) -> tuple:
        """The open utterance behind words (word_idx, start_ms, end_ms, at_ms, word) in order, those closed go to out."""
        said: list[str] = []
        if now is None:
            i, s, e, _, _ = got[0]
            start, end, n, first, last = s, e, 0, i, i
        else:
            start, end, n, first, last, text = now[2:]
            said.append(text)
        for i, s, e, _, word in got:
            if n and (s - end > gap_ms or end - start >= most_ms):
                out.append((chunk, start, end, n, first, last, " ".join(said)))
                start, n, first, said = s, 0, i, []
            end, n, last = e, n + 1, i
            said.append(word)
        _, s, e, t, _ = got[-1]
        return chunk, max(t + e - s + gap_ms, mark + 1), start, end, n, first, last, " ".join(said)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, out = state.getCurrentWatermarkMs(), []
        open_ = {r[0]: tuple(r) for r in state.get[0]} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            rows = rows.iloc[np.lexsort((rows["word_idx"], rows["chunk_id"]))]
            chunks = rows["chunk_id"].to_numpy()
            heads = [*np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1)).tolist(), len(chunks)]
            for a, b in zip(heads, heads[1:]):
                chunk, part = int(chunks[a]), rows.iloc[a:b]
                got = sorted(zip(*(part[c].tolist() for c in ("word_idx", "start_ms", "end_ms", "at_ms", "word"))))
                open_[chunk] = walk(open_.get(chunk), got, out, chunk, mark)
        # What the watermark has passed is closed, in a call with rows of other chunks as in one by the timer.
        out += [(r[0], *r[2:]) for r in open_.values() if r[1] < mark]
        left = [r for r in open_.values() if r[1] >= mark]
        if left:
            state.update((left,))
            state.setTimeoutTimestamp(max(mark + 1, min(r[1] for r in left)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_names(UTTERANCES))

    return heard.groupBy("near").applyInPandasWithState(step, UTTERANCES, OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def silent_utterances(words: DataFrame, gap: str = "1500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Words closed by a silence alone: one row per chunk and session."""
    w = words.withWatermark("ts", late).groupBy("chunk_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n"), F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word")).select("chunk_id", F.col("session_window.start").alias("start"), "n", "first_word", "last_word")


def drop_resent(results: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Results whose content was not seen within the watermark; one that is sent again later is new."""
    return results.withColumn("fingerprint", F.md5("content")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])
