"""Quality by positive-unlabelled learning: a small network fitted on the non-negative unbiased risk.

Trusted positives are labelled rows of class 1; the unlabelled set is all text. The share of class 1 in it (the class
prior) is estimated from the labelled rows outside the held-out fold. With sigmoid loss l the risk is
    prior * E_p[l(g, +1)] + max(0, E_u[l(g, -1)] - prior * E_p[l(g, -1)])
and when the bracket falls below zero its gradient is reversed, so the network cannot fit the unlabelled set as
negatives. Features of every whole text are made once and written. Their means and deviations cover all rows. Starting
weights come from a bounded sample of both sets; then every epoch takes mini-batches of all rows: each task walks through
its rows from the same weights, and the mean of the tasks' weights, by their rows, starts the next epoch. The risk over all
rows is measured before and after each epoch, and the weights of the least risk stay.
The operating point of the score is put in the emptiest stretch of all rows' outputs near the prior's quantile.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import crc_mod, lean, staged
from timeweave.llm.toxicity import sigmoid

OPERATING_POINT, SPREAD = 0.7, 0.02
# Character classes of bytes; all others of ASCII are classes of their own.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\r", "\n", ".", ",", "!", "?", "*#$%&@^~=+", "|", "<>{}[]()\\/", "'\"`:;_-"]
CLASSES = 16
_CLASS = np.full(256, CLASSES - 1, np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[np.frombuffer(_g.encode(), np.uint8)] = _i
_CLASS[128:] = CLASSES - 2
EXTRA = 14
FEATURES = CLASSES * CLASSES + CLASSES + EXTRA
WEIGHTS = ("w1", "b1", "w2")


def features(text: str | None) -> np.ndarray:
    """Frequencies of character classes and their pairs, and shape figures, of the whole text."""
    out = np.zeros(FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    n, pairs = len(c), CLASSES * CLASSES
    if n > 1:
        out[:pairs] = np.sqrt(np.bincount(c[:-1] * np.uint8(CLASSES) + c[1:], minlength=pairs) / (n - 1))
    out[pairs : pairs + CLASSES] = np.sqrt(np.bincount(c, minlength=CLASSES) / n)
    words = raw.split()
    w = len(words)
    if w:
        seen = Counter(words)
        bigrams = set(zip(words, words[1:]))
        lines = raw.split(b"\n")
        lengths = np.fromiter(map(len, words), np.float32, w)
        out[-EXTRA:] = (
            len(seen) / w, len(seen) / w**0.7, max(seen.values()) / w, sum(a == b for a, b in zip(words, words[1:])) / w, len(bigrams) / w,
            lengths.mean() / 10, lengths.std() / 10, lengths.max() / 40, np.log1p(w) / 8, len(set(lines)) / len(lines), np.log1p(len(lines)) / 6,
            w / len(lines) / 60, len(zlib.compress(raw, 1)) / n, float(w < 8),
        )
    return out


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    shift: float
    slope: float
    risks: tuple[float, ...] = ()  #: over all rows: of the starting weights, then after each epoch

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w1 + self.b1) @ self.w2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.logits(x) - self.shift) * self.slope + np.log(OPERATING_POINT / (1 - OPERATING_POINT)))


def valley(counts: np.ndarray, share: float, slack: float = 0.25, width: int = 48) -> float:
    """Place (in bins) of the emptiest stretch of a histogram, among those whose share below is near `share`; the middle of
    all equally empty ones in a row."""
    below = np.cumsum(counts) / max(1, counts.sum())
    full = np.convolve(counts, np.ones(width), "same")
    near = np.flatnonzero((below >= share * (1 - slack)) & (below <= min(share * (1 + slack), 1 - 0.25 * (1 - share))))
    if not len(near):
        return float(np.searchsorted(below, share))
    empty = near[full[near] == full[near].min()]
    runs = np.split(empty, np.flatnonzero(np.diff(empty) != 1) + 1)
    longest = max(runs, key=len)
    return float(longest[0] + longest[-1] + 1) / 2


def _gradient(net: Scorer, x: np.ndarray, d_out: np.ndarray, hid: np.ndarray) -> dict[str, np.ndarray]:
    d_hid = d_out[:, None] * net.w2 * (1 - hid * hid)
    return {"w1": x.T @ d_hid, "b1": d_hid.sum(axis=0), "w2": hid.T @ d_out}


def _part(net: Scorer, x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(sigmoid outputs, gradient of their sum) over rows of scaled features."""
    hid = np.tanh(x @ net.w1 + net.b1)
    s = sigmoid(hid @ net.w2)
    return s, _gradient(net, x, s * (1 - s), hid)


def _combine(net: Scorer, prior: float, positive: tuple, unlabelled: tuple, decay: float) -> dict[str, np.ndarray]:
    """Gradient of the non-negative risk from the means of both sets: the sigmoid loss of class -1 is s, of class +1 is 1 - s."""
    (s_p, g_p), (s_u, g_u) = positive, unlabelled
    rest = {k: g_u[k] - prior * g_p[k] for k in g_u}
    if s_u - prior * s_p >= 0:
        g = {k: rest[k] - prior * g_p[k] for k in rest}
    else:
        g = {k: -rest[k] for k in rest}
    return {k: v + (decay * getattr(net, k) if k != "b1" else 0) for k, v in g.items()}


def _risk(prior: float, s_p: float, s_u: float) -> float:
    """The non-negative risk, from the mean outputs of both sets."""
    return float(prior * (1 - s_p) + max(0.0, s_u - prior * s_p))


class Adam:
    def __init__(self, net: Scorer, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.moments = {k: [np.zeros_like(getattr(net, k)) for _ in range(2)] for k in WEIGHTS}

    def take(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, (m, q) in self.moments.items():
            m += 0.1 * (g[k] - m)
            q += 0.01 * (g[k] ** 2 - q)
            value = getattr(self.net, k)
            value -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(q / (1 - 0.99**self.step)) + 1e-8)


def _step(adam: Adam, prior: float, x_p: np.ndarray, x_u: np.ndarray, decay: float) -> None:
    """One step on a mini-batch of each set, of scaled features."""
    sides = []
    for x in (x_p, x_u):
        s, g = _part(adam.net, x)
        sides.append((s.mean(), {k: v / len(x) for k, v in g.items()}))
    adam.take(_combine(adam.net, prior, *sides, decay))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray | None = None, scale: np.ndarray | None = None, seed: int = 9, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.004, decay: float = 1e-3) -> Scorer:
    """Minimise the non-negative risk by Adam over paired batches of both sets; the operating point is left at 0."""
    if not len(positive) or not len(unlabelled):
        zero = np.zeros(FEATURES, np.float32)
        return Scorer(zero, zero + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    r = np.random.default_rng(seed)
    if mean is None:
        mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + SPREAD
    net = Scorer(mean, scale, r.standard_normal((FEATURES, hidden)) / np.sqrt(FEATURES), np.zeros(hidden), r.standard_normal(hidden) / np.sqrt(hidden), 0.0, 1.0)
    xp, xu = net.scaled(positive), net.scaled(unlabelled)
    adam, rounds = Adam(net, rate), max(1, len(xu) // batch)
    for _ in range(epochs):
        for part_p, part_u in zip(np.array_split(r.permutation(len(xp)), rounds), np.array_split(r.permutation(len(xu)), rounds)):
            if len(part_p) and len(part_u):
                _step(adam, prior, xp[part_p], xu[part_u], decay)
    return net


def walk(net: Scorer, blocks: Iterator[np.ndarray], positive: np.ndarray, prior: float, batch: int = 512, rate: float = 1e-3, decay: float = 1e-3, seed: int = 9) -> tuple[int, float, Scorer]:
    """Mini-batches over every row of the blocks, each block shuffled, against as many positives drawn anew. Returns the number of
    rows, the sum of the outputs that `net` itself gives them, and the network after the last step; `net` stays as it is."""
    own = replace(net, **{k: getattr(net, k).copy() for k in WEIGHTS})
    xp, adam, r = net.scaled(positive), Adam(own, rate), np.random.default_rng(seed)
    rows, outputs = 0, 0.0
    for block in blocks:
        x = net.scaled(block)
        rows += len(x)
        outputs += float(sigmoid(net.logits(block)).sum())
        for part in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
            _step(adam, prior, xp[r.choice(len(xp), min(batch, len(xp)), replace=False)], x[part], decay)
    return rows, outputs, own


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): features of every whole text, written once."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "x": [features(t) for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return staged(rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, x array<float>"), "features")


def _added(made: DataFrame, of_task: Callable[[Iterator[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Sum over all tasks of what of_task(blocks of features) gives, `size` numbers. They are added by place, so the driver
    gets `size` numbers whatever the table holds."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"k": np.arange(size), "v": of_task(np.stack(pdf["x"].to_numpy()) for pdf in batches if len(pdf))})

    rows = made.select("x").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def _summed(made: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of what of_rows(x) gives for a block of them, `size` numbers."""

    def of_task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(size)
        for x in blocks:
            total += of_rows(x)
        return total

    return _added(made, of_task, size)


def epoch(net: Scorer, made: DataFrame, positive: np.ndarray, prior: float, seed: int = 9) -> tuple[float, Scorer]:
    """One epoch over every row: (mean output of `net` over all rows, network with the mean of the tasks' weights by rows)."""
    shared = made.sparkSession.sparkContext.broadcast((net, positive))  # bounded by the number of positives

    def of_task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        rows, outputs, own = walk(shared.value[0], blocks, shared.value[1], prior, seed=seed)
        return np.concatenate([[rows, outputs], *(rows * getattr(own, k).ravel() for k in WEIGHTS)])

    sizes = [getattr(net, k).size for k in WEIGHTS]
    total = _added(made, of_task, 2 + sum(sizes))
    n, parts = max(1.0, total[0]), np.split(total[2:], np.cumsum(sizes)[:-1])
    return total[1] / n, replace(net, **{k: (v / n).reshape(getattr(net, k).shape) for k, v in zip(WEIGHTS, parts)})


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, positive_rows: int = 4000, start_rows: int = 8000, full_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", made: DataFrame | None = None
) -> Scorer:
    """Fit on at most positive_rows trusted texts outside the held-out fold and on all text: start_rows rows, in hash order
    of the id, give the weights to start from, then full_epochs epochs take mini-batches of every row, labelled or not. Of all
    these weights those of the least risk over all rows stay. `made` is featurise(docs) where the caller has it."""
    made = featurise(docs, id_col, text_col) if made is None else made
    ids = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    trusted = ids.where((crc_mod("id", modulus) != held_out) & F.col("y").isNotNull())
    prior = trusted.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    prior = min(0.98, max(0.02, prior if prior is not None else 0.5))
    known = made.select("id").where("id IS NOT NULL").distinct().withColumn("h", F.xxhash64("id", F.lit(4)))
    chosen = known.join(trusted.where("y = 1").select("id"), "id", "left_semi").orderBy("h", "id").limit(positive_rows).select("id", F.lit(1).alias("p"))
    chosen = chosen.unionByName(known.orderBy("h", "id").limit(start_rows).select("id", F.lit(0).alias("p")))
    # Of rows that repeat an id one stands for all, so what comes to the driver keeps its bound.
    pdf = made.join(F.broadcast(chosen), "id").groupBy("id", "p").agg(F.min("x").alias("x")).toPandas().sort_values(["p", "id"])
    x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, FEATURES), np.float32)
    own = pdf["p"].to_numpy() == 1
    if not own.any():
        return fit_pu(x[:0], x[:0], prior)
    sums = _summed(made, lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=float), (x.astype(float) ** 2).sum(axis=0)]), 1 + 2 * FEATURES)
    n = max(1.0, sums[0])
    mean = sums[1 : 1 + FEATURES] / n
    scale = np.sqrt(np.maximum(0, sums[1 + FEATURES :] / n - mean**2)) + SPREAD
    net = fit_pu(x[own], x[~own], prior, mean, scale)
    s_p = lambda of: sigmoid(of.logits(x[own])).mean()
    tried = []
    for i in range(full_epochs):
        s_u, after = epoch(net, made, x[own], prior, seed=9 + i)
        tried.append((_risk(prior, s_p(net), s_u), net))
        net = after
    shared = made.sparkSession.sparkContext.broadcast(net)  # a fixed size
    s_u = _summed(made, lambda x: np.array([sigmoid(shared.value.logits(x)).sum()]), 1)[0] / n
    tried.append((_risk(prior, s_p(net), s_u), net))
    best = min(tried, key=lambda t: t[0])[1]
    return _placed(replace(best, risks=tuple(t[0] for t in tried)), made, prior)


def _placed(net: Scorer, made: DataFrame, prior: float, bins: int = 4096) -> Scorer:
    """The network with its operating point, from a histogram of all rows' outputs."""
    most = float(np.abs(net.w2).sum()) + 1e-6  # no output is larger
    shared = made.sparkSession.sparkContext.broadcast(net)

    def of_rows(x: np.ndarray) -> np.ndarray:
        out = shared.value.logits(x)
        place = np.clip(((out + most) / (2 * most) * bins).astype(int), 0, bins - 1)
        return np.concatenate([[out.sum(), (out * out).sum()], np.bincount(place, minlength=bins)])

    total = _summed(made, of_rows, bins + 2)
    n = max(1.0, total[2:].sum())
    net.shift = valley(total[2:], 1 - prior) / bins * 2 * most - most
    net.slope = float(2.0 / max(np.sqrt(max(0.0, total[1] / n - (total[0] / n) ** 2)), 1e-3))
    return net


def score(docs: DataFrame, net: Scorer, threshold: float = OPERATING_POINT, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2, made: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have all features zero and get that score. Whole texts are read, whatever their length. Equal texts score equal. Null ids are kept and are in
    no fold. Repeated rows score each. Extra columns are not read. An empty table gives no rows; without positives every row
    scores the operating point. `made` is featurise(docs) where the caller has it.
    """
    made = featurise(docs, id_col, text_col) if made is None else made
    model = made.sparkSession.sparkContext.broadcast(net)  # a fixed size

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                yield pd.DataFrame({"doc_id": pdf["d"], "held_out": pdf["h"], "score": model.value.score(x).astype(float)})

    rows = made.select(F.col("id").cast("long").alias("d"), F.coalesce(crc_mod("id", modulus) == held_out, F.lit(False)).alias("h"), "x")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
