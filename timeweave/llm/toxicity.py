"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a hashed word vector and the mean of its hashed character trigrams and prefixes, each kind a half. A word of more bytes
than these inputs see, such as a run of unspaced text, is read as overlapping pieces, each a word of its own. The network reads
windows of `WINDOW` words, each overlapping the next; a document scores as its worst window. It is fitted on the
driver from a bounded sample of labelled rows (see `fit`): word vectors drop out at random, a part of the sample is set
aside, and the round that does best there is kept. It is applied to whole texts in one scan without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import crc_mod, lean, release

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN, ATTENTION = 1 << 15, 1 << 14, 12, 16, 16
WIDTH = 16  # bytes that a word's inputs see, its mark included
PREFIXES = (5, 6, 7, 8, 9)  # bytes of a word's prefixes, its mark included
OVERLAP = 8  # least bytes that neighbouring pieces of a longer word share
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces_of(word: bytes) -> list[bytes]:
    """Overlapping pieces of at most WIDTH - 1 bytes that cover a word, cut between characters."""
    size, out, start = WIDTH - 1, [], 0
    while True:
        stop = min(len(word), start + size)
        while stop < len(word) and word[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(word[start:stop])
        if stop == len(word):
            return out
        start = stop - OVERLAP
        while word[start] & 0xC0 == 0x80:
            start -= 1


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII bytes; longer ones in pieces."""
    words = text.encode("utf-8", "replace").translate(_FOLD).split() if text else []
    if not words or max(map(len, words)) < WIDTH:
        return words
    return [p for w in words for p in ((w,) if len(w) < WIDTH else pieces_of(w))]


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets (n), buckets of trigrams and prefixes (n, WIDTH - 2 + len(PREFIXES)) and their weights (same shape; rows
    add up to 1, half on either kind). A prefix as long as the word or longer has no weight but the shortest."""
    raw = np.array([b"^" + w for w in words], dtype=f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH).astype(np.uint64)
    powers = np.cumprod(np.full(WIDTH, 0x100000001B3, np.uint64))
    mix = lambda h: (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    word = (mix((raw * powers).sum(axis=1)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    grams = (raw[:, :-2] * np.uint64(257) + raw[:, 1:-1]) * np.uint64(257) + raw[:, 2:]
    starts = np.stack([(raw[:, :k] * powers[:k]).sum(axis=1) + np.uint64(7 * k) for k in PREFIXES], axis=1)
    inside = (raw[:, 2:] > 0).astype(np.float32)
    begun = np.stack([raw[:, k - 1] > 0 for k in PREFIXES], axis=1).astype(np.float32)
    begun[:, 0] = 1
    share = lambda w: 0.5 * w / np.maximum(w.sum(axis=1, keepdims=True), 1)
    weight = np.concatenate([share(inside), share(begun)], axis=1)
    weight /= weight.sum(axis=1, keepdims=True)
    return word, (mix(np.concatenate([grams, starts], axis=1)) % np.uint64(CHAR_BUCKETS)).astype(np.int64), weight


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BiGru:
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> BiGru:
        r = np.random.default_rng(seed)
        d, h, a = 2 * DIM, HIDDEN, ATTENTION
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"word": 0.1 * r.standard_normal((WORD_BUCKETS, DIM)).astype(np.float32), "char": 0.1 * r.standard_normal((CHAR_BUCKETS, DIM)).astype(np.float32)}
        for k in ("f", "b"):
            p |= {f"W{k}": make(d, 3 * h), f"U{k}": make(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        p |= {"A": make(2 * h, a), "a": np.zeros(a, np.float32), "v": make(a), "o": make(2 * h), "bias": np.zeros(1, np.float32)}
        return BiGru(p)

    def embed(self, inputs: tuple) -> np.ndarray:
        word, chars, weight = inputs
        out = np.empty((len(word), 2 * DIM), np.float32)
        for s in range(0, len(word), 8192):
            e = s + 8192
            out[s:e, :DIM] = self.p["word"][word[s:e]]
            out[s:e, DIM:] = np.einsum("nk,nkd->nd", weight[s:e], self.p["char"][chars[s:e]])
        return out

    def _direction(self, x: np.ndarray, mask: np.ndarray, k: str, keep: bool):
        """Hidden states (T, B, H) over x (T, B, 3H), already projected; `keep` also returns what backward needs."""
        U, h, steps = self.p[f"U{k}"], np.zeros((x.shape[1], HIDDEN), np.float32), []
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if k == "f" else range(len(x) - 1, -1, -1):
            g = h @ U
            zr = 1 / (1 + np.exp(-(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            new = np.where(mask[t, :, None], new, h)
            if keep:
                steps.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out, steps

    def _pool(self, H: np.ndarray, mask: np.ndarray):
        u = np.tanh(H @ self.p["A"] + self.p["a"])
        s = np.where(mask, u @ self.p["v"], -1e9)
        e = np.exp(s - s.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, H)
        return u, alpha, pooled, pooled @ self.p["o"] + self.p["bias"][0]

    def logits(self, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows ids (T, B) of words whose input projections are given per direction."""
        H = np.concatenate([self._direction(projected[k][ids], mask, k, False)[0] for k in ("f", "b")], axis=2)
        return self._pool(H, mask)[3]

    def project(self, inputs: tuple) -> dict[str, np.ndarray]:
        x = self.embed(inputs)
        return {k: x @ self.p[f"W{k}"] + self.p[f"c{k}"] for k in ("f", "b")}

    def gradients(self, inputs: tuple, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray, kept: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """`kept` are factors of the words' own vectors: 0 drops one out."""
        p, used = self.p, np.unique(ids)
        local = np.searchsorted(used, ids)
        inputs = tuple(x[used] for x in inputs)
        x, own = self.embed(inputs), np.ones((len(used), 1), np.float32) if kept is None else kept[used, None]
        x[:, :DIM] *= own
        runs = {k: self._direction((x @ p[f"W{k}"] + p[f"c{k}"])[local], mask, k, True) for k in ("f", "b")}
        H = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        u, alpha, pooled, logit = self._pool(H, mask)
        d_logit = ((sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["o"]
        d_alpha = np.einsum("bh,tbh->tb", d_pooled, H)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_u = d_s[:, :, None] * p["v"] * (1 - u * u)
        g["v"] = np.einsum("tb,tba->a", d_s, u)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", H, d_u), d_u.sum(axis=(0, 1))
        d_H = alpha[:, :, None] * d_pooled + d_u @ p["A"].T
        d_x = np.zeros_like(x)
        for i, k in enumerate(("f", "b")):
            U, d_h = p[f"U{k}"], np.zeros((ids.shape[1], HIDDEN), np.float32)
            d_in = np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
            g[f"U{k}"] = np.zeros_like(U)
            for t, h, z, r, n, gn in reversed(runs[k][1]):
                m = mask[t, :, None]
                full = d_h + d_H[t, :, i * HIDDEN : (i + 1) * HIDDEN]
                d_new = np.where(m, full, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * gn * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_in[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                g[f"U{k}"] += h.T @ d_g
                d_h = np.where(m, d_new * z + d_g @ U.T, full)
            per_word = np.zeros((len(used), 3 * HIDDEN), np.float32)
            np.add.at(per_word, local.ravel(), d_in.reshape(-1, 3 * HIDDEN))
            g[f"W{k}"], g[f"c{k}"] = x.T @ per_word, per_word.sum(axis=0)
            d_x += per_word @ p[f"W{k}"].T
        word, chars, weights = inputs
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], word, own * d_x[:, :DIM])
        for c in range(chars.shape[1]):
            np.add.at(g["char"], chars[:, c], weights[:, c, None] * d_x[:, DIM:])
        return g


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows that cover n words; the last one ends at the text's end."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _numbered(texts: list) -> tuple[list[bytes], list[np.ndarray]]:
    split = [words_of(t) for t in texts]
    number: dict[bytes, int] = {}
    return_ids = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in split]
    return list(number), return_ids


def _window_ids(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, B) ids, (T, B) mask and each window's document."""
    owner = [(d, s) for d, ids in enumerate(docs) for s in windows_of(len(ids))]
    out, mask = np.zeros((WINDOW, len(owner)), np.int64), np.zeros((WINDOW, len(owner)), bool)
    for k, (d, s) in enumerate(owner):
        piece = docs[d][s : s + WINDOW]
        out[: len(piece), k], mask[: len(piece), k] = piece, True
    return out, mask, np.array([d for d, _ in owner], np.int64)


def _log_odds(docs: list[np.ndarray], labels: np.ndarray, features: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of each hashed feature's documents, 0 where it is in fewer than three."""
    df = np.zeros((2, size))
    for d, y in zip(docs, labels):
        u = np.unique(d)
        df[y, np.unique(features[u][weights[u] > 0])] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    return np.where(df.sum(axis=0) < 3, 0, np.clip(odds, -4, 4)).astype(np.float32)


def _worst(net: BiGru, inputs: tuple, ids: np.ndarray, mask: np.ndarray, owner: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's output, and the largest of each of `docs`."""
    projected = net.project(inputs)
    out = np.concatenate([net.logits(projected, ids[:, s : s + 4096], mask[:, s : s + 4096]) for s in range(0, len(owner), 4096)])
    best = np.full(owner.max() + 1, -np.inf, np.float32)
    np.maximum.at(best, owner, out)
    return out, best[docs]


def _cut(out: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(error, cut): of cuts between clean and toxic outputs the one with the fewest rows on the wrong side, and that
    number's share. It lies a third up the widest such gap: toxic rows are few, so the least of them says less."""
    order = np.argsort(out, kind="stable")
    v, toxic = out[order].astype(float), y[order] == 1
    wrong = np.r_[0, np.cumsum(toxic)] + (~toxic).sum() - np.r_[0, np.cumsum(~toxic)]
    edges = np.r_[v[0] - 1, v, v[-1] + 1]
    best = np.flatnonzero(wrong == wrong.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float(wrong.min()) / len(y), float(2 * edges[widest] + edges[widest + 1]) / 3


def train(
    texts: list[str], labels: np.ndarray, seed: int = 5, rounds: int = 4, epochs: int = 2, batch: int = 192, rate: float = 0.012, aside: float = 0.2, dropped: float = 0.4
) -> BiGru:
    """Multiple-instance training: each round picks every document's most telling window (at first by word counts,
    later by the network) and clean windows at random; then runs a few epochs of Adam over them, more on few rows.
    A share `aside` of the texts, equal ones together, does not teach; of all rounds the one with the fewest errors there is kept, and its
    bias moved so that the best cut there is a score of a half. `dropped` is the share of word vectors left out of a step."""
    r, words, docs = np.random.default_rng(seed), *_numbered(texts)
    net, inputs = BiGru.fresh(seed), word_inputs(words or [b"-"])
    ids, mask, owner = _window_ids(docs)
    if not len(owner) or labels.min() == labels.max():
        net.p["o"][:], net.p["bias"][0] = 0, 3.0 if len(labels) and labels.min() == 1 else -3.0
        return net
    held = np.array([zlib.crc32((t or "").encode("utf-8", "replace")) for t in texts]) / 2**32 < aside
    worded = np.array([len(d) > 0 for d in docs])
    if any((held & worded & (labels == y)).sum() < 5 or (~held & worded & (labels == y)).sum() < 5 for y in (0, 1)):
        held[:] = False  # too few to set any aside
    judges = np.flatnonzero((held if held.any() else ~held) & worded)
    teach = [d for d, h in zip(docs, held) if not h]
    odds = _log_odds(teach, labels[~held], inputs[0][:, None], np.ones((len(words), 1)), WORD_BUCKETS)
    gram_odds = _log_odds(teach, labels[~held], inputs[1], inputs[2], CHAR_BUCKETS)
    net.p["word"][:, 0], net.p["char"][:, 0] = odds, 2 * gram_odds
    telling = np.where(mask, (odds[inputs[0]] + (inputs[2] * gram_odds[inputs[1]]).sum(axis=1))[ids], -9).max(axis=0)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, y, best = 0, labels[owner].astype(np.float32), (np.inf, None)
    mine = np.flatnonzero(~held[owner])
    for _ in range(rounds):
        order = mine[np.lexsort((r.random(len(mine)), -telling[mine], owner[mine]))]
        first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        clean = mine[y[mine] == 0]
        chosen = np.concatenate([first, r.choice(clean, min(len(clean), 2 * len(first)), replace=False)])
        balance = np.where(y == 1, 0.5 / max(y[chosen].mean(), 0.02), 0.5 / max(1 - y[chosen].mean(), 0.02)).astype(np.float32)
        for _ in range(max(epochs, -(-40 * batch // len(chosen)))):
            for part in np.array_split(r.permutation(chosen), max(1, len(chosen) // batch)):
                kept = ((r.random(len(words)) >= dropped) / (1 - dropped)).astype(np.float32)
                g, step = net.gradients(inputs, ids[:, part], mask[:, part], y[part], balance[part], kept), step + 1
                for k, v in net.p.items():
                    m, s = state[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.01 * (g[k] * g[k] - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        telling, worst = _worst(net, inputs, ids, mask, owner, judges)
        error, cut = _cut(worst, labels[judges])
        if error < best[0]:
            best = error, {k: v.copy() for k, v in net.p.items()}
            best[1]["bias"] -= np.float32(cut)
    return BiGru(best[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: dict[int, int], most_chars: int, id_col: str = "doc_id", text_col: str = "text", slices: int = 8) -> pd.DataFrame:
    """A bounded sample on the driver: of each class at most per_class ids, in hash order, whatever their texts' length (the
    smallest text of those that repeat an id). A text of over most_chars characters is read in `slices` evenly spread slices,
    from its beginning to its end, of most_chars together."""
    ids = labels.where(keep).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(list(per_class)) & F.col("id").isNotNull())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    ranked = ids.join(texts.select("id"), "id", "left_semi").withColumn("h", F.xxhash64("id", F.lit(3)))
    parts = [ranked.where(F.col("y") == y).orderBy("h", "id").limit(n) for y, n in per_class.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    size = most_chars // slices
    start = lambda i: (F.floor((F.length("text") - size) * i / (slices - 1)) + 1).cast("int")
    spread = F.concat_ws("\n", *[F.substring(F.col("text"), start(i), F.lit(size)) for i in range(slices)])
    short = texts.join(F.broadcast(chosen.distinct()), "id").withColumn("text", F.when(F.length("text") <= most_chars, F.col("text")).otherwise(spread))
    one = short.groupBy("id", "y").agg(F.min("text").alias("text"))
    return one.toPandas().sort_values(["id", "text"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, toxic_rows: int = 1000, clean_rows: int = 2000, most_chars: int = 16000, id_col: str = "doc_id", text_col: str = "text") -> BiGru:
    """Fit on at most toxic_rows + clean_rows labelled rows outside the held-out fold, of a longer text most_chars characters."""
    pdf = labelled_sample(docs, labels, label, crc_mod(id_col, modulus) != held_out, {1: toxic_rows, 0: clean_rows}, most_chars, id_col, text_col)
    return train(pdf["text"].tolist(), pdf["y"].to_numpy(np.int64))


def score_texts(net: BiGru, texts: list, most_windows: int = 4096) -> np.ndarray:
    """The worst window's probability of each whole text; a text without words scores 0."""
    out = np.zeros(len(texts))
    words, docs = _numbered(texts)
    if not words:
        return out
    projected = net.project(word_inputs(words))
    best = np.full(len(texts), -np.inf, np.float32)
    ids, mask, owner = _window_ids(docs)
    for s in range(0, len(owner), most_windows):
        np.maximum.at(best, owner[s : s + most_windows], net.logits(projected, ids[:, s : s + most_windows], mask[:, s : s + most_windows]))
    seen = np.isfinite(best)
    out[seen] = sigmoid(best[seen].astype(float))
    return out


def bounded_batches(texts: list, most_bytes: int = 1_000_000) -> Iterator[slice]:
    """Slices of about most_bytes characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_bytes:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def score(docs: DataFrame, net: BiGru, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts, and texts without words, score 0 and are clean. Texts are scored whole whatever
    their length; equal texts score equal. Null ids are kept and are in no fold. Extra columns are not read. An empty
    table gives no rows; without labelled rows of both classes every text scores the one class seen, else clean.
    """
    model = docs.sparkSession.sparkContext.broadcast(net.p)  # a fixed size: the hashed tables and the weights

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = BiGru(model.value)
        for pdf in batches:
            texts = pdf["t"].tolist()
            for part in bounded_batches(texts):
                yield pd.DataFrame({"doc_id": pdf["d"].iloc[part], "held_out": pdf["h"].iloc[part], "score": score_texts(own, texts[part])})

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(crc_mod(id_col, modulus) == held_out, F.lit(False)).alias("h"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, net: BiGru, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(net.p)

    @F.pandas_udf("double")
    def of_text(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = BiGru(model.value)
        for s in series:
            texts = s.tolist()
            parts = [score_texts(own, texts[p]) for p in bounded_batches(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        release()

    return docs.where(of_text(F.col(text_col)) < threshold)
