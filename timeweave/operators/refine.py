"""Refinement of segments: sentence alignment, long splits, splits at cuts, outlier labels and answer parsing.

Where a row's fate depends on what was decided before it, a small function walks over one chunk. Two tables of a chunk
meet by cogroup, so nothing leaves the executors.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import le

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timeweave.operators.lineage import staged
from timeweave.operators.sequences import fold

# Pause marks, connectives, names of answer fields, and the forms of an answer's lines.
PAUSES = (",", ";", ":", "，", "；", "：", "、")
CONNECTIVES = {"and", "but", "so", "because", "however", "although", "while", "when", "if", "then", "also"}
FIELDS = ("korean", "context", "emotion", "tone")
NUMBERED_LINE = r"^\s*[\[\(]?(\d+)[\]\)]?\s*[\.\:\)]?\s+(.*)$"
BARE_NUMBER = r"^\s*[\[\(]?(\d+)[\]\)]?\s*[\.\:\)]?$"
FIELD_LINE = r"(?i)^\s*(korean|context|emotion|tone)\s*[:：]\s*(.*)$"


def _plain(token: str) -> str:
    return "".join(filter(str.isalnum, token)).lower()


class WordPlaces:
    """Where each string stands in a chunk's words, alone or as two words run together."""

    def __init__(self, words: list[str], reach: int = 4):
        plain, self.reach = [_plain(w) for w in words], reach
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(plain):
            self.places[w].append((i, i + 1))
            if i + 1 < len(plain):
                self.places[w + plain[i + 1]].append((i, i + 2))

    def after(self, token: str, at: int) -> tuple[int, int] | None:
        """The first place (start, end) of token among the next `reach` words."""
        listed = self.places.get(token, [])
        k = bisect_left(listed, (at, 0))
        return listed[k] if k < len(listed) and listed[k][0] < at + self.reach else None


def align_words(sentences: list[str], words: list[str]) -> list[int | None]:
    """Sentence number of each word.

    Every token of a sentence is looked up among the next four words; tokens that are not there are passed over. A
    sentence takes all words from its first to its last match. Words left at the end go to the last sentence that took
    any; words before a sentence's first match go to none.
    """
    places, spans, at = WordPlaces(words), [], 0
    for k, sentence in enumerate(sentences):
        met, free = [], at
        for token in filter(None, map(_plain, sentence.split())):
            place = places.after(token, free)
            if place:
                met.append(place)
                free = place[1]
        if met:
            spans.append((met[0][0], free, k))
            at = free
    out: list[int | None] = [None] * len(words)
    for lo, hi, k in spans:
        out[lo:hi] = [k] * (hi - lo)
    if spans:
        out[at:] = [spans[-1][2]] * (len(words) - at)
    return out


def align_sentences(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, word_idx, sentence) from ordered (chunk_id, n, sentence) and words; sentence is null for lost words."""

    def run(s: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values("word_idx")
        got = align_words(s.sort_values("n")["sentence"].tolist(), w["word"].tolist())
        return pd.DataFrame({"chunk_id": w["chunk_id"], "word_idx": w["word_idx"], "sentence": pd.array(got, dtype="Int64")})

    return sentences.groupBy("chunk_id").cogroup(words.select("chunk_id", "word_idx", "word").groupBy("chunk_id")).applyInPandas(run, "chunk_id long, word_idx long, sentence long")


def greedy_cuts(heads: list[int], flags: np.ndarray, start: np.ndarray, end: np.ndarray, most_ms: int, least_ms: int) -> list[int]:
    """Heads of pieces after one round: a piece longer than most_ms is cut before flagged words, where what has gathered
    since the last cut is at least least_ms long."""
    out = []
    for lo, hi in zip(heads, [*heads[1:], len(start)]):
        out.append(lo)
        if end[hi - 1] - start[lo] > most_ms:
            for i in lo + 1 + np.flatnonzero(flags[lo + 1 : hi]):
                if end[i - 1] - start[out[-1]] >= least_ms:
                    out.append(int(i))
    return out


def split_long(words: DataFrame, group: str, most_ms: int = 15000, least_ms: int = 2000, gap_ms: int = 300) -> DataFrame:
    """(chunk_id, word_idx, piece): groups of consecutive words cut while they are longer than most_ms: after pauses, then
    before connectives, then at gaps; the last two leave at least least_ms. Whether a cut may stand before a word is
    worked out per row; only the running length is a walk over the chunk."""
    w = W.partitionBy("chunk_id").orderBy("word_idx")
    before = F.lag("word").over(w)
    paused = F.coalesce(F.regexp_extract(F.rtrim(before), "(.)$", 1).isin(*PAUSES), F.lit(False))
    joins = F.regexp_replace(F.lower("word"), "^[.,?!]+|[.,?!]+$", "").isin(*CONNECTIVES)
    apart = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms, F.lit(False))
    flagged = words.select("chunk_id", "word_idx", "start_ms", "end_ms", F.coalesce(F.col(group) != F.lag(group).over(w), F.lit(True)).alias("head"), paused.alias("paused"), joins.alias("joins"), apart.alias("apart"))

    def step(c: dict[str, list]) -> dict[str, list]:
        start, end = np.array(c["start_ms"]), np.array(c["end_ms"])
        heads = np.flatnonzero(c["head"]).tolist()
        for flag, least in (("paused", -1), ("joins", least_ms), ("apart", least_ms)):
            heads = greedy_cuts(heads, np.array(c[flag]), start, end, most_ms, least)
        piece = np.zeros(len(start), np.int64)
        piece[heads[1:]] = 1
        return {"chunk_id": c["chunk_id"], "word_idx": c["word_idx"], "piece": np.cumsum(piece)}

    return fold(flagged, ["word_idx"], step, "chunk_id long, word_idx long, piece long")


def _rising(values: list[int]) -> bool:
    return all(map(le, values, islice(values, 1, None)))


def _closest(edges: list[int], t: int, rising: bool) -> int:
    """The first of the edges closest to t; by bisection where they rise."""
    if not edges:
        return t
    if not rising:
        return min(edges, key=lambda e: abs(e - t))
    k = bisect_left(edges, t)
    return edges[k - 1] if k and (k == len(edges) or t - edges[k - 1] <= edges[k] - t) else edges[k]


def pieces_of(start: int, end: int, cuts: list[tuple[int, str | None]], edges: list[int], least_ms: int, first: str | None) -> list[tuple[int, int, str | None]]:
    """Parts (start, end, label) of an interval cut at times snapped to the closest edge; a cut carries the label after
    it. Parts under least_ms are not made; fewer than two leave the interval whole."""
    out, at, label = [], start, first
    rising = bool(cuts) and _rising(edges)
    for t, after in cuts:
        t = _closest(edges, t, rising)
        if t - at >= least_ms:
            out.append((at, t, label))
            at, label = t, after
    if end - at >= least_ms:
        out.append((at, end, label))
    return out if len(out) > 1 else [(start, end, first)]


class _Heard:
    """A chunk's words in order, and those that lie in an interval: by bisection where starts and ends rise."""

    def __init__(self, starts: list[int], ends: list[int], words: list[str]):
        self.starts, self.ends, self.words = starts, ends, words
        self.rising = _rising(starts) and _rising(ends)

    def inside(self, a: int, b: int) -> range | list[int]:
        if self.rising:
            return range(bisect_left(self.starts, a), bisect_right(self.ends, b))
        return [i for i, (s, e) in enumerate(zip(self.starts, self.ends)) if s >= a and e <= b]

    def edges(self, a: int, b: int) -> list[int]:
        return [t for i in self.inside(a, b) for t in (self.starts[i], self.ends[i])]

    def text(self, a: int, b: int) -> str:
        return " ".join([self.words[i] for i in self.inside(a, b)])


PARTS = "chunk_id long, segment_id long, part long, start_ms long, end_ms long, speaker string, text string"


def split_segments(segments: DataFrame, cuts: DataFrame, words: DataFrame, least_ms: int = 500, need_words: bool = False) -> DataFrame:
    """(chunk_id, segment_id, part, start_ms, end_ms, speaker, text) of segments cut at times.

    cuts: (chunk_id, segment_id, cut_ms) and, if it has one, speaker of what follows. Text is the words that lie in a
    part. With need_words a split that leaves a part without words is undone. Segments without a chunk or an id are left
    out. A chunk's words and then its segments pass by a task in order; words of chunks without segments are not sent.
    """
    label = F.col("speaker") if "speaker" in cuts.columns else F.lit(None).cast("string")
    listed = cuts.groupBy("chunk_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("cut_ms", label.alias("after")))).alias("cuts"))
    rows = segments.where("chunk_id IS NOT NULL AND segment_id IS NOT NULL").select("chunk_id", "segment_id", "speaker", "start_ms", "end_ms").join(listed, ["chunk_id", "segment_id"], "left")
    meant = rows.select("chunk_id", F.lit(1).alias("kind"), F.col("segment_id").alias("n"), "start_ms", "end_ms", F.col("speaker").alias("said"), F.col("cuts.cut_ms").alias("cut_ms"), F.col("cuts.after").alias("after"))
    spoken = words.join(segments.select("chunk_id").distinct(), "chunk_id", "left_semi")
    spoken = spoken.select("chunk_id", F.lit(0).alias("kind"), F.col("word_idx").alias("n"), "start_ms", "end_ms", F.col("word").alias("said"), F.lit(None).cast("array<long>").alias("cut_ms"), F.lit(None).cast("array<string>").alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heard, known, out = None, ([], [], []), None, []

        def made() -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in PARTS.split(", ")])

        for batch in batches:
            for chunk, kind, n, start, end, said, cut_ms, after in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    now, heard, known = chunk, ([], [], []), None
                if kind == 0:
                    for column, value in zip(heard, (start, end, said)):
                        column.append(value)
                    continue
                known = known or _Heard(*heard)
                parts = pieces_of(start, end, list(zip(cut_ms or [], after or [])), known.edges(start, end) if cut_ms else [], least_ms, said)
                texts = [known.text(a, b) for a, b, _ in parts]
                if need_words and len(parts) > 1 and "" in texts:
                    parts, texts = [(start, end, said)], [known.text(start, end)]
                out += [(chunk, n, k, a, b, speaker or said, text) for k, ((a, b, speaker), text) in enumerate(zip(parts, texts))]
                if len(out) >= 10_000:
                    yield made()
                    out = []
        if out:
            yield made()

    order = ["chunk_id", "kind", "n"]
    return spoken.unionByName(meant).repartition("chunk_id").sortWithinPartitions(*order).mapInArrow(run, PARTS)


def relabel_outliers(turns: DataFrame, centroids: DataFrame, min_ms: int = 500, least: float = 0.4) -> DataFrame:
    """(chunk_id, turn_idx, speaker): a turn unlike every voice known so far becomes SPEAKER_99, 98, ... and is known from
    then on."""

    def run(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        bank, fresh, out = [np.asarray(x) for x in c["centroid"]], 99, []
        for r in t.sort_values("turn_idx").itertuples():
            speaker = r.speaker
            if r.embedding is not None and r.end_ms - r.start_ms >= min_ms and bank:
                v = np.asarray(r.embedding)
                if max(float(v @ b) for b in bank) < least:
                    speaker, fresh = f"SPEAKER_{fresh:02d}", fresh - 1
                    bank.append(v)
            out.append((r.chunk_id, r.turn_idx, speaker))
        return pd.DataFrame(out, columns=["chunk_id", "turn_idx", "speaker"])

    return turns.groupBy("chunk_id").cogroup(centroids.groupBy("chunk_id")).applyInPandas(run, "chunk_id long, turn_idx long, speaker string")


@F.udtf(returnType="pos long, word string")
class TokeniseWords:
    def eval(self, text: str):
        yield from enumerate((text or "").split())


def numbered_lines(responses: DataFrame) -> DataFrame:
    """(batch_id, line_no, line): lines of answers without blanks at their end."""
    return responses.select("batch_id", F.posexplode(F.split("response", "\n")).alias("line_no", "line")).withColumn("line", F.rtrim("line"))


def joined_lines(parts: DataFrame, keys: list[str]) -> DataFrame:
    """What was said under each key, lines in order and joined by blanks."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"])
    return parts.groupBy(*keys).agg(F.trim(F.array_join(said, " ")).alias("said"))


def parse_numbered(responses: DataFrame) -> DataFrame:
    """(batch_id, idx, said) of numbered answers; a line without a number goes on with the one before."""
    w = W.partitionBy("batch_id").orderBy("line_no")
    own = F.when(F.col("line").rlike(NUMBERED_LINE), F.regexp_extract("line", NUMBERED_LINE, 1).cast("long"))
    marked = numbered_lines(responses).withColumn("own", own).withColumn("idx", F.last("own", ignorenulls=True).over(w)).where("idx is not null")
    said = F.when(F.col("own").isNotNull(), F.regexp_extract("line", NUMBERED_LINE, 2)).otherwise(F.trim("line"))
    return joined_lines(marked.withColumn("said", said).where("own is not null OR said <> ''"), ["batch_id", "idx"])


def parse_fields(responses: DataFrame) -> DataFrame:
    """(batch_id, idx, korean, context, emotion, tone) of answers with named fields.

    A number alone on a line opens an entry; text behind a number does so only where no entry is open yet, and is the
    entry's first field line (korean where it names no field). A named line opens a field, a blank line ends it, other
    lines go on with it. Both marks are carried down by window. Fields and entries without text are left out; a number
    that comes twice keeps its last entry.
    """
    w = W.partitionBy("batch_id").orderBy("line_no")
    line, blank = F.col("line"), F.trim("line") == ""
    bare, headed = line.rlike(BARE_NUMBER), line.rlike(NUMBERED_LINE)
    x = numbered_lines(responses).withColumn("headed", headed & ~blank).withColumn("bare", bare & ~blank)
    first = F.min(F.when(F.col("headed") | F.col("bare"), F.col("line_no"))).over(W.partitionBy("batch_id"))
    x = x.withColumn("opens", F.col("bare") | F.coalesce(F.col("headed") & (F.col("line_no") == first), F.lit(False)))
    x = x.withColumn("entry", F.sum(F.col("opens").cast("int")).over(w)).where("entry > 0")
    number: Column = F.coalesce(F.nullif(F.regexp_extract("line", BARE_NUMBER, 1), F.lit("")), F.regexp_extract("line", NUMBERED_LINE, 1)).cast("long")
    body = F.when(F.col("opens"), F.when(F.col("bare"), F.lit("")).otherwise(F.regexp_extract("line", NUMBERED_LINE, 2))).otherwise(line)
    x = x.withColumn("idx", F.last(F.when(F.col("opens"), number), ignorenulls=True).over(w)).withColumn("body", body)
    named = F.col("body").rlike(FIELD_LINE)
    mark = F.when(named, F.lower(F.regexp_extract("body", FIELD_LINE, 1))).when(F.col("opens"), F.when(F.col("body") != "", "korean").otherwise("")).when(F.trim("body") == "", "")
    said = F.trim(F.when(named, F.regexp_extract("body", FIELD_LINE, 2)).otherwise(F.col("body")))
    x = x.withColumn("field", F.last(mark, ignorenulls=True).over(w)).withColumn("said", said).where("field <> ''")
    full = joined_lines(x, ["batch_id", "idx", "entry", "field"]).where("said <> ''")
    wide = full.groupBy("batch_id", "idx", "entry").agg(*[F.max(F.when(F.col("field") == f, F.col("said"))).alias(f) for f in FIELDS])
    return wide.groupBy("batch_id", "idx").agg(F.max_by(F.struct(*FIELDS), "entry").alias("kept")).select("batch_id", "idx", "kept.*")


def choose_k(vectors: DataFrame, most: int = 8, least_score: float = 0.1, seed: int = 1) -> int:
    """Number of speakers with the best silhouette on cosine distance; 1 for under four vectors or poor scores."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    # Every pass of every fit reads the vectors: they are worked out once.
    x = staged(vectors.select("embedding"), "voices").select(array_to_vector("embedding").alias("features"))
    n = x.count()
    if n < 4:
        return 1
    judge = ClusteringEvaluator(distanceMeasure="cosine")
    scores = {k: judge.evaluate(KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(x).transform(x)) for k in range(2, min(most, n - 1) + 1)}
    best = max(scores, key=lambda k: (scores[k], -k))
    return best if scores[best] >= least_score else 1
