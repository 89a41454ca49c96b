"""Shared helpers of the training-data operators: scratch space, text expressions, word encoding."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. A local session may do without that setting and gets
    a temporary folder; on a cluster its executors could not see one, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local_scratch[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let batches that Spark hands to Python hold a few megabytes of text, where the session keeps Spark's default of 64:
    both sides hold several copies of a batch in every running task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, most)


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the value as decimal text, modulo m."""
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(m))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Pieces(dict):
    """Ids of the pre-tokeniser's pieces, as bytes; unseen ones go to the library's model."""

    def __init__(self, owner: WordEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else "".join(map(self.owner.alphabet.__getitem__, piece.encode()))
        got = self[piece] = self.owner.pack([t.id for t in self.owner.model.tokenize(raw)])
        return got


class _Words(dict):
    """Ids of words between white space, as bytes; very long words are not remembered."""

    def __init__(self, owner: WordEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        got = self.owner.word_ids(word)
        if len(word) <= 64:
            self[word] = got
        return got


class WordEncoder:
    """Encodes whole texts with a file of the tokenizers library, word by word with a memo.

    The vocabulary's normaliser (NFC, white space folding, lower case per character) and pre-tokeniser never
    join across white space, so a text's ids are its words' ids in a row. A new word of Latin letters, digits and
    ASCII symbols is cut into the pre-tokeniser's pieces here; words with any other character go to the library
    whole. The memos are bounded. Result: little-endian unsigned ids, `width` bytes each.

    Of many texts at once (`encode_all`) the pieces are cut on arrays of bytes, each different piece is looked up once, and
    the library's model takes all unseen ones in a row.
    """

    # The pre-tokeniser's alternatives, over letters and numbers below U+0250.
    _LETTERS, _NUMBERS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
    _PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\t\n\r {_LETTERS}{_NUMBERS}]+")
    # Lower case of some of these letters lies elsewhere.
    _FAR = "".join(c for c in map(chr, range(0xA1, 0x250)) if len(c.lower()) > 1 or c.lower() > "ɏ")
    _ODD = re.compile(rf"[^\t\n\r\x20-\x7e\xa1-ɏ]|[{_FAR}]|<\|")
    _SPACE = re.compile(r"[\t\n\r ]+")
    _EVEN = bytes([9, 10, 13, *range(32, 127)])
    _GAP, _LETTER, _NUMBER, _OTHER = range(4)
    _RUN = 1 << 22

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.limit = self.tok.model, limit
        self.pieces, self.words = _Pieces(self), _Words(self)
        self.recent, self.older = {}, {}
        self.width = 2 if self.tok.get_vocab_size() <= 65536 else 4
        self.dtype, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def word_ids(self, word: str) -> bytes:
        if self._ODD.search(word):
            return self.pack(self.tok.encode(word, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, self._PIECES.findall(word.lower())))

    def _odd(self, text: str) -> bool:
        """Whether _ODD occurs; only what is left without common characters is searched."""
        if "<|" in text:
            return True
        rest = text.encode("utf-8", "surrogatepass").translate(None, self._EVEN)
        return bool(rest) and self._ODD.search(rest.decode("utf-8", "surrogatepass")) is not None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for memo in (self.words, self.pieces):
            if len(memo) > self.limit:
                memo.clear()
        words = self._SPACE.split(text) if self._odd(text) else text.lower().split()
        return b"".join(map(self.words.__getitem__, words))

    @cached_property
    def _kinds(self) -> np.ndarray:
        """Kind of each character below U+0250."""
        kinds = np.full(0x250, self._OTHER, np.uint8)
        for kind, these in ((self._GAP, "[\t\n\r ]"), (self._LETTER, f"[{self._LETTERS}]"), (self._NUMBER, f"[{self._NUMBERS}]")):
            kinds[[c for c in range(0x250) if re.match(these, chr(c))]] = kind
        return kinds

    @cached_property
    def _plain(self):
        """The model alone; pieces are what stands between spaces."""
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        plain = Tokenizer(self.model)
        plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return plain

    @cached_property
    def _closes(self) -> np.ndarray:
        """Whether an id is the last one of its piece."""
        closes = np.zeros(self.tok.get_vocab_size(), bool)
        closes[[i for t, i in self.tok.get_vocab().items() if t.endswith(self.model.end_of_word_suffix)]] = True
        return closes

    def _cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of even texts in a row, and where each text's pieces begin and end."""
        low = pc.utf8_lower(pa.array([t + "\n" for t in texts], pa.string()))
        ends = np.frombuffer(low.buffers()[1], np.int32, len(texts) + 1)
        raw = np.frombuffer(low.buffers()[2], np.uint8, int(ends[-1]))
        lead = np.flatnonzero(raw >= 0xC2)
        kind = self._kinds[raw]
        kind[lead] = kind[lead + 1] = self._kinds[(raw[lead].astype(np.int16) & 31) << 6 | raw[lead + 1] & 63]
        starts = kind == self._NUMBER
        starts[0] = True
        starts[1:] |= kind[1:] != kind[:-1]
        starts[lead + 1] = False
        # 's, 't, 'm, 'd, 're, 've and 'll are pieces where no other symbol stands before.
        mark = np.flatnonzero((raw == ord("'")) & starts)
        one, two = raw[mark + 1], raw[np.minimum(mark + 2, len(raw) - 1)]
        short = np.isin(one, list(b"stmd"))
        long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[mark[short | long] + 1] = False
        starts[np.concatenate([mark[short] + 2, mark[long] + 3])] = True
        keep = kind != self._GAP
        at = np.flatnonzero(starts & keep)
        place = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])
        offsets = np.append(place[at], place[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
        return pieces.dictionary_encode(), np.searchsorted(at, ends)

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces. About `limit` pieces are remembered; those not met for long are forgotten first."""
        got = list(map(self.recent.get, pieces))
        lacking = [k for k, ids in enumerate(got) if ids is None]
        new = []
        for k in lacking:
            if (ids := self.older.get(pieces[k])) is None:
                new.append(k)
            else:
                got[k] = self.recent[pieces[k]] = ids
        alphabet = dict(enumerate(self.alphabet)) | {32: " "}
        for i in range(0, len(new), 1 << 14):
            part = new[i : i + (1 << 14)]
            row = b" ".join([pieces[k] for k in part]).decode("latin-1").translate(alphabet)
            ids = np.array(self._plain.encode_batch_fast([row], add_special_tokens=False)[0].ids, self.dtype)
            ends = ((np.flatnonzero(self._closes[ids]) + 1) * self.width).tolist()
            raw = ids.tobytes()
            for k, a, z in zip(part, [0, *ends[:-1]], ends, strict=True):
                got[k] = raw[a:z]
                if len(pieces[k]) <= 64:
                    self.recent[pieces[k]] = got[k]
        if len(self.recent) > self.limit // 2:
            self.recent, self.older = {}, self.recent
        return got

    def _encode_run(self, texts: list[str]) -> list[bytes]:
        pieces, bounds = self._cut(texts)
        known = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(known), self.dtype)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        which = pieces.indices.to_numpy()
        n, first = size[which], (np.cumsum(size) - size)[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (ends[bounds] * self.width).tolist()
        return [ids[a:z] for a, z in zip(cuts, cuts[1:])]

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """What `encode` gives for each text. Odd and very long texts go word by word."""
        out, run, held = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self._RUN or self._odd(text):
                out[k] = self.encode(text)
                continue
            if held + len(text) > self._RUN:
                for i, ids in zip(run, self._encode_run([texts[i] for i in run])):
                    out[i] = ids
                run, held = [], 0
            run.append(k)
            held += len(text)
        if run:
            for i, ids in zip(run, self._encode_run([texts[i] for i in run])):
                out[i] = ids
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, limit: int = 600_000) -> WordEncoder:
    """The Python worker's encoder of a vocabulary file; its memos of at most `limit` words and pieces live as long as the
    worker, or until another limit is asked for."""
    if path not in _encoders or _encoders[path].limit != limit:
        _encoders[path] = WordEncoder(path, limit)
    return _encoders[path]


def release(encoders: bool = True) -> None:
    """Give memory that is free in this process back to the machine, where the C library can; with encoders, also what they
    remember, which only a task that encodes has a use for."""
    import pyarrow

    if encoders:
        _encoders.clear()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that releases memory when it ends: workers are reused, and would keep what a stage took."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
