"""A streaming source of growing text files: new whole lines of every file under a folder, as `tail -F` shows them.

Spark's own file source reads a file once, so a log that a process goes on writing needs this one:

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("suffix", ".log").load(folder)

Rows are (log, seq, line): the file's name without its ending, the byte at which the line starts, the line. Lines end at a
carriage return, a newline or both; empty ones are left out. An offset is how far each file, by its path in the folder, has been read,
always behind a line's end: a line that is still being written comes when it is whole. Of a file that is seen for the first time only the
last `tailbytes` bytes are read. A file that has become shorter was replaced and is read from its start. Long ranges are
cut into pieces of `piecebytes` that tasks read side by side; a line belongs to the piece in which it starts. A task reads
the pieces of many short files, up to `piecebytes` and PIECES of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINE = re.compile(rb"[^\r\n]+")
SCHEMA = "log string, seq long, line string"
BLOCK = 1 << 16
PIECES = 500


def opened(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class Piece:
    path: str
    first: int
    start: int
    stop: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.tail, self.piece = int(options.get("tailbytes", 200_000)), int(options.get("piecebytes", 8 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        """Of each file, the byte behind its last whole line; only its last blocks are read for that."""
        from pyarrow import fs

        store, root = opened(self.path)
        root = root.rstrip("/")

        def whole(info) -> int | None:
            with store.open_input_file(info.path) as f:
                at = info.size
                while at > 0:
                    low = max(0, at - BLOCK)
                    block = f.read_at(at - low, low)
                    cut = max(block.rfind(b"\n"), block.rfind(b"\r"))
                    if cut >= 0:
                        return low + cut + 1
                    at = low
            return None

        found = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith(self.suffix) and i.base_name[0] not in "._"]
        with ThreadPoolExecutor(16) as pool:
            return {i.path[len(root) + 1 :]: end for i, end in zip(found, pool.map(whole, found)) if end is not None}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        out, held = [Pieces([])], 0
        for path, stop in sorted(end.items()):
            at = start.get(path, max(0, stop - self.tail))
            if at > stop:
                at = 0
            for a in range(at, stop, self.piece):
                piece = Piece(path, at, a, min(a + self.piece, stop), stop)
                if held + piece.stop - a > self.piece or len(out[-1].pieces) >= PIECES:
                    out.append(Pieces([]))
                    held = 0
                out[-1].pieces.append(piece)
                held += piece.stop - a
        return [p for p in out if p.pieces]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        store, root = opened(self.path)
        for p in partition.pieces:
            yield from self._lines(store, root.rstrip("/"), p)

    def _lines(self, store, root: str, p: Piece) -> Iterator[tuple]:
        name = p.path.rsplit("/", 1)[-1]
        log = name[: name.rfind(".")] if "." in name else name
        with store.open_input_file(f"{root}/{p.path}") as f:
            raw, begin = f.read_at(p.stop - p.start, p.start), p.start
            if p.start > p.first and f.read_at(1, p.start - 1) not in b"\r\n":
                cut = re.search(rb"[\r\n]", raw)
                if cut is None:
                    return
                raw, begin = raw[cut.end() :], p.start + cut.end()
            at = p.stop
            while at < p.end and raw and raw[-1:] not in b"\r\n":
                more = f.read_at(min(BLOCK, p.end - at), at)
                cut = re.search(rb"[\r\n]", more)
                raw, at = raw + (more[: cut.end()] if cut else more), at + (cut.end() if cut else len(more))
                if cut:
                    break
        for m in LINE.finditer(raw):
            yield log, begin + m.start(), m[0].decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark, folder: str, **options):
    """The streaming DataFrame of a folder's growing files."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").options(**options).load(folder)
