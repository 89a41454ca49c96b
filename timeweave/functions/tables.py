"""Table functions for SQL users: they take a table of lines, dealt out by answer and in order.

    SELECT * FROM parse_numbered(TABLE(lines) PARTITION BY batch_id ORDER BY line_no)

A function sees one answer's lines at a time and keeps only what its open entry said. The column functions in
`operators.refine` do the same work in the JVM; prefer those where SQL syntax is not needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from timeweave.operators.refine import BARE_NUMBER, FIELD_LINE, FIELDS, NUMBERED_LINE

LINES = {"batch_id": (LongType, IntegerType), "line_no": (LongType, IntegerType), "line": (StringType,)}


def _pattern(java: str) -> re.Pattern:
    """A column function's pattern with that engine's reading of classes and line ends."""
    return re.compile(java.replace("(.*)$", "([^\n\r\x85  ]*)\\Z").replace("?$", "?\\Z"), re.ASCII)


def analyze_lines(lines: AnalyzeArgument, out: StructType) -> AnalyzeResult:
    """The result's columns, where the argument is a table that has the three columns."""
    if not lines.isTable:
        raise ValueError("give the lines as a table: TABLE(lines) PARTITION BY batch_id ORDER BY line_no")
    found = {f.name: f.dataType for f in lines.dataType.fields}
    for name, kinds in LINES.items():
        if not isinstance(found.get(name), kinds):
            raise ValueError(f"the table of lines needs a column {name} of type {' or '.join(k().simpleString() for k in kinds)}")
    return AnalyzeResult(out)


class ParseNumbered:
    """(batch_id, idx, said) of numbered answers; a line without a number goes on with the one before."""

    numbered = _pattern(NUMBERED_LINE)

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        return analyze_lines(lines, StructType().add("batch_id", LongType()).add("idx", LongType()).add("said", StringType()))

    def __init__(self) -> None:
        self.batch, self.idx, self.said = None, None, {}

    def eval(self, row) -> None:
        line = (row["line"] or "").rstrip(" ")
        self.batch = row["batch_id"]
        if found := self.numbered.search(line):
            self.idx = int(found[1])
            self.said.setdefault(self.idx, []).append(found[2])
        elif self.idx is not None and line.strip(" "):
            self.said[self.idx].append(line.strip(" "))

    def terminate(self) -> Iterator[tuple]:
        for idx, said in self.said.items():
            yield self.batch, idx, " ".join(said).strip(" ")


class ParseFields:
    """(batch_id, idx, korean, context, emotion, tone) of answers with named fields, as `refine.parse_fields` reads them."""

    bare, numbered, named = _pattern(BARE_NUMBER), _pattern(NUMBERED_LINE), _pattern(FIELD_LINE)

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        out = StructType().add("batch_id", LongType()).add("idx", LongType())
        for name in FIELDS:
            out = out.add(name, StringType())
        return analyze_lines(lines, out)

    def __init__(self) -> None:
        self.batch, self.idx, self.field, self.said, self.kept = None, None, "", {}, {}

    def _close(self) -> None:
        full = {f: text for f, parts in self.said.items() if (text := " ".join(parts).strip(" "))}
        if self.idx is not None and full:
            self.kept[self.idx] = full
        self.said, self.field = {}, ""

    def eval(self, row) -> None:
        self.batch, line = row["batch_id"], (row["line"] or "").rstrip(" ")
        blank, opens = not line.strip(" "), False
        bare = None if blank else self.bare.search(line)
        headed = None if blank or bare or self.idx is not None else self.numbered.search(line)
        if found := bare or headed:
            self._close()
            self.idx, opens = int(found[1]), True
            line = "" if bare else found[2]
        if self.idx is None:
            return
        if named := self.named.search(line):
            self.field, text = named[1].lower(), named[2]
        else:
            text = line
            if opens:
                self.field = "korean" if line else ""
            elif not line.strip(" "):
                self.field = ""
        if self.field:
            self.said.setdefault(self.field, []).append(text.strip(" "))

    def terminate(self) -> Iterator[tuple]:
        self._close()
        for idx, full in self.kept.items():
            yield self.batch, idx, *(full.get(f) for f in FIELDS)


def register(spark: SparkSession) -> None:
    """Make both functions known to the session's SQL."""
    for name, handler in (("parse_numbered", ParseNumbered), ("parse_fields", ParseFields)):
        spark.udtf.register(name, udtf(handler))
