"""Segmenting and packing as table functions that SQL can call.

    SELECT * FROM token_segments(TABLE(docs), max_len => 1024, bos => 2, eos => 3)
    SELECT * FROM pack_best_fit(TABLE(segments) PARTITION BY (rank, slice) ORDER BY n,
                                corpus => 'documents', max_len => 1024, keep => 'rank,slice')

They are polymorphic: the result has the given table's own columns besides theirs. `register` makes them known
to a session. A partition of pack_best_fit is a packer: Spark deals and sorts its rows as the call says.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusmill.operators.pack import BUFFER, Packer, layout

IDS = ArrayType(IntegerType())


def table_fields(table: AnalyzeArgument, needed: dict[str, DataType | None]) -> StructType:
    """The given table's columns; refused if it is no table or lacks a column."""
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    there = {f.name: f.dataType for f in table.dataType.fields}
    for name, kind in needed.items():
        if name not in there or kind is not None and not (isinstance(there[name], ArrayType) and isinstance(there[name].elementType, (IntegerType, LongType))):
            raise ValueError(f"the table needs a column {name} with an array of ids")
    return table.dataType


def constant(argument: AnalyzeArgument, least: int = 0) -> int:
    if argument.value is None or argument.value < least:
        raise ValueError(f"an argument must be a constant of at least {least}")
    return int(argument.value)


@udtf
class TokenSegments:
    """A table with `tokens`: a row for each segment, with segment_no, inputs and labels in place of tokens."""

    @staticmethod
    def analyze(table: AnalyzeArgument, max_len: AnalyzeArgument, bos: AnalyzeArgument, eos: AnalyzeArgument) -> AnalyzeResult:
        fields = table_fields(table, {"tokens": IDS})
        constant(max_len, 1)
        out = StructType([f for f in fields.fields if f.name != "tokens"])
        return AnalyzeResult(out.add("segment_no", IntegerType()).add("inputs", IDS).add("labels", IDS))

    def eval(self, table: Row, max_len: int, bos: int, eos: int) -> Iterator[tuple]:
        kept = tuple(table[c] for c in table.__fields__ if c != "tokens")
        framed = [bos, *(table["tokens"] or []), eos]
        for number, start in enumerate(range(0, len(framed) - 1, max_len)):
            window = framed[start : start + max_len + 1]
            yield (*kept, number, window[:-1], window[1:])


@udtf
class PackBestFit:
    """A table with `inputs` and `labels`: packed examples of each partition, with the columns to `keep` (equal within a partition)."""

    def __init__(self) -> None:
        self.packer: Packer | None = None
        self.kept: tuple = ()
        self.made = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, corpus: AnalyzeArgument, max_len: AnalyzeArgument, keep: AnalyzeArgument) -> AnalyzeResult:
        fields = table_fields(table, {"inputs": IDS, "labels": IDS})
        constant(max_len, 1)
        own = {f.name: f for f in fields.fields}
        out = StructType([own[c] for c in (keep.value or "").split(",") if c])
        for name in ("inputs", "labels", "positions", "segments"):
            out = out.add(name, IDS) if name != "inputs" else out.add("example_no", LongType()).add(name, IDS)
        return AnalyzeResult(out)

    def shown(self, groups: Iterator[list]) -> Iterator[tuple]:
        for group in groups:
            yield (*self.kept, self.made, *(c.tolist() for c in layout(group, self.max_len, 0)))
            self.made += 1

    def eval(self, table: Row, corpus: str, max_len: int, keep: str) -> Iterator[tuple]:
        if self.packer is None:
            self.packer, self.max_len = Packer(corpus, max_len, BUFFER), max_len
            self.kept = tuple(table[c] for c in (keep or "").split(",") if c)
        yield from self.shown(self.packer.add(list(table["inputs"]), list(table["labels"])))

    def terminate(self) -> Iterator[tuple]:
        if self.packer is not None:
            yield from self.shown(self.packer.rest())


def register(spark: SparkSession) -> None:
    spark.udtf.register("token_segments", TokenSegments)
    spark.udtf.register("pack_best_fit", PackBestFit)
