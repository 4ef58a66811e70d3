"""Endless passes over a corpus as a stream that resumes where it stopped.

The source is a stream of tickets: (pass_index, slice) of one pass after the other, without end. Its offset
is the pass and the place within it, so a stream that is started anew on its checkpoint goes on with the next
slice, and a micro-batch that failed is given the same tickets again. Tickets carry no text; each micro-batch
reads its slices of the corpus, in the seeded order of their pass, by a batch plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import split

SCHEMA = "pass_index int, slice int"


class TicketReader(SimpleDataSourceStreamReader):
    def __init__(self, slices: int, step: int, first: int, last: int | None) -> None:
        self.slices, self.step, self.first, self.last = slices, step, first, last

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pass": self.first, "position": 0}

    def at(self, number: int) -> dict:
        return {"pass": number // self.slices, "position": number % self.slices}

    def number(self, offset: dict) -> int:
        return offset["pass"] * self.slices + offset["position"]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = self.number(start) + self.step
        if self.last is not None:
            end = min(end, max(self.number(start), self.last * self.slices))
        return self.readBetweenOffsets(start, self.at(end)), self.at(end)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([divmod(n, self.slices) for n in range(self.number(start), self.number(end))])

    def commit(self, end: dict) -> None:
        pass


class Tickets(DataSource):
    """Options: slices of a pass, tickets of a micro-batch, the first pass, and the pass before which to end (none: never)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_passes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: object) -> TicketReader:  # noqa: N802
        o = self.options
        last = o.get("last")
        reader = TicketReader(int(o["slices"]), int(o.get("step", 1)), int(o.get("first", 0)), None if last is None else int(last))
        if reader.slices <= 0 or reader.step <= 0:
            raise ValueError("slices and step must be positive")
        return reader


def tickets(spark: SparkSession, slices: int, step: int = 1, first: int = 0, last: int | None = None) -> DataFrame:
    """An endless stream of (pass_index, slice); up to pass `last` where it is given."""
    spark.dataSource.register(Tickets)
    reader = spark.readStream.format("corpus_passes").option("slices", slices).option("step", step).option("first", first)
    return (reader if last is None else reader.option("last", last)).load()


def slices_of(docs: DataFrame, key: str, seed: int, world: int, count: int, wanted: list[tuple[int, int]]) -> DataFrame:
    """The documents of some (pass, slice), with pass_index, shuffle_key, slice and rank; ranks are those of the whole pass."""
    out = None
    for p in sorted({p for p, _ in wanted}):
        ordered = split.slices(split.passes(docs, key, seed, 1, first=p), key, world, count)
        own = ordered.filter(F.col("slice").isin([s for q, s in wanted if q == p]))
        out = own if out is None else out.unionByName(own)
    return out


def run_passes(docs: DataFrame, key: str, seed: int, slices: int, checkpoint: str, each: Callable[[DataFrame, int], None], world: int = 1, step: int = 1, first: int = 0, last: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Give `each` the documents of the next slices and the micro-batch's number, again and again; it may get a batch twice after a failure.

    An empty corpus is refused, as its passes would give nothing for ever.
    """
    if docs.isEmpty():
        raise ValueError("the corpus is empty: repeated passes would give nothing")

    def batch(given: DataFrame, number: int) -> None:
        wanted = [(r.pass_index, r.slice) for r in given.collect()]  # `step` tickets at most
        if wanted:
            each(slices_of(docs, key, seed, world, slices, wanted), number)

    writer = tickets(docs.sparkSession, slices, step, first, last).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()
