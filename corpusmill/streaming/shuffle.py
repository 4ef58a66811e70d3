"""A seeded shuffle of a stream through a bounded exchange buffer.

Each key's first `size` rows fill the buffer's slots; from then on each row takes a drawn slot, and the row
that was there goes out. So order is mixed within about `size` rows, which no sort can do on a stream that
doesn't end. Draws come from the seed, the key and the row's number alone: a stream that is started anew goes
on as if it had not stopped. Slots are rows of state; a micro-batch reads and writes only those it draws.

A row whose column `end` is true is no row of the result: it empties the buffer, in a drawn order, and the
next row begins a new pass with the next draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.streaming.state import needs_rocks_db, plain, records

#: Fixed value: rows of the buffer.
SIZE = 10_000


def drawn(seed: int, key: str, number: int, below: int) -> int:
    """The slot that a row draws."""
    return xxhash.xxh3_64_intdigest(f"{seed}:{key}:{number}".encode()) % below


class ExchangeBuffer(StatefulProcessor):
    """State by slot; `filled` slots of them are in use, `seen` rows have drawn, `sent` have gone out."""

    def __init__(self, columns: list[str], kept: StructType, seed: int, size: int, order: str | None, end: str | None) -> None:
        self.columns, self.kept, self.seed, self.size, self.order, self.end = columns, kept, seed, size, order, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", "seen long, sent long, filled int")
        self.slots = handle.getMapState("slots", "slot int", self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        seen, sent, filled = self.facts.get() if self.facts.exists() else (0, 0, 0)
        name, fresh, out, ended = str(plain(key[0])), {}, [], False

        def taken(slot: int) -> tuple:
            return fresh[slot] if slot in fresh else tuple(self.slots.getValue((slot,)))

        for row in records(rows, [*self.columns, *([self.end] if self.end else [])], self.order):
            if self.end and row[-1]:
                ended = True
                continue
            row = row[: len(self.columns)]
            if filled < self.size:
                fresh[filled] = row
                filled += 1
            else:
                slot = drawn(self.seed, name, seen, self.size)
                out.append(taken(slot))
                fresh[slot] = row
            seen += 1
        if ended:
            for slot in sorted(range(filled), key=lambda s: (drawn(self.seed, name, seen + s, 1 << 62), s)):
                out.append(taken(slot))
            seen, filled, fresh = seen + filled, 0, {}
            self.slots.clear()
        for slot, row in fresh.items():
            self.slots.updateValue((slot,), row)
        self.facts.update((seen, sent + len(out), filled))
        yield pd.DataFrame([(*row, sent + k) for k, row in enumerate(out)], columns=[*self.columns, "sent_no"])

    def close(self) -> None:
        pass


def shuffle_stream(rows: DataFrame, key: str, seed: int, size: int = SIZE, order: str | None = None, end: str | None = None) -> DataFrame:
    """The rows in mixed order: their columns (without `end`) and sent_no, the place of a row among its key's."""
    if size <= 0:
        raise ValueError("the buffer must have a slot at least")
    needs_rocks_db(rows.sparkSession)
    kept = StructType([f for f in rows.schema.fields if f.name != end])
    step = ExchangeBuffer(kept.names, kept, seed, size, order, end)
    return rows.groupBy(key).transformWithStateInPandas(step, StructType([*kept.fields, StructField("sent_no", LongType())]), "Append", "None")
