"""Packing of a stream of segments through the same bounded buffer as a batch.

Rows arrive as (rank, inputs, labels); a rank's segments wait in keyed state, BUFFER at most. Each waiting
segment is a row of state by its number: it is put there once, when its micro-batch ends, and taken out once,
when it is packed. Besides them a rank keeps the sizes of what waits, in one short row; what isn't packed
in a micro-batch is neither read nor written again.

A row whose inputs are null ends the rank's pass: what waits is packed, and order keys begin anew; example
numbers go on. Given `idle`, a rank without rows for so long is drained likewise, by a timer; such a stream
never runs out of batches, so it doesn't go with the available-now trigger. A micro-batch's rows of a rank
are taken in the order in which they come, or that of the column `order`, end rows last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.pack import BUFFER, SCHEMA, Packer, layout
from corpusmill.streaming.state import needs_rocks_db, records

COLUMNS = ["rank", "example_no", "inputs", "labels", "positions", "segments"]


class PackSegments(StatefulProcessor):
    def __init__(self, case: str, max_len: int, pad: int, buffer: int, idle: int, order: str | None) -> None:
        self.case, self.max_len, self.pad, self.buffer, self.idle, self.order = case, max_len, pad, buffer, idle, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "next long, made long, sizes array<int>, numbers array<long>")
        self.waiting = handle.getMapState("waiting", "number long", "inputs array<int>, labels array<int>")

    def restored(self) -> tuple[Packer, int]:
        """A packer of the numbers of waiting segments, and how many examples there were."""
        packer = Packer(self.case, self.max_len, self.buffer)
        packer.index, made, sizes, numbers = self.facts.get() if self.facts.exists() else (0, 0, [], [])
        for size, number in zip(sizes, numbers, strict=True):
            packer.hold(size, number, number)
        return packer, made

    def shown(self, rank: int, packer: Packer, made: int, groups: list[list[int]], fresh: dict[int, tuple]) -> pd.DataFrame:
        """Examples of the groups; state is brought up to date: packed segments go, new ones that wait come."""
        rows = []
        for group in groups:
            contents = []
            for number in group:
                own = fresh.pop(number, None)
                if own is None:
                    own = tuple(map(list, self.waiting.getValue((number,))))
                    self.waiting.removeKey((number,))
                contents.append(own)
            rows.append((rank, made + len(rows), *(c.tolist() for c in layout(contents, self.max_len, self.pad))))
        for number, content in fresh.items():
            self.waiting.updateValue((number,), content)
        held = packer.held
        self.facts.update((packer.index, made + len(rows), [s[0] for s in held], [s[2] for s in held]))
        return pd.DataFrame(rows, columns=COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        packer, made = self.restored()
        groups, fresh, ended = [], {}, False
        for inputs, labels in records(rows, ["inputs", "labels"], self.order):
            if inputs is None:
                ended = True
                continue
            fresh[packer.index] = (inputs, labels)
            packer.hold(len(inputs), packer.index, packer.index)
            packer.index += 1
            if len(packer.held) >= self.buffer:
                groups.append(packer.take())
        if ended:
            groups.extend(packer.rest())
        yield self.shown(int(key[0]), packer, made, groups, fresh)
        if ended:
            self.begin_anew()
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if packer.held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def begin_anew(self) -> None:
        _, made, _, _ = self.facts.get()
        self.facts.update((0, made, [], []))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        packer, made = self.restored()
        yield self.shown(int(key[0]), packer, made, list(packer.rest()), {})
        self.begin_anew()

    def close(self) -> None:
        pass


def pack_stream(segments: DataFrame, case: str, max_len: int, pad: int = 0, buffer: int = BUFFER, idle: str | None = None, order: str | None = None) -> DataFrame:
    """Append-mode rows of SCHEMA. The session's state store is set to RocksDB where it is not set."""
    needs_rocks_db(segments.sparkSession)
    milliseconds = 0 if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    step = PackSegments(case, max_len, pad, buffer, milliseconds, order)
    return segments.groupBy("rank").transformWithStateInPandas(step, SCHEMA, "Append", "ProcessingTime" if milliseconds else "None")
