"""Best-fit packing through a bounded buffer, one packer for each rank, or for each slice of a rank.

A packer streams its rows, in order, with at most BUFFER segments in hand. What makes a packer are the
columns `by`: a rank, or a rank's slice of a pass. A slice is a range of the pass' seeded order, so all
packers of a range run in the task that holds it, and there are as many tasks as slices, however few ranks
there are. Ranks and slices are parameters, never the incidental number of partitions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.bpe import Tokenizer, ids_of, unpickled

#: Fixed values of the packing contract: the order key's seed and the buffer's size.
ORDER_SEED, BUFFER = 17, 4096


def order_key(case: str, index: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{ORDER_SEED}:{case}:{index}".encode(), digest_size=8).digest(), "big")


class Packer:
    """Segments in, groups of segments out. The buffer is sorted by length, ties by falling order key: (length, -order key, index, content)."""

    def __init__(self, case: str, max_len: int, buffer: int = BUFFER) -> None:
        self.case, self.max_len, self.limit = case, max_len, buffer
        self.held: list[tuple[int, int, int, object]] = []
        self.index = 0

    def hold(self, size: int, index: int, content: object) -> None:
        if size > self.max_len:
            raise ValueError("a segment is longer than max_len")
        insort(self.held, (size, -order_key(self.case, index), index, content), key=lambda s: s[:3])

    def add(self, inputs: list[int], labels: list[int]) -> Iterator[list[tuple[list[int], list[int]]]]:
        self.hold(len(inputs), self.index, (inputs, labels))
        self.index += 1
        if len(self.held) >= self.limit:
            yield self.take()

    def take(self) -> list[tuple[list[int], list[int]]]:
        room, out = self.max_len, []
        while room and self.held:
            at = bisect_right(self.held, room, key=lambda s: s[0])
            if not at:
                break
            size, _, _, content = self.held.pop(at - 1)
            out.append(content)
            room -= size
        return out

    def rest(self) -> Iterator[list[tuple[list[int], list[int]]]]:
        while self.held:
            yield self.take()


def layout(group: list[tuple[list[int], list[int]]], max_len: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """inputs, labels, positions, segments, padded to max_len."""
    out = [np.full(max_len, v, np.int32) for v in (pad, pad, 0, -1)]
    at = 0
    for k, (inputs, labels) in enumerate(group):
        own = slice(at, at + len(inputs))
        for column, values in zip(out, (inputs, labels, np.arange(len(inputs)), k), strict=True):
            column[own] = values
        at += len(inputs)
    return tuple(out)


ARRAYS = ("inputs", "labels", "positions", "segments")
COLUMNS = "example_no long, " + ", ".join(f"{n} array<int>" for n in ARRAYS)
SCHEMA = f"rank int, {COLUMNS}"
#: What makes a packer where ranks are cut into slices.
SLICED = ("pass_index", "slice", "rank")
ROWS = 256


def pack_rows(rows: Iterable[tuple], case: str, max_len: int, pad: int, buffer: int) -> Iterator[tuple]:
    """Rows (packer, inputs, labels) in order, each packer's in a run."""
    packer, name, made = None, None, 0

    def shown(groups: Iterable[list]) -> Iterator[tuple]:
        nonlocal made
        for group in groups:
            yield (name, made, *layout(group, max_len, pad))
            made += 1

    for own, inputs, labels in rows:
        if packer is None or own != name:
            if packer:
                yield from shown(packer.rest())
            packer, name, made = Packer(case, max_len, buffer), own, 0
        yield from shown(packer.add(inputs, labels))
    if packer:
        yield from shown(packer.rest())


def packed_batches(rows: Iterable[tuple], case: str, max_len: int, pad: int, buffer: int, by: Sequence[str], arrays: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """pack_rows' examples as record batches of ROWS, with those of ARRAYS that are asked for."""
    form = pa.schema([*((b, pa.int32()) for b in by), ("example_no", pa.int64()), *((n, pa.list_(pa.int32())) for n in arrays)])
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        ends = pa.array(np.arange(len(held) + 1, dtype=np.int32) * max_len)
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[2 + ARRAYS.index(n)] for r in held]))) for n in arrays]
        facts = [pa.array(c, t) for c, t in zip((*zip(*(r[0] for r in held), strict=True), [r[1] for r in held]), form.types, strict=False)]
        return pa.RecordBatch.from_arrays([*facts, *lists], schema=form)

    for row in pack_rows(rows, case, max_len, pad, buffer):
        held.append(row)
        if len(held) == ROWS:
            yield flush()
            held = []
    if held:
        yield flush()


def shape(by: Sequence[str], arrays: Sequence[str]) -> str:
    return ", ".join([*(f"{b} int" for b in by), "example_no long", *(f"{n} array<int>" for n in arrays)])


def pack(segments: DataFrame, case: str, max_len: int, pad: int = 0, buffer: int = BUFFER, by: Sequence[str] = ("rank",), arrays: Sequence[str] = ARRAYS) -> DataFrame:
    """segments (by, inputs, labels), each packer's in one task and in order: rows of `by`, example_no and `arrays`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                names = zip(*(batch.column(b).to_pylist() for b in by), strict=True)
                parts = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("inputs"), batch.column("labels"))]
                for k, name in enumerate(names):
                    yield (name, *(values[ends[k] : ends[k + 1]].copy() for values, ends in parts))

        yield from packed_batches(rows(), case, max_len, pad, buffer, by, arrays)

    return segments.select(*[F.col(b).cast("int").alias(b) for b in by], "inputs", "labels").mapInArrow(run, shape(by, arrays))


def pack_texts(docs: DataFrame, tokenizer: Tokenizer, case: str, max_len: int, bos: int, eos: int, pad: int = 0, buffer: int = BUFFER, by: Sequence[str] = ("rank",), arrays: Sequence[str] = ARRAYS) -> DataFrame:
    """docs (by, text), each packer's in one task and in order: the same as pack() makes of their segments.

    A text becomes ids and segments where it is packed, so ids don't go to and fro between the task and its
    Python worker; a worker holds a batch of texts, the ids of one and a packer's buffer. A null text has no segment.
    """
    if max_len <= 0:
        raise ValueError("max_len must be positive")
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = unpickled(shared.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                names = zip(*(batch.column(b).to_pylist() for b in by), strict=True)
                for name, text in zip(names, batch.column("text"), strict=True):
                    if not text.is_valid:
                        continue
                    framed = np.concatenate([[bos], ids_of(one, text.as_py()), [eos]]).astype(np.int32)
                    for start in range(0, len(framed) - 1, max_len):
                        window = framed[start : start + max_len + 1].copy()
                        yield name, window[:-1], window[1:]

        yield from packed_batches(rows(), case, max_len, pad, buffer, by, arrays)

    return docs.select(*[F.col(b).cast("int").alias(b) for b in by], "text").mapInArrow(run, shape(by, arrays))


def deal(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """Rows of one rank in one partition, a partition for each of `world` ranks, in order: texts move here, before they become ids."""
    return df.repartitionById(world, F.col("rank").cast("int")).sortWithinPartitions("rank", *order)


def in_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows as split.slices leaves them (a pass' slice in one task), brought into the order of their packers: nothing moves."""
    return df.sortWithinPartitions(*SLICED, *order)
