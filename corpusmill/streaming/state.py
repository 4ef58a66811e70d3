"""What stateful streams of this package share: the state store they need, and plain values for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

PROVIDER, ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocks_db(spark: SparkSession) -> None:
    """State that changes row by row lives in RocksDB: the session is told so where it has no state store of its own choice."""
    given = spark.conf.get(PROVIDER, None)
    if given is None or given.endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS_DB)
    elif not given.endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"this stream needs RocksDB for its state, not {given}")


def plain(value: object) -> object:
    """A value as the state store takes it."""
    if isinstance(value, np.ndarray):
        return [plain(v) for v in value.tolist()]
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if isinstance(value, np.generic):
        value = value.item()
    return None if isinstance(value, float) and value != value else value


def records(frames: Iterator[pd.DataFrame], columns: list[str], order: str | None = None) -> Iterator[tuple]:
    """The frames' rows as tuples of plain values, in the order in which they come or that of a column."""
    if order is not None:
        held = list(frames)
        frames = [pd.concat(held).sort_values(order, kind="stable")] if held else []
    for frame in frames:
        for row in zip(*(frame[c] for c in columns), strict=True):
            yield tuple(map(plain, row))
