"""Helpers shared by the training-data operators: inputs, staging, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: At most so many keys can hold more rows than `hot_limit` allows.
HOT_KEYS = 10_000
#: For steps over whole texts: bytes of an Arrow batch, rows that a Parquet reader decodes at a time.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share for tables between steps; a folder of the warehouse, which they share too, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpusmill-steps"
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Staged:
    """A table written to the shared folder, so that lineage ends there."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing lazy refers to them any more."""
        remove(self.spark, self.path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads texts a few megabytes at a time, in JVM and worker; the session's values are put back afterwards."""
    before = {key: spark.conf.get(key) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def look_up(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join of a table of about `rows` rows with one that has one row a key and, as `n_`, how many rows of `left` hold it.

    Keys of more than `hot_limit(rows)` rows are answered by a broadcast of at most `HOT_KEYS` rows and null
    keys not at all, so no task gets all rows of one key. `n_` is not in the result.
    """
    limit = hot_limit(rows)
    wanted = [*left.columns, *(c for c in right.columns if c not in (key, "n_"))]
    hot = right.filter((F.col("n_") > limit) & F.col(key).isNotNull()).drop("n_")
    nulls = left.sparkSession.range(1).select(*(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in hot.columns))
    few = hot.union(nulls).withColumnRenamed(key, "hot_key_")
    told = left.join(F.broadcast(few), F.col(key).eqNullSafe(F.col("hot_key_"))).select(*wanted)
    rest = left.filter(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti")
    return told.union(rest.join(right.filter(F.col("n_") <= limit).drop("n_"), key, "left").select(*wanted))


def hot_limit(rows: int) -> int:
    return max(500, rows // HOT_KEYS)


@lru_cache(maxsize=2)
def tokenizer(path: str):  # noqa: ANN201
    """One tokenizer of the tokenizers library per worker and file, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most `limit` bytes of text, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker is used again


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word bytes -> 64-bit hash, computed once for each word a worker meets; emptied when full."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def components(edges: DataFrame, name: str = "components") -> Staged:
    """Connected components of undirected edges (a long, b long): rows (node, component), the smallest node.

    Alternating large-star and small-star rounds. A star's hub is never gathered: its minimum is an
    aggregate, joined back to its edges, a join whose crowded partitions adaptive execution splits. Each
    round is a table in the shared folder, and deleted once the next is written.
    """
    current = Staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def resting(e: DataFrame) -> bool:
        """Whether all are stars: nobody has two parents, no parent has one."""
        parents = e.select(F.col("b").alias("a")).distinct().withColumn("parent", F.lit(True))
        return e.groupBy("a").count().join(parents, "a", "left").filter(F.col("parent") | (F.col("count") > 1)).isEmpty()

    while not resting(current.read()):
        e = current.read()
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        mid = Staged(large, name)
        e = mid.read()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = Staged(small.filter("a <> b").distinct(), name)
        current.drop()
        mid.drop()
        current = after
    e = current.read()
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = Staged(stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), name)
    current.drop()
    return out
