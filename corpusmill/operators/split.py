"""Content-hash splits, seeded order, ranks and passes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def blake2b64(text: pa.Array) -> pa.Array:
    """The 8-byte BLAKE2b digest of the UTF-8 text as 16 hex digits: their order is the unsigned order."""
    return pa.array([None if t is None else hashlib.blake2b(t, digest_size=8).hexdigest() for t in text.cast(pa.binary()).to_pylist()], pa.string())


def md5_64(text: Column) -> Column:
    """The first 8 bytes of the MD5 digest as 16 hex digits: within the JVM, for corpora that need not agree with BLAKE2b splits."""
    return F.substring(F.md5(text), 1, 16)


#: Content digests by name.
DIGESTS = {"blake2b": blake2b64, "md5": md5_64}


def unsigned(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def bucket(text: Column, modulo: int, digest: str = "blake2b") -> Column:
    """Content-keyed bucket: equal texts always share one."""
    if modulo <= 0:
        raise ValueError("modulo must be positive")
    return (unsigned(DIGESTS[digest](text)) % modulo).cast("int")


def keep_buckets(df: DataFrame, text: str, modulo: int = 1, indexes: Iterable[int] = (0,), digest: str = "blake2b") -> DataFrame:
    wanted = sorted(set(indexes))
    if modulo == 1 and wanted == [0]:
        return df
    return df.filter(bucket(F.col(text), modulo, digest).isin(wanted))


def train_indexes(modulo: int, validation: int) -> tuple[int, ...]:
    if not 0 <= validation < modulo or modulo < 2:
        raise ValueError("the validation bucket must be one of two or more")
    return tuple(i for i in range(modulo) if i != validation)


def label_split(df: DataFrame, text: str, modulo: int, validation: int, digest: str = "blake2b") -> DataFrame:
    """One pass for both sides: a column split of 'validation' or 'train'."""
    return df.withColumn("split", F.when(bucket(F.col(text), modulo, digest) == validation, "validation").otherwise("train"))


def shuffle_key(key: Column, seed: int | Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))


def passes(df: DataFrame, key: str, seed: int, count: int = 1, required: bool = False, first: int = 0) -> DataFrame:
    """`count` passes over the rows from the `first` on, each with its own order: columns pass_index and shuffle_key. A `required` corpus must not be empty."""
    if count <= 0:
        raise ValueError("passes must be positive")
    if required and df.isEmpty():
        raise ValueError("the corpus is empty: repeated passes would give nothing")
    out = df.withColumn("pass_index", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
    return out.withColumn("shuffle_key", shuffle_key(F.col(key), F.lit(seed) + F.col("pass_index")))


def place_in_order(digest: Column, parts: int) -> Column:
    """Which of `parts` equal ranges of a hexadecimal digest's order it falls into."""
    prefix = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(prefix * parts / F.lit(1 << 32)).cast("int")


def slices(df: DataFrame, key: str, world: int, count: int) -> DataFrame:
    """Ranks and slices of ordered passes: columns `slice` (which of `count` ranges of the pass' order) and `rank` (every world-th row of the pass).

    Each range's size is counted from the keys alone, and the offsets (one number a pass and range) are added to
    the row numbers within ranges; so rows move once, to the task of their range, where all of the range's rows
    then are, and no task sees a whole pass.
    """
    by = ["pass_index", "shuffle_key", key]
    ranged = df.withColumn("slice", place_in_order(F.col("shuffle_key"), count))
    if world == 1:
        return ranged.repartition("pass_index", "slice").withColumn("rank", F.lit(0))
    sizes = ranged.groupBy("pass_index", "slice").count()
    before = sizes.withColumn("before_", F.coalesce(F.sum("count").over(Window.partitionBy("pass_index").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("pass_index", "slice").orderBy(*by)) - 1
    out = ranged.withColumn("own_", own).join(F.broadcast(before), ["pass_index", "slice"])
    return out.withColumn("rank", ((F.col("own_") + F.col("before_")) % world).cast("int")).drop("own_", "before_")


def ranks(df: DataFrame, key: str, world: int) -> DataFrame:
    """Every world-th row of each pass' order."""
    return slices(df, key, world, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).drop("slice")


def resumed_seed(seed: int, global_step: int | None) -> int:
    return seed if global_step is None else seed + global_step
