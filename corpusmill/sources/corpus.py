"""Corpus cases, scans, chained corpora, validated caches and sinks."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.sources.files import file_system, publish, read_json, write_json


@dataclass(frozen=True)
class CorpusCase:
    """Where a corpus lies and which column holds its text. Only cases with limits have the last two."""

    name: str
    genre: str
    language: str
    dataset_path: str
    config_name: str
    split: str
    text_column: str
    sample_count: int | None = None
    max_chars: int | None = None

    def __post_init__(self) -> None:
        for limit in (self.sample_count, self.max_chars):
            if limit is not None and limit <= 0:
                raise ValueError("limits must be positive")

    def fields(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}

    def signature(self) -> str:
        """A short name of all fields, for cache paths."""
        return hashlib.blake2b(json.dumps(self.fields(), sort_keys=True).encode(), digest_size=8).hexdigest()


def cache_path(folder: str, case: CorpusCase, packing: str, max_len: int, samples: int, modulo: int, index: int, given: str = "") -> str:
    # fixed value: the form of the path
    return given or f"{folder}/validation-cache-{case.signature()}-{packing}-len{max_len}-samples{samples}-split{modulo}-{index}"


def scan(spark: SparkSession, case: CorpusCase, form: str = "parquet") -> DataFrame:
    """The corpus' rows; a null text is refused when read."""
    return checked(spark.read.format(form).load(case.dataset_path), case)


def scan_stream(spark: SparkSession, case: CorpusCase, schema: StructType | str, form: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The same corpus as a stream of its files, in the order of their arrival."""
    reader = spark.readStream.format(form).schema(schema)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    return checked(reader.load(case.dataset_path), case)


def checked(df: DataFrame, case: CorpusCase) -> DataFrame:
    text = F.coalesce(F.col(case.text_column), F.raise_error(F.lit(f"null text in corpus {case.name}")).cast("string"))
    return df.withColumn(case.text_column, text)


def reshard(df: DataFrame, shards: int, key: str | None = None) -> DataFrame:
    """The rows in so many parts: by a key's hash, or evenly."""
    if shards <= 0:
        raise ValueError("shards must be positive")
    return df.repartition(shards) if key is None else df.repartition(shards, key)


def file_order() -> list[Column]:
    """Where a row lies: its file and its place there. Every file scan has them, so an order needs no column."""
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def block_shard(shards: int, block_rows: int = 10_000) -> Column:
    """The shard of a row, by the block of rows it lies in: nothing moves, and how files are split into tasks doesn't matter."""
    if shards <= 0:
        raise ValueError("shards must be positive")
    path, row = file_order()
    return F.pmod(F.xxhash64(F.regexp_extract(path, "[^/]+$", 0), F.floor(row / block_rows)), F.lit(shards)).cast("int")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a file scan, in the order of files and of rows in them: by a filter, without a sort or an exchange.

    Rows of files are counted from their footers, in the files' order and no further than n; other files are not
    opened again.
    """
    if n <= 0:
        raise ValueError("the number of rows must be positive")
    path, row = file_order()
    whole, last, left = [], None, n
    for r in df.groupBy(path.alias("path")).agg(F.count("*").alias("n")).orderBy("path").toLocalIterator():
        if r.n >= left:
            last = r.path
            break
        whole.append(r.path)
        left -= r.n
    mine = path.isin(whole) if whole else F.lit(False)
    return df.filter(mine if last is None else mine | ((path == last) & (row < left)))


def take(df: DataFrame, case: CorpusCase, order: list[Column | str] | None = None) -> DataFrame:
    """The first `sample_count` rows in `order`, their texts cut to `max_chars` code points: (text, order_0, ...). Without an order: that of the files."""
    text = F.col(case.text_column) if case.max_chars is None else F.substring(case.text_column, 1, case.max_chars)
    if order is None:
        rows = df if case.sample_count is None else first_rows(df, case.sample_count)
        return rows.select(text.alias("text"), *[o.alias(f"order_{i}") for i, o in enumerate(file_order())])
    out = df.select(text.alias("text"), *[F.col(o).alias(f"order_{i}") if isinstance(o, str) else o.alias(f"order_{i}") for i, o in enumerate(order)])
    return out if case.sample_count is None else out.orderBy(*[f"order_{i}" for i in range(len(order))]).limit(case.sample_count)


def chain(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL in the declared order, which the column case_ordinal keeps."""
    return reduce(DataFrame.unionByName, [p.select("text", "order_0").withColumn("case_ordinal", F.lit(i)) for i, p in enumerate(parts)])


def instruction_chats(df: DataFrame, prompt: str = "text", answer: str = "output", keep: list[str] | None = None) -> DataFrame:
    """Each row as a chat of two messages, and the columns to `keep`; others are left out."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.select(*(keep or []), F.array(message("user", prompt), message("assistant", answer)).alias("messages"))


def read_instructions(spark: SparkSession, case: CorpusCase, prompt: str = "text", answer: str = "output", form: str = "parquet", keep: list[str] | None = None) -> DataFrame:
    """A whole instruction corpus as chats (messages), one for each row, and the columns to `keep`."""
    return instruction_chats(spark.read.format(form).load(case.dataset_path), prompt, answer, keep)


def numbered(examples: DataFrame, n: int) -> DataFrame:
    """The examples numbered below n, in order: no others are sorted."""
    if n <= 0:
        raise ValueError("the number of samples must be positive")
    return examples.filter(F.col("example_no") < n).sort("example_no")


def preview(df: DataFrame, order: list[str], texts: list[str], n: int = 5, chars: int = 100) -> DataFrame:
    """The first n rows, their texts cut to `chars` code points: for people to look at."""
    cut = [F.substring(c, 1, chars).alias(c) if c in texts else F.col(c) for c in df.columns]
    return df.orderBy(*order).limit(n).select(*cut)


def limit_batches(examples: DataFrame, order: list[str], batch: int, batches: int | None) -> DataFrame:
    """What so many batches hold; all where `batches` is None."""
    return examples if batches is None else examples.orderBy(*order).limit(batch * batches)


def write_cache(examples: DataFrame, path: str, num_samples: int, max_len: int, metadata: dict) -> None:
    """Exactly `num_samples` examples, those numbered below it (example_no counts from 0), and their metadata, published by one rename."""
    spark = examples.sparkSession
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    try:
        seen = Observation()
        numbered(examples, num_samples).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{draft}/examples")
        found = seen.get["n"]
        if found < num_samples:
            raise ValueError(f"the corpus gives {found} examples; the cache needs {num_samples}")
        write_json(spark, f"{draft}/metadata.json", dict(sorted((metadata | {"num_samples": num_samples, "max_len": max_len}).items())))
        publish(spark, draft, path)
    finally:
        fs, p = file_system(spark, draft)
        fs.delete(p, True)


def read_cache(spark: SparkSession, path: str, num_samples: int, max_len: int, metadata: dict) -> DataFrame:
    """The cached examples; refused if an expected entry differs. Further entries are allowed."""
    stored = read_json(spark, f"{path}/metadata.json")
    for key, value in (metadata | {"num_samples": num_samples, "max_len": max_len}).items():
        if stored.get(key) != value:
            raise ValueError(f"cache {path}: {key} is {stored.get(key)!r}, not {value!r}")
    return spark.read.parquet(f"{path}/examples")


def write_generations(records: DataFrame, folder: str, step: int) -> None:
    """(sample_index, global_step, prompt, generated_text, generated_token_ids) as JSON lines of one step."""
    records.orderBy("sample_index").write.mode("overwrite").json(f"{folder}/step-{step}")


def write_metrics(metrics: DataFrame, folder: str) -> None:
    metrics.write.mode("append").option("header", True).csv(folder)
