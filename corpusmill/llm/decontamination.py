"""Benchmark decontamination by an FM-index per training shard.

A shard is a bounded run of documents. Its text is written in the alphabet of the test phrases: a word
that no phrase holds ends a sequence, since no occurrence can cross it, and sequences shorter than the
shortest phrase are left out. The shard's FM-index is searched backwards for all phrases at once through
its wavelet levels; occurrences are located by sampled suffix positions and merged into spans.

Only the phrases are shipped, in blocks of about `BLOCK_PHRASES` phrases, cut from the items in executors
and kept in the shared folder; the driver holds one block at a time. A benchmark of one block takes one
pass over the documents; a larger one takes several, one after the other, whose spans are merged. No text
is shuffled.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A phrase
is each window of `WINDOW` consecutive words of an item, or the whole of a shorter item that has words.

Nulls: a null text has no words; null doc ids are kept; an item with a null id marks words like any other, but is
not named among the items found. Repeated rows
each get a row; repeated items count once for an id, and items that share a phrase (ties) are all named.
Texts may be of any length: a very long one is a shard by itself, a very long item many parts. Of other
columns, those named like the operator's own (n_words, spans, items) are replaced. Empty tables: no rows,
or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.llm.common import Staged, read, text_batches, text_bytes
from corpusmill.llm.fm_index import FMIndex, joined

#: Stands for a null id within a block of phrases.
NAMELESS = np.iinfo(np.int64).min
WINDOW, BLOCK_PHRASES, PART, SHARD_BYTES = 10, 400_000, 20_000, 4 << 20
#: Bytes of words; A-Z become a-z, other ASCII a space.
TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Phrases:
    """Test phrases as rows of word numbers, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        held: dict[int, list[np.ndarray]] = {}
        for item, line in items:
            own = line.split()
            ids = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in own), np.int32, len(own))
            if len(ids):
                size = min(window, len(ids))
                rows = np.lib.stride_tricks.sliding_window_view(ids, size)
                held.setdefault(size, []).append(np.concatenate([rows, np.full((len(rows), 1), len(held.setdefault(-1, [])), np.int32)], 1))
                held[-1].append(np.int64(NAMELESS if item is None else item))
        names = np.array(held.pop(-1, []), np.int64)
        self.least = min(held, default=window)
        #: For each length: phrases, where each one's items begin, and the items.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted(held):
            rows, which = np.unique(np.concatenate([r[:, :-1] for r in held[length]]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), names[np.concatenate([r[:, -1] for r in held[length]])]], 1), axis=0)
            self.by_length.append((rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))


class Lookup(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def sequences(ids: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(start, numbers) of the runs of known words that are at least `least` long."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
    return [(int(a), ids[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def search_shard(documents: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """For each document: its merged spans of words, and the items whose phrases occur."""
    runs = [(d, at, ids) for d, own in enumerate(documents) for at, ids in sequences(own, phrases.least)]
    spans: list[list[tuple[int, int]]] = [[] for _ in documents]
    items: list[set[int]] = [set() for _ in documents]
    if not runs:
        return spans, items
    text, starts = joined([r[2] for r in runs])
    fm = FMIndex(text)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for patterns, begins, holders in phrases.by_length:
        low, high = fm.search(patterns)
        size = high - low
        total = int(size.sum())
        if not total:
            continue
        which = np.repeat(np.arange(len(patterns)), size)
        at = fm.locate(np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size))
        run = np.searchsorted(starts, at, side="right") - 1
        doc = np.array([runs[r][0] for r in run])
        begin = np.array([runs[r][1] for r in run]) + at - starts[run]
        for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
            items[d].update(holders[begins[p] : begins[p + 1]].tolist())
        hits.append((doc, begin, begin + patterns.shape[1]))
    if hits:
        doc, begin, end = (np.concatenate(x) for x in zip(*hits, strict=True))
        for k in np.lexsort((begin, doc)).tolist():
            own = spans[doc[k]]
            if own and begin[k] <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], int(end[k])))
            else:
                own.append((int(begin[k]), int(end[k])))
    return spans, items


def parts_of(items: DataFrame, window: int) -> DataFrame:
    """(item_id, line, n): each item's words, in parts of PART phrases at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, SHARD_BYTES):
            for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch), strict=True):
                own = words(text)
                total = max(1, len(own) - window + 1) if own else 0
                cuts = range(0, total, PART)
                lines = [b" ".join(own[at : at + PART + window - 1]) for at in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(lines), pa.int64()), pa.array(lines, pa.binary()), pa.array([min(PART, total - at) for at in cuts], pa.int64())], names=["item_id", "line", "n"])

    some = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    return some.mapInArrow(run, "item_id long, line binary, n long")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ADDED = [("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.int64()))]


def scan_block(documents: DataFrame, shipped: Broadcast, names: list[str]) -> DataFrame:
    """The columns `names` of documents, with ADDED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shipped.value
        number = Lookup(phrases.number).__getitem__
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.concat_batches(held) if len(held) > 1 else held[0]
            docs = []
            for text in text_bytes(batch):
                own = words(text)
                docs.append(np.fromiter(map(number, own), np.int64, len(own)))
            spans, found = search_shard(docs, phrases)
            more = [pa.array([len(d) for d in docs], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], ADDED[1][1]), pa.array([sorted(f - {NAMELESS}) for f in found], ADDED[2][1])]
            keep = [batch.column(c) for c in names]
            return pa.RecordBatch.from_arrays([*keep, *more], names=[*names, *(n for n, _ in ADDED)])

        for batch in text_batches(batches, SHARD_BYTES):
            n = batch.get_total_buffer_size() if batch.num_rows == 0 else sum(map(len, text_bytes(batch)))
            if held and size + n > SHARD_BYTES:
                yield flush()
                held, size = [], 0
            held.append(batch)
            size += n
        if held:
            yield flush()

    added = StructType.fromDDL("n_words long, spans array<struct<start:long,end:long>>, items array<long>")
    return documents.mapInArrow(run, StructType([*(documents.schema[n] for n in names), *added.fields]))


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, block_phrases: int = BLOCK_PHRASES, keep_text: bool = False) -> DataFrame:
    """(doc_id[, text and the other columns], n_words, spans, items): spans are of words, end exclusive."""
    spark = documents.sparkSession
    clash = [n for n, _ in ADDED if n in documents.columns]
    documents = documents.drop(*clash) if keep_text else documents.select("doc_id", "text")
    names = documents.columns if keep_text else ["doc_id"]
    parts = Staged(parts_of(items, window), "test-phrases")
    count = max(1, -(-int(parts.read().agg(F.sum("n")).first()[0] or 0) // block_phrases))
    block = F.pmod(F.xxhash64("item_id", "line"), F.lit(count))

    def phrases(k: int) -> Broadcast:
        """One block of about block_phrases + PART phrases."""
        rows = parts.read().filter(block == k).select("item_id", "line").collect()
        return spark.sparkContext.broadcast(Phrases([(r.item_id, bytes(r.line)) for r in rows], window))

    if count == 1:
        out = scan_block(documents, phrases(0), names)
        parts.drop()
        return out
    row = "row_" if "row_" not in names else next(f"row_{k}" for k in range(len(names) + 1) if f"row_{k}" not in names)
    copy = Staged(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    numbered, found = copy.read(), []
    for k in range(count):
        shipped = phrases(k)
        own = scan_block(numbered, shipped, [*names, row] if k == 0 else [row])
        found.append(Staged(own if k == 0 else own.filter(F.size("spans") > 0), "found").read())
        shipped.destroy()
    parts.drop()
    copy.drop()
    first = found[0]
    rest = reduce(DataFrame.union, [p.select(row, "spans", "items") for p in found])
    merged = rest.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda out, x: F.when((F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["end"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))),
    )
    return first.drop("spans", "items").join(merged.select(row, union.alias("spans"), "items"), row).select(*names, "n_words", "spans", "items")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
hits AS (SELECT DISTINCT doc_id, item_id, i, g.size FROM (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)) g JOIN p ON g.phrase = p.phrase AND g.size = p.size),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
