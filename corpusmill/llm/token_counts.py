"""Token counts by a map-side two-tier lookup.

Texts are cut into pre-tokens; the token count of a text is the sum of its pre-tokens' lengths, since
byte-level BPE never merges across pre-tokens. The lengths of frequent pre-tokens come in one broadcast
table of at most `FREQUENT` entries, gathered from a bounded sample; the others are encoded in batches
and kept in each worker's cache. No pre-token is ever shuffled. The sample only decides what is fast:
every count is exact.

The library itself encodes a text that holds a character which Python's Unicode version does not assign:
the library and the regular expressions know other versions, and differ there only (tests/llm goes through
all characters). Nulls: a null text is empty; null ids are kept. Repeated rows are counted each; of
equally frequent pre-tokens (ties) any may be in the table, which no count depends on. Texts may be of any
length. Other columns are kept, but those named n_bytes or n_tokens are replaced. An empty table gives no
rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.llm.common import latin, read, text_batches, tokenizer

FREQUENT, SAMPLE_DOCUMENTS, SAMPLE_CHARS = 60_000, 1_500, 20_000
CACHE, BATCH_BYTES = 200_000, 1 << 20


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Any character that has no meaning yet."""
    none = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], none, [False]]).astype(np.int8)))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)) + "]")


class Counts:
    """Token counts of texts under one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        import public_tokenizers
        import regex

        self.tokenizer = tokenizer(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.odd = unassigned().search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent: dict[str, int] = frequent
        self.cache: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str) -> tuple[int, list[str]]:
        """How often a special string occurs, as the library takes it, and the texts between."""
        if not any(s in text for s in self.special):
            return 0, [text]
        import regex

        pieces = regex.split("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), text)
        return len(pieces) - 1, pieces

    def count(self, texts: list[str]) -> list[int]:
        known, cache = self.frequent.get, self.cache
        out, odd, work = [0] * len(texts), [], []
        missing: dict[str, None] = {}
        for i, text in enumerate(texts):
            if not latin(text) and self.odd(text):
                odd.append(i)
                continue
            n, pieces = self.parts(text)
            tokens = [t for p in pieces for t in self.split(p)] if n else self.split(text)
            lengths = list(map(known, tokens))
            rest = [t for t, x in zip(tokens, lengths, strict=True) if x is None] if None in lengths else []
            out[i] = n + sum(filter(None, lengths))
            if rest:
                work.append((i, rest))
                missing.update(dict.fromkeys(t for t in rest if t not in cache))
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = dict.fromkeys(t for _, rest in work for t in rest)
        cache.update(zip(missing, self.encode(list(missing)), strict=True))
        for i, rest in work:
            out[i] += sum(map(cache.__getitem__, rest))
        for i, n in zip(odd, self.encode([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out


def frequent_lengths(documents: DataFrame, path: str, limit: int = FREQUENT, sample: int = SAMPLE_DOCUMENTS) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample: at most `limit`."""
    rows = documents.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).filter("text is not null").limit(sample).collect()
    counter, seen = Counts(path, {}), Counter()
    for row in rows:
        seen.update(counter.split(row.text))
    top = [t for t, _ in seen.most_common(limit)]
    return dict(zip(top, counter.encode(top), strict=True))


def count_tokens(documents: DataFrame, path: str, frequent: dict[str, int] | None = None) -> DataFrame:
    """documents with n_bytes and n_tokens, in place of columns of these names."""
    table = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, path) if frequent is None else frequent)
    kept = documents.drop("n_bytes", "n_tokens")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counts(path, table.value)
        for batch in text_batches(batches, BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(counter.count(texts), pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    counts = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *counts]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
