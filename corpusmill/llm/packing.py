"""Packing by best-fit decreasing over a segment tree.

Each document is tokenized once, in a map; its ids are cut into full windows and one rest. Full windows
are sequences by themselves. Rests are dealt by a hash to bins of about `BIN_PIECES`, each packed on its
own: pieces in falling length go to the open window with the tightest sufficient room, found in a
segment tree indexed by remaining capacity. What the last open windows lack is a small, bounded part of
a bin. Only piece lengths are shuffled, no ids.

Ids come from pre-tokens cached per worker; texts outside the plain character ranges, or with special
strings, are encoded whole by the library. Nulls: a null text is empty (its document is the end id
alone); null ids are kept. Repeated rows are packed each. Pieces of one length (ties) go by id, content and
start. Texts may be of any length. Columns besides doc_id and text, whatever their names, are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Staged, latin, read, text_batches, tokenizer

CAPACITY, END_ID, BIN_PIECES, BATCH_BYTES, CACHE = 4096, 2, 40_000, 1 << 20, 900_000
#: Characters of the Basic Latin to Greek and Cyrillic blocks, general punctuation and common CJK.
PLAIN = "[^\\x00-\\u036f\\u0391-\\u03a1\\u03a3-\\u0481\\u048a-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u20ac\\u3001-\\u3003\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5]"
#: The letters and the numbers below U+0100 that lower-cased text can hold.
LETTERS, NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"


class Places(dict):
    """pre-token -> row of the id table; a new one gets the next row and waits to be encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.waiting.append(word)
        return row


class WordIds:
    """Ids of texts under a word-end BPE file: lower case, white space dropped, pre-tokens cached."""

    def __init__(self, path: str) -> None:
        import regex

        self.tokenizer = tokenizer(path)
        self.split_any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        #: The same for characters below U+0100, whose letters and numbers are these.
        self.split_latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+").findall
        #: Composed and case-stable text only: no combining marks, no capitals with odd lower forms.
        self.odd = regex.compile(PLAIN.replace("[^\\x00-\\u036f", "[^\\x00-\\u012f\\u0132-\\u02ff")).search
        self.control = re.compile("[\x1c-\x1f\x85]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.flat, self.starts, self.rows, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.rows + 1 : self.rows + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.rows += len(sizes)

    def learn(self) -> None:
        """Encode the waiting pre-tokens, many to a call: a token that ends a word parts them again."""
        words, self.place.waiting = self.place.waiting, []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids])
            if len(cuts) == len(part) and len(ids) and cuts[-1] == len(ids) - 1:
                self.add(ids, np.diff(cuts, prepend=-1))
            else:
                each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                self.add(np.array([x for ids in each for x in ids], np.uint32), np.array([len(ids) for ids in each], np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > CACHE:
            self.clear()
        out: list[np.ndarray | None] = [None] * len(texts)
        cut: list[int] = []
        found: list[np.ndarray] = []
        row = self.place.__getitem__
        for i, text in enumerate(texts):
            plain = latin(text)
            if not plain and self.odd(text) or self.control(text) or any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                words = (self.split_latin if plain else self.split_any)(text.lower())
                cut.append(i)
                found.append(np.fromiter(map(row, words), np.int64, len(words)))
        self.learn()
        if not cut:
            return out
        at = np.concatenate(found)
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - size), size)]
        last = np.concatenate([[0], ends])[np.cumsum([len(f) for f in found])]
        for i, own in zip(cut, np.split(ids, last[:-1]), strict=True):
            out[i] = own
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker, kept between tasks."""
    return WordIds(path)


def cut_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and the rest of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for batch in text_batches(batches, BATCH_BYTES):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece. The tree's leaves are remaining capacities; a node says whether any open window lies below."""
    size = 1 << capacity.bit_length()
    full = [False] * (2 * size)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # open windows by remaining capacity

    def mark(room: int, on: bool) -> None:
        node = room + size
        full[node] = on
        node >>= 1
        while node:
            now = full[2 * node] or full[2 * node + 1]
            if full[node] == now:
                break
            full[node] = now
            node >>= 1

    def tightest(need: int) -> int:
        """The least remaining capacity of at least `need` that has an open window, or -1."""
        node = need + size
        if full[node]:
            return need
        while node > 1:
            if not node & 1 and full[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if full[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    window, offset, windows = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tightest(need)
        if room < 0:
            own, room, windows = windows, capacity, windows + 1
        else:
            own = stacks[room].pop()
            if not stacks[room]:
                mark(room, False)
        window[k], offset[k] = own, capacity - room
        left = room - need
        if left:
            stacks[left].append(own)
            if len(stacks[left]) == 1:
                mark(left, True)
    return window, offset


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """pieces with sequence_id and offset. Bin b owns the sequence ids from b * 2^40; even ids are mixed, odd ids full windows."""
    pieces = Staged(pieces, "pieces").read()
    bins = max(1, -(-pieces.filter(F.col("length") < capacity).count() // bin_pieces))
    full = pieces.filter(F.col("length") == capacity)
    full = full.select("*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).withColumn("bin", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", F.monotonically_increasing_id()), F.lit(bins)))  # its place in the written table parts repeated rows

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(table["length"].to_numpy(), capacity)
        ids = (window + (table["bin"].to_numpy() << 40)) * 2
        return table.drop(["bin"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return rest.groupBy("bin").applyInArrow(run, PACKED).union(full)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))
