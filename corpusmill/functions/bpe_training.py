"""Byte-level BPE training over partitioned tables: no distinct word and no pair but the next few reach the driver.

Words lie in parts by hash. A part is one row: the symbols of its words in one array, a zero after each, and
the words' counts. Pair counts are kept by (pair, part), so they are at once the inverted index from a pair to
the parts that hold it. A round reads the most frequent pairs, chooses as many merges as are certain, and
rewrites the parts that hold them; each such part gives the changes of its pair counts, which are added up
with the counts before. Changes are compacted every `COMPACT` rounds. A round's files are as many as its tasks,
not as its parts, so that listing and opening them does not take longer than the work.

Which merges are certain: candidates come by falling count, ties by the smaller ids. One is taken after others
of the same round if it shares no place with them (none ends where it begins or the other way round: its count
then is what it was) and if its count exceeds whatever their merging can create: a pair (x, ab) has at most the
count of (x, a), a pair (ab, y) that of (b, y), and neither more than (a, b). The result is that of merging one
pair at a time.

Everything lies in a folder that executors share; a lost task reads its part again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.bpe import DRIVER_WORDS, SPECIAL_TOKENS, Bpe, TooManyWords, pretoken_counts, train
from corpusmill.sources.files import exists, file_system, work_folder

#: Words of a part, pairs looked at in a round, merges of a round, rounds whose changes lie side by side.
PART_WORDS, LOOKED_AT, MOST, COMPACT = 200_000, 1024, 256, 12
FORM = "kind string, part int, symbols array<int>, counts array<long>, a int, b int, n long"
ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("symbols", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
Pair = tuple[int, int]


def pair_counts(symbols: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs as one number, their counts) of words laid end to end; weight: the count of the word at each place."""
    at = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
    pairs, which = np.unique(symbols[at].astype(np.int64) << 32 | symbols[at + 1], return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, which, weight[at])
    return pairs, sums


def word_of(symbols: np.ndarray) -> np.ndarray:
    """The number of the word at each place; a word's zero is its own."""
    ends = symbols == 0
    return np.cumsum(ends) - ends


def merged(symbols: np.ndarray, pair: Pair, new: int) -> np.ndarray:
    """The pair's places become one symbol, from left to right where they overlap."""
    at = np.flatnonzero((symbols[:-1] == pair[0]) & (symbols[1:] == pair[1]))
    if not len(at):
        return symbols
    if pair[0] == pair[1]:  # of a run, every other place
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
    out = symbols.copy()
    out[at] = new
    return np.delete(out, at + 1)


def rewritten(symbols: np.ndarray, counts: np.ndarray, merges: list[tuple[Pair, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part after some merges, and the changes of its pair counts: only words that change are counted."""
    word = word_of(symbols)
    touched = np.zeros(len(counts), bool)
    for (a, b), _ in merges:
        touched[word[:-1][(symbols[:-1] == a) & (symbols[1:] == b)]] = True
    before = symbols[touched[word]]
    after = before
    for pair, new in merges:
        after = merged(after, pair, new)
    own = counts[touched]
    old, less = pair_counts(before, own[word_of(before)])
    now, more = pair_counts(after, own[word_of(after)])
    pairs, which = np.unique(np.concatenate([old, now]), return_inverse=True)
    change = np.zeros(len(pairs), np.int64)
    np.add.at(change, which, np.concatenate([-less, more]))
    # the part again: words that didn't change, then those that did; their order has no meaning
    return np.concatenate([symbols[~touched[word]], after]), np.concatenate([counts[~touched], own]), np.stack([pairs, change])[:, change != 0]


def rows(part: int, symbols: np.ndarray, counts: np.ndarray, changes: np.ndarray) -> pa.RecordBatch:
    """The part's row and those of its changes."""
    n = changes.shape[1]
    none = [None] * n
    columns = [["words"] + ["pairs"] * n, [part] * (n + 1), [symbols, *none], [counts, *none], [None, *(changes[0] >> 32).tolist()], [None, *(changes[0] & 0xFFFFFFFF).tolist()], [None, *changes[1].tolist()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def certain(candidates: list[tuple[int, Pair]], room: int, whole: bool) -> list[Pair]:
    """The candidates (count, pair), best first, that can be merged at once. `whole`: no pair but the candidates is left."""
    floor = 0 if whole else candidates[-1][0]
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    for n, (a, b) in reversed(candidates):  # the largest last
        left[b], right[a] = n, n
    taken: list[Pair] = []
    firsts, seconds, made = set(), set(), 0
    for n, (a, b) in candidates[: min(room, MOST)]:
        if taken and (a in seconds or b in firsts or n <= made):
            break
        taken.append((a, b))
        firsts.add(a)
        seconds.add(b)
        made = max(made, min(n, max(left.get(a, 0), right.get(b, 0), floor)))
    return taken


class Training:
    """Tables of one training: parts of words by their newest round, and pair counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.newest: dict[int, int] = {}
        self.changed: list[str] = []
        self.compacted = 0

    def begin(self, words: DataFrame) -> None:
        """words (pretoken, n): one row a distinct word."""
        words.write.parquet(f"{self.folder}/distinct")
        words = self.spark.read.parquet(f"{self.folder}/distinct")
        count = max(self.spark.sparkContext.defaultParallelism, -(-words.count() // PART_WORDS))
        to_id = Bpe().tables()["to_id"]
        symbol = np.array([to_id[b] for b in range(256)], np.int32)
        symbol[255] = 0  # no byte of UTF-8: it ends a word

        def part(key: tuple, table: pa.Table) -> pa.Table:
            coded = b"".join(w + b"\xff" for w in table["pretoken"].cast(pa.binary()).to_pylist())
            symbols = symbol[np.frombuffer(coded, np.uint8)]
            counts = table["n"].to_numpy()
            return pa.Table.from_batches([rows(key[0].as_py(), symbols, counts, np.stack(pair_counts(symbols, counts[word_of(symbols)])))])

        dealt = words.withColumn("part", F.pmod(F.xxhash64("pretoken"), F.lit(count)).cast("int"))
        self.write(dealt.groupBy("part").applyInArrow(part, FORM), 0)
        if exists(self.spark, f"{self.folder}/0/kind=words"):
            self.newest = {r.part: 0 for r in self.spark.read.parquet(f"{self.folder}/0/kind=words").select("part").collect()}

    def write(self, df: DataFrame, number: int) -> None:
        df.write.partitionBy("kind").parquet(f"{self.folder}/{number}")
        self.changed.append(f"{self.folder}/{number}/kind=pairs")

    def pairs(self) -> DataFrame:
        """(a, b, part, n): counts and the changes that aren't added to them yet."""
        held = [path for path in self.changed if exists(self.spark, path)]  # words of one letter have no pairs
        form = "a int, b int, part int, n long"
        return self.spark.read.schema(form).parquet(*held) if held else self.spark.createDataFrame([], form)

    def best(self) -> tuple[list[tuple[int, Pair, list[int]]], bool]:
        """The most frequent pairs (count, pair, parts), and whether there are no others."""
        held = self.pairs().groupBy("a", "b", "part").agg(F.sum("n").alias("n")).filter("n > 0")
        top = held.groupBy("a", "b").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts")).orderBy(F.desc("n"), "a", "b").limit(LOOKED_AT).collect()
        return [(r.n, (r.a, r.b), r.parts) for r in top], len(top) < LOOKED_AT

    def merge(self, merges: list[tuple[Pair, int]], parts: set[int], number: int) -> None:
        """Rewrite the parts that hold the pairs."""
        shipped = list(merges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, symbols, counts in zip(batch.column("part").to_pylist(), batch.column("symbols"), batch.column("counts"), strict=True):
                    yield rows(part, *rewritten(symbols.values.to_numpy(), counts.values.to_numpy(), shipped))

        by_round: dict[int, list[int]] = {}
        for part in parts:
            by_round.setdefault(self.newest[part], []).append(part)
        held = None
        for k, own in by_round.items():
            one = self.spark.read.schema("symbols array<int>, counts array<long>, part int").parquet(f"{self.folder}/{k}/kind=words").filter(F.col("part").isin(own)).select("part", "symbols", "counts")
            held = one if held is None else held.union(one)
        self.write(held.mapInArrow(run, FORM), number)
        self.newest.update(dict.fromkeys(parts, number))
        if len(self.changed) > COMPACT:
            self.compact()

    def compact(self) -> None:
        """Add the changes to the counts: one table of both."""
        self.compacted += 1
        path = f"{self.folder}/counts-{self.compacted}"
        self.pairs().groupBy("a", "b", "part").agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(path)
        self.changed = [path]


def train_partitioned(df: DataFrame, text: str, vocab_size: int = 65536, least: int = 1) -> Bpe:
    """The vocabulary of all pre-tokens that occur `least` times or more, as the one-pair-at-a-time trainer makes it."""
    spark = df.sparkSession
    state = Training(spark, work_folder(spark, "bpe-training"))
    merges: list[Pair] = []
    first = len(SPECIAL_TOKENS) + 256
    try:
        state.begin(pretoken_counts(df, text).filter(F.col("n") >= least))
        number = 0
        while len(merges) < vocab_size - first:
            top, whole = state.best()
            if not top:
                break
            taken = certain([(n, pair) for n, pair, _ in top], vocab_size - first - len(merges), whole)
            holders = {pair: parts for _, pair, parts in top}
            number += 1
            state.merge([(pair, first + len(merges) + i) for i, pair in enumerate(taken)], set().union(*(holders[p] for p in taken)), number)
            merges += taken
    finally:
        fs, p = file_system(spark, state.folder)
        fs.delete(p, True)
    return Bpe(tuple(merges))


def train_any(df: DataFrame, text: str, vocab_size: int = 65536, most_words: int = DRIVER_WORDS) -> Bpe:
    """The vocabulary of any number of distinct pre-tokens: merged on the driver where it may hold them, else over partitioned tables."""
    try:
        return train(df, text, vocab_size, most_words=most_words)
    except TooManyWords:
        return train_partitioned(df, text, vocab_size)
