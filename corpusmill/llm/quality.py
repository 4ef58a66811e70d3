"""Quality classifier: random-indexing word vectors, pooled, under a calibrated two-layer network.

Random indexing gives every word a fixed sparse ternary index vector (drawn from its hash) and learns
its word vector as the sum of the index vectors of its neighbours. A document is the mean of the vectors
of its words and, separately, of its words' shapes (runs of capitals, small letters, digits and each
sign), so that unseen words count too. A two-layer numpy network scores the pooled vectors; one
temperature, fitted on a part kept from training, calibrates its probabilities.

Word counts and neighbour sums are aggregations over the whole texts of all documents. The network is
fitted on the driver on a bounded sample: at most `FIT_ROWS` labels, those with the least hash of the id
(and at most twice as many rows of documents, should ids repeat, by the hash of the text), whose whole
texts are pooled in executors, so that only vectors of fixed length are collected.
Scoring reads whole texts. The model is shipped to all tasks, so its vocabulary has a bound, which is a parameter of
`fit`: of words beyond it only the shape counts (its first eight signs), of shapes beyond it nothing. Labels, lang, source and ids are never inputs of a score.

Nulls: a null text is empty and scored as such (its pooled vectors are zero); rows with a null label or
id are not learned from; a null id is kept and scored. Of repeated labels of one id each counts. Without
labelled rows, or with one class only, each score is the smoothed share of label 1, 0.5 without rows. Words
of one frequency (ties) go by their letters, rows of one hash by id and label. Texts may be of any length.
Other columns are kept, but one named score is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmill.llm.common import Staged, read, small_batches, text_batches

FIT_ROWS = 6_000
#: The vocabulary: the WORDS most frequent words of WORD_LEAST occurrences or more, the SHAPES most frequent shapes.
WORD_LEAST, WORDS, SHAPES = 4, 20_000, 500
DIM, WINDOW, NONZERO = 48, 2, 6
#: Tasks whose sums one group adds up; sums of sums are added up likewise.
FAN, LEVELS = 64, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.01, 1e-3
CACHE, BATCH_BYTES = 400_000, 1 << 20
HELD, CHUNK = 300_000, 256
_SIGNS = {ord(c): sign for sign, ranges in (("A", "AZÀÖØÞ"), ("a", "azßöøÿ"), ("0", "09")) for low, high in zip(ranges[::2], ranges[1::2], strict=True) for c in map(chr, range(ord(low), ord(high) + 1))}
_TWICE = re.compile(r"(.)\1+").sub


def shape(word: str) -> str:
    """A word's runs of capitals, small letters and digits by one sign each; repeated signs once."""
    return _TWICE(r"\1", word.translate(_SIGNS))[:8]


def index_vectors(units: list[str]) -> np.ndarray:
    """Sparse ternary vectors drawn from each unit's hash."""
    import xxhash

    out = np.zeros((len(units), DIM), np.float32)
    for k, unit in enumerate(units):
        rng = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(unit.encode())))
        out[k, rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


class Codes(dict):
    """word -> word row * 2^12 + shape row, worked out once for each word a worker meets; emptied when full."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]) -> None:
        super().__init__()
        self.words, self.shapes = words, shapes

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        code = self[word] = self.words.get(word, 0) << 12 | self.shapes.get(shape(word), 0)
        return code


@dataclass
class Vectors:
    """Row 0 of either table is the zero vector of what is unknown."""

    words: dict[str, int]
    shapes: dict[str, int]
    word_table: np.ndarray
    shape_table: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all words of all texts, and each text's number of words."""
        known = self.__dict__.setdefault("known", Codes(self.words, self.shapes))
        split = [t.split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        return np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes

    def pool(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM + 1), np.float64)
        codes, sizes = self.codes(texts)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        sizes = sizes[full]
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(full)), sizes)
        height = len(self.shape_table)
        shapes = np.bincount(owner * height + (codes & 4095), minlength=len(full) * height).reshape(-1, height)
        own = codes >> 12
        n_known = np.add.reduceat((own > 0).astype(np.int64), starts)
        sums = np.add.reduceat(self.word_table[own], starts, axis=0, dtype=np.float64)
        out[full, :DIM] = sums / np.maximum(n_known, 1)[:, None]
        out[full, DIM : 2 * DIM] = shapes @ self.shape_table / sizes[:, None]
        out[full, -1] = n_known / sizes
        return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, n): partial counts of words; at most about HELD words are held."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"])
        counts.clear()
        return out

    for batch in text_batches(batches, BATCH_BYTES):
        for text in batch.column("text").to_pylist():
            counts.update((text or "").split())
        if len(counts) > HELD:
            yield flush()
    yield flush()


def count_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts (unit, n) to partial counts of shapes: (unit, n)."""
    for batch in batches:
        shapes: Counter = Counter()
        for word, n in zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True):
            shapes[shape(word)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(shapes), pa.string()), pa.array(list(shapes.values()), pa.int64())], names=["unit", "n"])


def neighbour_sums(texts: list[str], vectors: Vectors, index: np.ndarray, word_index: np.ndarray, out: np.ndarray) -> None:
    """Add the index vectors around each word of `texts` to its row of `out`: known words first, then the shapes of the others.

    The tables hold small whole numbers, so that sums over a window fit into a byte.
    """
    n_words = len(vectors.word_table)
    codes, sizes = vectors.codes(texts)
    if not len(codes):
        return
    # WINDOW empty places after each text keep its words from being the next one's neighbours
    place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * WINDOW, sizes)
    each = np.zeros((len(codes) + len(sizes) * WINDOW, DIM), np.int8)
    each[place] = index[codes & 4095] + word_index[codes >> 12]
    around = np.zeros_like(each)
    for d in range(1, WINDOW + 1):
        around[d:] += each[:-d]
        around[:-d] += each[d:]
    rows = np.where(codes > 4095, codes >> 12, n_words + (codes & 4095))
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    out[rows[order[first]]] += np.add.reduceat(around[place[order]], first, axis=0, dtype=np.int32)


def random_indexing(documents: DataFrame, n_words: int = WORDS, n_shapes: int = SHAPES, least: int = WORD_LEAST) -> Vectors:
    """Word and shape vectors learned from all texts. Sums are whole numbers, so their order does not matter."""
    spark = documents.sparkSession
    texts = documents.select("text")
    added = lambda df: df.groupBy("unit").agg(F.sum("n").alias("n"))
    counts = Staged(added(texts.mapInArrow(count_words, "unit string, n long")), "word-counts")
    words = [r.unit for r in counts.read().filter(F.col("n") >= least).orderBy(F.desc("n"), "unit").limit(n_words).collect()]
    occurrences = {r.unit: r.n for r in added(counts.read().mapInArrow(count_shapes, "unit string, n long")).orderBy(F.desc("n"), "unit").limit(n_shapes).collect()}
    counts.drop()
    shapes = list(occurrences)
    out = Vectors({w: k + 1 for k, w in enumerate(words)}, {s: k + 1 for k, s in enumerate(shapes)}, np.zeros((len(words) + 1, DIM), np.float32), np.zeros((len(shapes) + 1, DIM), np.float32))
    index = np.concatenate([np.zeros((1, DIM)), index_vectors(["s" + s for s in shapes])]).astype(np.int8)
    word_index = np.concatenate([np.zeros((1, DIM)), index_vectors(["w" + w for w in words])]).astype(np.int8)
    first_shape, height = len(words) + 1, len(words) + len(shapes) + 2
    shared = spark.sparkContext.broadcast((out, index, word_index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sums = TaskContext.get().partitionId(), np.zeros((height, DIM))
        vectors, *tables = shared.value
        for batch in text_batches(batches, BATCH_BYTES):
            neighbour_sums([t or "" for t in batch.column("text").to_pylist()], vectors, *tables, sums)
        for k in range(0, height, CHUNK):
            part = sums[k : k + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["task", "at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table["sums"])
        return pa.table({"task": table["task"][:1], "at": table["at"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    added_up = texts.mapInArrow(run, "task int, at int, sums binary")
    for _ in range(LEVELS):
        added_up = added_up.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task", "at").applyInArrow(add, "task int, at int, sums binary")
    sums = np.zeros((height, DIM))
    for r in added_up.groupBy("at").applyInArrow(add, "task int, at int, sums binary").collect():  # at most height / CHUNK rows
        part = np.frombuffer(r.sums).reshape(-1, DIM)
        sums[r.at : r.at + len(part)] = part
    shape_sums = sums[first_shape:]
    if words:
        np.add.at(shape_sums, [out.shapes.get(shape(w), 0) for w in words], sums[1:first_shape])
    shape_sums += index * np.array([0, *occurrences.values()])[:, None]
    out.word_table, out.shape_table = sums[:first_shape].astype(np.float32), shape_sums.astype(np.float32)
    for table in (out.word_table, out.shape_table):
        table[0] = 0
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the cross-entropy of four fifths; the temperature minimises that of the other fifth."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    z, t = (x[fit] - net.mean) / net.scale, y[fit]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ params[0] + params[1])
        g = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - t) / len(t)
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * params[0], back.sum(0), h.T @ g + DECAY * params[2], np.array([g.sum()])]
        for p, d, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    if len(held):
        out, t = net.logits(x[held]), y[held]
        loss = lambda temperature: np.mean(np.logaddexp(0, out / temperature) - t * out / temperature)
        net.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
    return net


@dataclass
class Model:
    share: float
    vectors: Vectors | None = None
    network: Network | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.network.scores(self.vectors.pool(texts)) if self.network else np.full(len(texts), self.share)


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, words: int = WORDS, shapes: int = SHAPES, least: int = WORD_LEAST) -> Model:
    """documents (doc_id, text); labels (doc_id, quality). At most `rows` labels and twice as many pooled vectors reach the driver."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "quality")
    seen = {r.quality: r["count"] for r in sample.groupBy("quality").count().collect()}
    if len(seen) < 2:
        return Model((seen.get(1, 0) + 1) / (sum(seen.values()) + 2))
    vectors = random_indexing(documents, words, shapes, least)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, BATCH_BYTES):
            pooled = shared.value.pool(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("name"), batch.column("quality"), pa.array(list(pooled), pa.list_(pa.float64()))], names=["at", "name", "quality", "pooled"])

    named = sample.select("text", F.xxhash64("text").alias("at"), F.sha2(F.col("text").cast("binary"), 256).alias("name"), "quality")
    got = named.mapInArrow(pool, "at long, name string, quality int, pooled array<double>").orderBy("at", "name", "quality").limit(2 * rows).collect()
    y = np.array([r.quality for r in got], float)
    network = train(np.array([r.pooled for r in got]), y)
    return Model(float(y.mean()), vectors, network)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with `score`, in place of a column of this name."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.drop("score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, BATCH_BYTES):
            found = shared.value.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))


def held_out(ids: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % parts == which, F.lit(False))


def learned(spark: SparkSession, sf_dir: str) -> Model:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id"), 3, 1))
    with small_batches(spark):
        return fit(read(spark, sf_dir, "documents"), labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text"), learned(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
