"""Embedding whitening by hierarchical SVD merging.

A summary of some vectors is their number, exact sums of each dimension, and the full-rank SVD of the vectors
centred on their own mean (singular values and right vectors). Two summaries merge without loss: their
factors are stacked, with one more row for the difference of their means, and factored again; no dimension
is dropped. Each task folds its rows block by block into one summary; summaries are then merged `FAN` at a
time, level after level, until one is left. So no task holds more than a block of rows or `FAN` summaries,
and the driver gets one summary: d*d numbers for vectors of d dimensions.

Entries become integers: x = floor(1024*c) + 100000. Components are the right vectors by falling singular
value (eigenvalue s*s/n); the whitened value is the centred vector's projection over the eigenvalue's root.
How far whitened vectors are from unit covariance is measured by summing them up in the same way.

Nulls: vectors that are null, or hold null or non-finite entries, have no rows; null ids are kept. Empty
vectors have no components. Entries beyond +-2**42 count as non-finite, as 1024*c must be an exact integer.
Repeated rows count and are returned each; ties between eigenvalues keep the order of the factorisation.
Vectors of different lengths are whitened apart, each length by its own fit; their models together may have
`MODEL_NUMBERS` numbers. A component without variance (eigenvalue below rounding) has whitened null and takes
no part in identity_error. A deviation beyond a long is null. Other columns are left out. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Staged, read

#: Components shown, summaries merged at a time, numbers in a block of rows, numbers of all models together.
COMPONENTS, FAN, BLOCK_NUMBERS, MODEL_NUMBERS = 8, 16, 1 << 20, 1 << 25
#: An entry's scale and offset.
SCALE, OFFSET = 1024, 100_000
LIMIT = float(1 << 42)


def table_of(kind: pa.DataType) -> tuple[str, pa.Schema]:
    """Summaries as a table: `length` tells whose they are, `sums` are integers or doubles."""
    arrow = pa.schema([("length", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(kind)), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
    return f"length int, node long, n long, sums array<{'long' if kind == pa.int64() else 'double'}>, values array<double>, vectors array<double>", arrow


INTEGERS, DOUBLES = table_of(pa.int64()), table_of(pa.float64())


@dataclass
class Summary:
    """n vectors: the sums of their dimensions (or of a multiple), and the SVD of the centred vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def merged(self, other: Summary) -> Summary:
        """Both: factors stacked, with a row that corrects the means, and factored again."""
        n = self.n + other.n
        gap = self.mean - other.mean
        rows = np.concatenate([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, gap[None] * np.sqrt(self.n / n * other.n)])
        return Summary(n, self.sums + other.sums, *factors(rows))


def factors(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def summary(rows: np.ndarray) -> Summary:
    """Of a block of vectors (integers or doubles)."""
    sums = rows.sum(0)
    return Summary(len(rows), sums, *factors(rows - sums / len(rows)))


def finite(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as one matrix) for each length of vectors whose entries are all finite."""
    lists = batch.column("vector")
    values = lists.flatten()
    numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    for dim in np.unique(sizes[sizes > 0]).tolist():
        which = np.flatnonzero(sizes == dim)
        matrix = numbers[begin[which][:, None] + np.arange(dim)]
        good = (np.abs(matrix) < LIMIT).all(1)  # false for NaN
        if good.any():
            yield which[good], matrix[good]


def scaled(matrix: np.ndarray) -> np.ndarray:
    return np.floor(matrix * SCALE).astype(np.int64) + OFFSET


def rows_of(summaries: dict[int, Summary], node: int, form: pa.Schema) -> pa.RecordBatch:
    rows = [{"length": d, "node": node, "n": s.n, "sums": s.sums.tolist(), "values": s.values.tolist(), "vectors": s.vectors.reshape(-1).tolist()} for d, s in summaries.items()]
    return pa.RecordBatch.from_pylist(rows, schema=form)


def told(row: dict) -> Summary:
    sums = np.array(row["sums"])
    return Summary(row["n"], sums, np.array(row["values"]), np.array(row["vectors"]).reshape(-1, len(sums)))


def summaries(vectors: DataFrame, prepared: Callable[[np.ndarray], np.ndarray], form: tuple[str, pa.Schema]) -> DataFrame:
    """One summary for each task and length of vectors; `prepared` makes what is summed up of a matrix of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        for batch in batches:
            for _, matrix in finite(batch):
                length = matrix.shape[1]
                step = max(64, BLOCK_NUMBERS // length)
                for i in range(0, len(matrix), step):
                    rows = prepared(matrix[i : i + step])
                    if rows.shape[1]:
                        held[length] = held[length].merged(summary(rows)) if length in held else summary(rows)
        yield rows_of(held, TaskContext.get().partitionId(), form[1])

    return vectors.select("vector").mapInArrow(run, form[0])


def merge(parts: DataFrame, form: tuple[str, pa.Schema]) -> dict[int, Summary]:
    """The summary of each length: FAN summaries are merged at a time until one is left."""
    staged = Staged(parts, "whitening")
    level = staged.read()
    last = level.agg(F.max("node")).first()[0] or 0

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        out = told(rows[0])
        for row in rows[1:]:
            out = out.merged(told(row))
        return pa.Table.from_batches([rows_of({key[0].as_py(): out}, key[1].as_py(), form[1])])

    while last:
        last //= FAN
        above = level.withColumn("above", F.floor(F.col("node") / FAN).cast("long"))
        level = above.groupBy("length", "above").applyInArrow(run, form[0])
    out, numbers = {}, 0
    for row in level.toLocalIterator():
        numbers += len(row["vectors"])
        if numbers > MODEL_NUMBERS:
            raise ValueError(f"the models of all lengths have more than {MODEL_NUMBERS} numbers")
        out[row["length"]] = told(row.asDict())
    staged.drop()
    return out


@dataclass
class Model:
    """What whitens vectors of one length."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, s: Summary, most: int) -> Model:
        eigenvalues = s.values**2 / s.n
        nothing = eigenvalues <= (np.finfo(float).eps * max(s.n, len(s.sums)) ** 0.5 * max(s.values.max(initial=0), 1e-300)) ** 2 / s.n
        eigenvalues = np.where(nothing, 0.0, eigenvalues)
        total = eigenvalues.sum()
        return cls(s.n, s.sums, eigenvalues[:most], s.vectors[:most], eigenvalues[:most] / total if total else eigenvalues[:most])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole parts are taken off as integers, so that nothing is lost."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, self.centred(x) @ self.axes.T / np.sqrt(self.eigenvalues), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n*x - S)**2 of each row, exact; None beyond a long."""
        whole = self.sums // self.n
        rest = self.sums - whole * self.n
        near, top = x - whole, 1 << 63
        if float(np.abs(near).max(initial=0) + 1) ** 2 * float(self.n) ** 2 * x.shape[1] < top:
            off = near * self.n - rest
            return (off * off).sum(1).tolist()
        exact = [sum((a * self.n - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in near.tolist()]
        return [v if v < top else None for v in exact]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the vectors (vector: array of numbers)."""
    return {d: Model.of(s, components) for d, s in merge(summaries(vectors, scaled, INTEGERS), INTEGERS).items()}


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each length: the largest absolute entry of the whitened vectors' covariance minus the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def prepared(matrix: np.ndarray) -> np.ndarray:
        model = shared.value[matrix.shape[1]]
        return model.whitened(scaled(matrix))[:, model.eigenvalues > 0]

    out = {}
    for d, s in merge(summaries(vectors, prepared, DOUBLES), DOUBLES).items():
        covariance = s.vectors.T @ (s.values[:, None] ** 2 * s.vectors) / s.n
        out[d] = float(np.abs(covariance - np.eye(len(covariance))).max())
    return out


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
OUT_ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), *((c, pa.float64()) for c in ("whitened", "explained", "identity_error"))])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding): a row for each finite vector and component, with OUT's columns."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    models = fit(vectors, components)
    errors = identity_errors(vectors, models)
    shared = vectors.sparkSession.sparkContext.broadcast((models, errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = shared.value
        for batch in batches:
            for which, matrix in finite(batch):
                model, x = models[matrix.shape[1]], scaled(matrix)
                k = len(model.eigenvalues)
                n = len(which) * k
                ids = batch.column("vec_id").take(pa.array(np.repeat(which, k)))
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(which)), k)))
                whitened = pa.array(model.whitened(x).reshape(-1), from_pandas=True)
                columns = [ids, np.tile(np.arange(1, k + 1), len(which)), np.full(n, model.n), deviation, whitened, np.tile(model.explained, len(which)), pa.array([errors.get(matrix.shape[1])] * n, pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, OUT_ARROW.types, strict=True)], schema=OUT_ARROW)

    return vectors.mapInArrow(run, OUT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
