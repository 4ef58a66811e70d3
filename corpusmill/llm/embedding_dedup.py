"""Embedding near-dedup through a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample, no two of them with a cosine of `SPREAD` or
more, so that a group of near vectors gets one or a few pivots however many rows it has. Each vector is
described by its `PREFIX` nearest pivots in order. It is posted as a home to the inverted lists of its
`HOMES` first pivots and as a probe to those of all its prefix. Two vectors are candidates where one's
home is a pivot of the other's prefix and their prefixes share at least `SHARED` pivots; a pair is taken
in the least list where its two sides meet only, and verified by its cosine in double precision. Every
vector is indexed; the pivots' number grows at most with the square root of the table, between fixed
bounds, so their broadcast is bounded.

Vectors of different lengths have no cosine and are never compared. Each of the `LENGTHS` commonest
lengths has pivots of its own; any other length is one list, whose vectors are all compared.

Vectors that are equal component by component are one class with a count, so copies are never paired.
Lists are cut into blocks of `BLOCK` vectors and compared block by block; a comparison emits one count
per vector and the edges of a spanning forest, never pairs.

Nulls and odd vectors: null, empty or zero vectors and those with null or non-finite components link with
nothing and are their own component. A vector with a null vec_id is compared like any other and gets its
row; it names no component (its component_id is the smallest id reachable, null if there is none) and is
never kept. Repeated rows of one id count as vectors of their own; each gets a row. Vectors may be of any
length. Other columns of the table, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Staged, components, look_up, read

COSINE, PREFIX, HOMES, SHARED, SPREAD, BLOCK, LENGTHS = 0.9, 16, 2, 2, 0.7, 1024, 16
PIVOTS_LEAST, PIVOTS_MOST, PIVOT_SAMPLE = 64, 2048, 8192
LIST = 1 << 12  # lists are numbered length * LIST + pivot


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, key): key is null where the vector links with nothing."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    text = F.concat_ws(",", F.transform("vector", lambda x: (x.cast("double") + 0.0).cast("string")))
    return v.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.sha2(text, 256)))


def choose_pivots(classes: DataFrame, length: int, n: int) -> np.ndarray:
    """Pivots from a bounded sample, by the least hash of the vector: the same at every run. One that is near an earlier one is passed over."""
    count = int(min(PIVOTS_MOST, max(PIVOTS_LEAST, 2 * n**0.5)))
    rows = classes.filter(F.size("vector") == length).orderBy("key").limit(PIVOT_SAMPLE).select("vector").collect()
    p = unit(np.array([r.vector for r in rows], np.float64))
    taken = [0]
    near = p @ p[0]
    while len(taken) < count and (near < SPREAD).any():
        taken.append(int(np.argmax(near < SPREAD)))
        near = np.maximum(near, p @ p[taken[-1]])
    return p[taken]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of the largest numbers would not be finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prefixes(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds `near`: the numbers of the lists of each vector's nearest pivots, in order."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vector")).to_numpy()
        for length in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == length))
            if length in pivots:
                close = unit(pc.list_flatten(part.column("vector")).to_numpy().astype(np.float64).reshape(-1, length)) @ pivots[length].T
                m = min(PREFIX, close.shape[1])
                top = np.argpartition(-close, m - 1, axis=1)[:, :m]
                order = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1)
            else:
                order = np.zeros((part.num_rows, 1), np.int64)
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), part.column("vector"), pa.array(list(order + length * LIST))], names=["node", "copies", "vector", "near"])


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.diff(x, prepend=-1))


def compare(home: tuple, probe: tuple | None, pivot: int, cosine: float, homes: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list's homes against probes (None: among themselves), each (node, copies, unit, near): nodes, linked weight, and the least node each is joined to.

    A pair that meets in several lists counts in the least of them.
    """
    node, copies, x, near = home
    other = probe or home
    link = x @ other[2].T >= cosine
    if probe is None:
        np.fill_diagonal(link, False)
    every = np.concatenate([node, other[0]]) if probe else node
    total, label = np.zeros(len(every), np.int64), every.copy()
    rows, cols = np.nonzero(link)
    if not len(rows):
        return every, total, label
    values = np.unique(np.concatenate([near.ravel(), other[3].ravel()]))
    mine, theirs = (np.searchsorted(values, a) for a in (near, other[3]))
    has_mine, has_theirs = (np.zeros((len(c), len(values)), np.float32) for c in (mine, theirs))
    np.put_along_axis(has_mine, mine, 1, 1)
    np.put_along_axis(has_theirs, theirs, 1, 1)
    keep = np.ones(len(rows), bool)
    here = int(np.searchsorted(values, pivot))
    for k in range(min(homes, near.shape[1])):
        a, b = mine[rows, k], theirs[cols, k]
        keep &= ~((a < here) & (has_theirs[cols, a] > 0)) & ~((b < here) & (has_mine[rows, b] > 0))
    if shared > 1 and near.shape[1] >= shared:
        some, at = np.unique(rows, return_inverse=True)
        keep &= (has_mine[some] @ has_theirs.T)[at, cols] >= shared
    rows, cols = rows[keep], cols[keep]
    if not len(rows):
        return every, total, label
    total[: len(node)] = np.bincount(rows, other[1][cols], len(node))
    by = np.argsort(cols.astype(np.uint16), kind="stable")
    base = len(node) if probe else 0
    if probe:
        total[base:] = np.bincount(cols, copies[rows], len(other[0]))
    # a spanning forest: labels fall to the least node over links until they rest
    row_at, col_at = firsts(rows), firsts(cols[by])
    while True:
        before = label.copy()
        label[rows[row_at]] = np.minimum(label[rows[row_at]], np.minimum.reduceat(label[base + cols], row_at))
        if probe:
            to = base + cols[by][col_at]
            label[to] = np.minimum(label[to], np.minimum.reduceat(label[rows[by]], col_at))
        if (before == label).all():
            return every, total, label


def described(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """classes (node, copies, vector) with `near`."""
    shipped = classes.sparkSession.sparkContext.broadcast(pivots)
    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("node", "copies", "vector").mapInArrow(lambda b: prefixes(b, shipped.value), f"node long, copies long, vector {kind}, near array<long>")


LINKED = "node long, linked long, joined long"


def link_counts(near: DataFrame, lists: int, cosine: float, homes: int, shared: int, block: int = BLOCK) -> DataFrame:
    """(node, linked, joined): partial sums of linked vectors, and a node of the same component. `lists`: how many lists there may be."""
    posted = near.select("*", F.posexplode("near").alias("place", "pivot")).withColumn("home", F.col("place") < homes).drop("place")
    sizes = posted.groupBy("pivot").agg(*[F.ceil(F.count_if(c) / block).cast("int").alias(n) for c, n in ((F.col("home"), "homes_"), (~F.col("home"), "probes_"))])
    blocks = F.broadcast(sizes) if lists <= LENGTHS * PIVOTS_MOST else sizes
    posted = posted.join(blocks, "pivot")
    count = lambda c: F.greatest(F.col(c), F.lit(1))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("node", "pivot"), F.when(F.col("home"), count("homes_")).otherwise(count("probes_"))).cast("int"))
    # cells are (i, j): home block i against home block j, or against probe block -1 - j
    cell = lambda i, j: F.struct(F.lit(i).cast("int").alias("i") if isinstance(i, int) else i.alias("i"), j.cast("int").alias("j"))
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    none = F.array().cast("array<struct<i:int,j:int>>")
    own = F.transform(up_to("homes_"), lambda k: cell(F.least("block", k), F.greatest("block", k)))
    probes = F.when(F.col("probes_") > 0, F.transform(up_to("probes_"), lambda k: cell(F.col("block"), -1 - k))).otherwise(none)
    asked = F.when(F.col("homes_") > 0, F.transform(up_to("homes_"), lambda k: cell(k, -1 - F.col("block")))).otherwise(none)
    cells = posted.withColumn("cell", F.explode(F.when(F.col("home"), F.concat(own, probes)).otherwise(asked)))
    cells = cells.select("node", "copies", "vector", "near", "home", "pivot", "block", "cell.i", "cell.j")
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("node", "linked", "joined")})

    def side(table: pa.Table) -> tuple:
        flat = lambda c: pc.list_flatten(table[c]).to_numpy().reshape(table.num_rows, -1)
        return table["node"].to_numpy(), table["copies"].to_numpy(), unit(flat("vector").astype(np.float64)), flat("near")

    def run(table: pa.Table) -> pa.Table:
        pivot, i, j = (table[c][0].as_py() for c in ("pivot", "i", "j"))
        table = table.sort_by("node")
        home, block = np.array(table["home"].to_pylist()), table["block"].to_numpy()
        left = table.filter(pa.array(home & (block == i)))
        right = None if i == j else table.filter(pa.array(home & (block == j) if j >= 0 else ~home))
        if not left.num_rows or right is not None and not right.num_rows:
            return empty
        nodes, total, label = compare(side(left), None if right is None else side(right), pivot, cosine, homes, shared)
        keep = total > 0
        return pa.table({"node": pa.array(nodes[keep], pa.int64()), "linked": pa.array(total[keep], pa.int64()), "joined": pa.array(label[keep], pa.int64())})

    return cells.groupBy("pivot", "i", "j").applyInArrow(run, LINKED)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, homes: int = HOMES, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each input row."""
    spark = vectors.sparkSession
    staged: list[Staged] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        staged.append(Staged(df, name))
        return staged[-1].read()

    v = keep(keyed(vectors), "vectors")
    found = v.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = keep(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).orderBy(F.desc("n"), "length").limit(LENGTHS + 1).collect()
    if sizes:
        pivots = {r.length: choose_pivots(classes, r.length, r.n) for r in sizes[:LENGTHS]}
        near = keep(described(classes, pivots), "described")
        lists = sum(map(len, pivots.values())) if len(sizes) <= LENGTHS else LENGTHS * PIVOTS_MOST + 1
        linked = keep(link_counts(near, lists, cosine, homes, shared), "linked")
    else:
        linked = spark.createDataFrame([], LINKED)
    sums = linked.groupBy("node").agg(F.sum("linked").alias("linked"))
    staged.append(components(linked.select(F.col("node").alias("a"), F.col("joined").alias("b"))))
    joined = staged[-1].read()
    names = classes.select("node", "rep").join(joined, "node")
    least = names.groupBy("component").agg(F.min("rep").alias("least"))
    reached = look_up(names.select("node", "component"), least.join(names.groupBy("component").agg(F.count("*").alias("n_")), "component"), "component", sum(r.n for r in sizes))
    of_class = classes.select("key", "node", "rep", F.col("copies").alias("n_")).join(sums, "node", "left").join(reached.select("node", F.col("least")), "node", "left")
    of_class = keep(of_class.select("key", "n_", F.col("n_").alias("copies"), "linked", F.coalesce("least", "rep").alias("component")), "of-class")
    out = look_up(v.select("vec_id", "key"), of_class, "key", v.count())
    links = F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    for table in staged[1:-1]:
        table.drop()
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
