"""MinHash near-dedup with odd sketches.

A document is its set of distinct word shingles. `BANDS` x `ROWS` MinHash samples make the bands; the
same samples, folded into a parity bitmap (odd sketch), let a pair's similarity be read off the XOR of
two bitmaps. A pair that shares a band and whose sketches and sizes allow the threshold is confirmed on
the full sets.

Equal sets are one node, so copies are never paired. In a bucket each member is first paired with one
leader only, the node that meets most others over all its buckets (of near copies, their original),
which grows with the members, not their square. Once the links found so make components, a bucket that
lies within one component is done. The others are compared block by block: pairs of different components
whose odd sketches allow a link are looked at once more by a second parity bitmap, of the whole set and as
wide as the set asks for, whose XOR has at most as many bits as the sets have different elements, so that
it never refuses a link. Of the pairs left, a block emits a spanning forest only, less than one pair a
node; they are confirmed. Buckets in which one of them was refused are compared once more, with all pairs
of different components that the bitmap allows: what it can't tell lies a hair below the threshold (at 0.8,
above 0.79, however long the texts). So no link between components is left out that shares a band and passes the sketch; at the
threshold of 0.8 a pair shares none of the 32 bands with probability 5e-8, and the sketch bound is six
standard deviations away.

Nulls: a null or blank text is empty, of size 0 and linked with nothing. A null doc_id is never linked
and has no component. Rows of one doc_id are one document: they get the same component. Repeated rows and
equal texts (ties) are one node, of the smallest id, and each row gets its result. A text may be of any
length; columns besides doc_id and text, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Staged, WordHashes, components, look_up, mix, read, small_batches, text_batches, text_bytes

BANDS, ROWS, SKETCH_BITS, BLOCK, BATCH_BYTES = 32, 4, 1024, 1024, 1 << 20
#: Word hashes that a worker keeps.
WORDS_KEPT = 100_000
PARITY_LEAST, GROUP_ELEMENTS = 2048, 2_000_000
#: Elements of the sets in a block of a bucket: their bitmaps have a byte an element at most.
BLOCK_ELEMENTS = 32 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, SHIFTS = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def shingle_sets(texts: list[bytes], size: int, hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; with fewer words, of the whole sequence."""
    out = []
    for text in texts:
        h = hashes.of(text.translate(LOWER).split())
        if not len(h):
            out.append(h)
            continue
        k = min(size, len(h))
        s = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        out.append(np.unique(s))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of non-empty sets: a row each."""
    x = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(FACTORS, SHIFTS, strict=True)], 1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(samples), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::ROWS])
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples (each with its place), as 64-bit words."""
    bit = (mix(samples + mix(np.arange(samples.shape[1], dtype=np.uint64))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    counts = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.add.at(counts, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(counts & 1, axis=1, bitorder="little").view(np.uint64)


def set_parity(elements: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set, as 64-bit words: four to eight bits an element, however many there are."""
    bits = max(PARITY_LEAST, 1 << (4 * len(elements) - 1).bit_length())
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(parity: np.ndarray) -> np.ndarray:
    """The bitmaps of half the width."""
    half = parity.shape[-1] // 2
    return parity[..., :half] ^ parity[..., half:]


def most_differing(percent: int) -> int:
    """The bits in which sketches of sets of this similarity differ, with six deviations to spare."""
    n, miss = BANDS * ROWS, 1 - percent / 100
    differing = n * miss + 6 * (n * miss * (1 - miss)) ** 0.5
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing))
    return int(mean + 6 * (2 * differing) / SKETCH_BITS**0.5) + 1


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])


def signed(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch, parity); all but the first two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes(WORDS_KEPT)
        for batch in text_batches(batches, BATCH_BYTES):
            sets = shingle_sets(text_bytes(batch), size, hashes)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            parity: list = [None] * len(sets)
            if full:
                samples = signatures([sets[k] for k in full])
                for k, *own in zip(full, band_keys(samples).view(np.int64), odd_sketches(samples).view(np.int64), strict=True):
                    keys[k] = xxhash.xxh3_128_digest(sets[k].tobytes())
                    bands[k], sketch[k] = own
                    parity[k] = set_parity(sets[k]).view(np.int64)
            columns = [batch.column("doc_id"), [len(s) for s in sets], keys, bands, sketch, parity]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, SIGNED.types, strict=True)], schema=SIGNED)

    return documents.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>, parity array<long>")


def full_sets(documents: DataFrame, size: int) -> DataFrame:
    """(node, elements array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(WORDS_KEPT)
        for batch in text_batches(batches, BATCH_BYTES):
            sets = shingle_sets(text_bytes(batch), size, hashes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "elements"])

    return documents.mapInArrow(run, "node long, elements array<long>")


def may_link(n: Column, m: Column, x: Column, y: Column, percent: int) -> Column:
    differing = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differing <= most_differing(percent))


def confirmed(pairs: DataFrame, documents: DataFrame, percent: int, size: int, sets_at: list[Staged]) -> DataFrame:
    """The pairs (head, member, n, of the member's size) whose full sets reach the threshold: (a, b), a < b.

    Groups hold about GROUP_ELEMENTS elements. A head with more than that in members is repeated in several.
    """
    needed = pairs.select(F.explode(F.array("head", "member")).alias("doc_id")).distinct()
    with small_batches(documents.sparkSession):
        sets_at.append(Staged(full_sets(documents.join(needed, "doc_id", "left_semi"), size), "shingle-sets"))
    sets = sets_at[-1].read()
    weights = pairs.groupBy("head").agg(F.sum("n").alias("weight"), F.count("*").alias("n_")).withColumn("parts", F.ceil(F.col("weight") / GROUP_ELEMENTS).cast("int"))
    sets_at.append(Staged(weights, "heads"))
    weights = sets_at[-1].read()
    facts = weights.agg(F.sum("weight"), F.sum("n_")).first()
    groups = int(facts[0] or 0) // GROUP_ELEMENTS + 1
    group = F.pmod(F.xxhash64("head", "part"), F.lit(groups)).cast("int")
    dealt = look_up(pairs.select("head", "member"), weights.select("head", "parts", "n_"), "head", int(facts[1] or 0))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    members = dealt.join(sets.select(F.col("node").alias("member"), "elements"), "member").select(group.alias("group"), "head", "member", "elements")
    heads = weights.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heads = heads.join(sets.select(F.col("node").alias("head"), "elements"), "head").select(group.alias("of"), F.col("head").alias("name"), F.col("elements").alias("set"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own: dict[int, list[np.ndarray]] = {}
        for head, x in zip(right["name"].to_pylist(), right["set"], strict=True):
            own.setdefault(head, []).append(x.values.to_numpy().view(np.uint64))
        a, b = [], []
        for head, member, y in zip(left["head"].to_pylist(), left["member"].to_pylist(), left["elements"], strict=True):
            y = y.values.to_numpy().view(np.uint64)
            for x in own.get(head, []):
                shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) and len(y) else 0
                if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                    a.append(min(head, member))
                    b.append(max(head, member))
                    break
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("group").cogroup(heads.groupBy("of")).applyInArrow(run, "a long, b long").distinct()


class Block:
    """A cell's side: its nodes, and their bitmaps by width."""

    def __init__(self, table: pa.Table) -> None:
        self.node, self.component, self.n = (table[c].to_numpy() for c in ("node", "component", "n_shingles"))
        self.sketch = table["sketch"].combine_chunks().flatten().to_numpy().reshape(len(self.node), -1).view(np.uint64)
        self.parity = [x.values.to_numpy().view(np.uint64) for x in table["parity"].combine_chunks()]
        self.width = np.array([len(x) for x in self.parity])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_width(self, places: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of nodes that are as wide, or twice as wide and then folded."""
        if width not in self.tables:
            own = np.flatnonzero((self.width == width) | (self.width == 2 * width))
            rows = [self.parity[k] if self.width[k] == width else folded(self.parity[k]) for k in own.tolist()]
            self.tables[width] = own, np.stack(rows)
        own, table = self.tables[width]
        return table[np.searchsorted(own, places)]

    def differing(self, places: np.ndarray, width: int, parity: np.ndarray) -> np.ndarray:
        """How many bits these nodes' bitmaps differ in from one of this width; the wider one is folded."""
        out = np.zeros(len(places), np.int64)
        for wide in np.unique(self.width[places]).tolist():
            at = np.flatnonzero(self.width[places] == wide)
            own = parity
            least = min(wide, width)
            while len(own) > least:
                own = folded(own)
            out[at] = np.bitwise_count(self.at_width(places[at], least) ^ own).sum(1, dtype=np.int64)
        return out


def forest(left: Block, right: Block | None, percent: int, excluded: dict[int, set[int]], every: bool = False) -> tuple[list[int], list[int], list[int]]:
    """Pairs (head, member, size of the member) that may link and join components of a cell, less than one a node; or every one between different components."""
    other = right or left
    names, codes = np.unique(np.concatenate([left.component, other.component]), return_inverse=True)
    mine, theirs = codes[: len(left.node)], codes[len(left.node) :]
    root = np.arange(len(names))
    limit = most_differing(percent)
    heads, members, sizes = [], [], []
    for r in range(len(left.node)):
        n, own = left.n[r], mine[r]
        fine = np.flatnonzero((root[theirs] != root[own]) & (100 * np.minimum(other.n, n) >= percent * np.maximum(other.n, n)))
        if len(fine):
            fine = fine[np.bitwise_count(other.sketch[fine] ^ left.sketch[r]).sum(1, dtype=np.int64) <= limit]
        if len(fine):
            differing = other.differing(fine, int(left.width[r]), left.parity[r])
            fine = fine[differing * (100 + percent) <= (other.n[fine] + n) * (100 - percent)]
        if len(fine) and (bad := excluded.get(int(left.node[r]))):
            fine = fine[~np.isin(other.node[fine], list(bad))]
        if not len(fine):
            continue
        if right is None:  # the other half of the pairs is met from the other side
            fine = fine[other.node[fine] > left.node[r]] if every else fine
        if not every:
            found, first = np.unique(root[theirs[fine]], return_index=True)
            fine = fine[first]
            root[np.isin(root, found)] = root[own]
        for k in fine.tolist():
            heads.append(int(left.node[r]))
            members.append(int(other.node[k]))
            sizes.append(int(other.n[k]))
    return heads, members, sizes


PAIRED = "key long, head long, member long, n long"
PAIRED_ARROW = pa.schema([(c, pa.int64()) for c in ("key", "head", "member", "n")])


def cross_pairs(members: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Rows of PAIRED for members (key, blocks, node, component, n_shingles, sketch, parity, refused) of open buckets."""
    posted = members.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    cells = posted.withColumn("cell", F.explode(other)).select("key", "node", "component", "n_shingles", "sketch", "parity", "refused", "block", "cell.i", "cell.j")

    def run(table: pa.Table) -> pa.Table:
        key, i, j = (table[c][0].as_py() for c in ("key", "i", "j"))
        table = table.sort_by("node")
        excluded: dict[int, set[int]] = {}
        for node, refused in zip(table["node"].to_pylist(), table["refused"].to_pylist(), strict=True):
            for x in refused or ():
                excluded.setdefault(node, set()).add(x)
                excluded.setdefault(x, set()).add(node)
        block = table["block"].to_numpy()
        sides = [Block(t) for t in (table.filter(pa.array(block == k)) for k in sorted({i, j})) if t.num_rows]
        columns = forest(sides[0], sides[1] if i != j else None, percent, excluded, every) if len(sides) == len({i, j}) else ([], [], [])
        return pa.Table.from_arrays([pa.array([key] * len(columns[0]), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], schema=PAIRED_ARROW)

    return cells.groupBy("key", "i", "j").applyInArrow(run, PAIRED)


def near_duplicates(documents: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document row."""
    staged: list[Staged] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        staged.append(Staged(df, name))
        return staged[-1].read()

    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(documents.sparkSession):
        sig = keep(signed(documents, size), "signatures")
    same = sig.filter("set_key is not null").groupBy("set_key")
    classes = keep(same.agg(F.min("doc_id").alias("node"), F.count("*").alias("n_"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "parity")]), "classes")
    nodes = classes.filter("node is not null").drop("set_key", "n_")
    posts = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    rows = BANDS * nodes.count()
    buckets = posts.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n_")).filter("first < last")
    buckets = keep(buckets.select("key", "n_", F.col("n_").alias("n")), "bucket-sizes")
    shared = keep(look_up(posts, buckets, "key", rows).filter("n is not null"), "buckets")  # only posts in buckets of two nodes or more
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = shared.join(degree, "node").groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node"))["node"].alias("head"), F.count("*").alias("n_"))
    leaders = keep(leaders, "leaders")
    shared = shared.select("key", "node", "n_shingles")

    facts = nodes.select(F.col("node").alias("head"), F.col("n_shingles").alias("m"), F.col("sketch").alias("y"))
    star = look_up(shared, leaders, "key", rows).filter("node <> head").select("head", F.col("node").alias("member")).distinct()
    star = keep(star, "star")
    heads = keep(star.groupBy("head").agg(F.count("*").alias("n_")).join(facts, "head").dropDuplicates(["head"]), "heads")
    star = look_up(star, heads, "head", star.count()).join(nodes.select(F.col("node").alias("member"), F.col("n_shingles").alias("n"), F.col("sketch").alias("x")), "member")
    star = keep(star.filter(may_link(F.col("n"), F.col("m"), F.col("x"), F.col("y"), percent)).select("head", "member", "n"), "star-pairs")
    links = keep(confirmed(star, documents, percent, size, staged), "links")
    staged.append(components(links))
    found = staged[-1].read()

    pair = lambda df: df.select(F.least("head", "member").alias("a"), F.greatest("head", "member").alias("b"), "member", "head")
    # a refused pair is listed with its member, so that no list grows with a leader's bucket
    refused = pair(star).join(links, ["a", "b"], "left_anti").select(F.col("member").alias("node"), F.col("head").alias("other"))
    keys = None
    for every in (False, True):
        members = shared.join(found, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
        members = members if keys is None else members.join(keys, "key", "left_semi")
        spread = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_"), F.sum("n_shingles").alias("elements")).filter("low < high")
        blocks = F.greatest(F.ceil(F.col("n_") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
        spread = keep(spread.select("key", "n_", blocks.alias("blocks")), "open-buckets")
        if spread.isEmpty():
            break
        members = look_up(members, spread, "key", rows).filter("blocks is not null").join(nodes.select("node", "sketch", "parity"), "node")
        members = members.join(refused.groupBy("node").agg(F.collect_set("other").alias("refused")), "node", "left")
        crossed = keep(cross_pairs(members, percent, every), "cross-pairs")
        if crossed.isEmpty():
            break
        more = keep(confirmed(crossed.select("head", "member", "n").distinct(), documents, percent, size, staged), "links")
        links = links.union(more)
        staged.append(components(links))
        found = staged[-1].read()
        if every:
            break
        failed = keep(pair(crossed.select("head", "member").distinct()).join(more, ["a", "b"], "left_anti"), "refused")
        if failed.isEmpty():
            break
        keys = crossed.join(failed, ["head", "member"], "left_semi").select("key").distinct()
        refused = refused.union(failed.select(F.col("member").alias("node"), F.col("head").alias("other")))

    named = classes.select("set_key", "n_", F.col("node")).join(found, "node", "left")
    named = keep(named.select("set_key", "n_", F.coalesce("component", "node").alias("found")), "named")
    out = look_up(sig.select("doc_id", "n_shingles", "set_key"), named, "set_key", sig.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    for table in staged[1:-1]:
        table.drop()
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 80, 2)
