"""Substring dedup: matching statistics by backward search in a compressed FM-index per shard.

Shards are made by content, so that all occurrences of a repeated window meet in one of them. Every
window of `WINDOW` words is given an anchor: the least hash of the `GRAM`-word grams it holds. Windows in
a row that share their anchor make a passage. Equal windows have equal anchors, so

1. texts are hashed; of equal texts only that of the least id is looked at further, the others being
   repeats throughout;
2. anchors are counted, and passages whose anchor lies in one text only are done: they hold no repeat;
3. the other passages are cut from the texts, equal ones become one with the least id, and they are dealt
   by their anchor to shards of about `SHARD_WORDS` words. An anchor with more words than that is cut into
   several blocks: each is a shard, and the passages of all of the anchor's blocks are streamed through it;
4. a shard's FM-index is built over its passages. Of the suffix array it keeps only, in rank order, where
   runs of suffixes that agree in a window begin, and the least id of each run. Passages are streamed
   through it from their ends, one symbol of backward search at a time, at a capped match length. Where
   the statistic reaches the window, the suffix range is the set of all occurrences, and the least id
   among them is read off;
5. the words under windows whose least id is smaller than the document's own are removed.

Keys that many rows share (a text, an anchor, a passage) are looked up by a bounded broadcast, so that no
task gets all of them.

Nulls: a null text has no words. A null doc_id is never a smaller id and none is smaller than it: its
words stay. Rows of one id repeat nothing of each other, their ids being equal; each gets its row. Of equal
passages (ties) the one of the least id is the first. Texts may be of any length; the passages of one
shard are in memory at a time, and a passage that is longer than a shard is one by itself. Columns besides
doc_id and text, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Staged, WordHashes, look_up, mix, partitions, read, text_batches, text_bytes
from corpusmill.llm.fm_index import Bits, FMIndex, joined, prefix_groups

WINDOW, GRAM, SHARD_WORDS, BATCH_BYTES = 50, 16, 400_000, 2 << 20
#: Windows of foreign passages that are searched at a time.
SLICE = 1 << 16
NOWHERE = np.iinfo(np.int64).max


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words (a power of two)."""
    step = 1
    while step < size:
        if len(h) <= step:
            return h[:0]
        h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    return h


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of the runs of `size` values."""
    width = 1
    out = x
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (size - width)], out[size - width :]) if size > width else out


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, first window) of each run of windows that share their anchor."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = sliding_least(grams(h, gram), window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first


SCANNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("anchors", pa.list_(pa.int64()))])


def scanned(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_key, n_words, kept_sha256 if nothing goes, anchors in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches, BATCH_BYTES):
            keys, sizes, kept, found = [], [], [], []
            for text in text_bytes(batch):
                words = text.split()
                line = b" ".join(words)
                digest = hashlib.sha256(line)
                keys.append(digest.digest())
                sizes.append(len(words))
                kept.append(digest.hexdigest())
                found.append(anchors(hashes.of(words), window, gram)[0].view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(kept), pa.array(found, pa.list_(pa.int64()))], schema=SCANNED)

    return documents.mapInArrow(run, "doc_id long, text_key binary, n_words long, kept_sha256 string, anchors array<long>")


def is_text(words: list[bytes], key: bytes) -> bool:
    """Rows of one id may hold different texts: whether this is the one meant."""
    return hashlib.sha256(b" ".join(words)).digest() == key


PASSAGE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("start", pa.int64()), ("shard_key", pa.int64()), ("passage", pa.binary()), ("words", pa.binary()), ("n", pa.int64())])


def passages(suspects: DataFrame, window: int, gram: int) -> DataFrame:
    """suspects (doc_id, text_key, text, shared array<long>): rows (doc_id, text_key, start, shard_key, passage, words, n of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in text_batches(batches, BATCH_BYTES):
            rows: list[tuple] = []
            for doc, key, text, shared in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), text_bytes(batch), batch.column("shared").to_pylist(), strict=True):
                words = text.split()
                if not is_text(words, key):
                    continue
                anchor, first = anchors(hashes.of(words), window, gram)
                ends = np.append(first[1:], len(words) - window + 1)
                own = set(shared)
                for a, at, end in zip(anchor.view(np.int64).tolist(), first.tolist(), ends.tolist(), strict=True):
                    if a in own:
                        line = b" ".join(words[at : end + window - 1])
                        rows.append((doc, key, at, a, xxhash.xxh3_128_digest(line), line, end + window - 1 - at))
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PASSAGE.types, strict=True)], schema=PASSAGE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PASSAGE.types, strict=True)], schema=PASSAGE)

    return suspects.mapInArrow(run, "doc_id long, text_key binary, start long, shard_key long, passage binary, words binary, n long")


class Shard:
    """A compressed index over passages, each with an id, and the least id of each run of equal windows."""

    def __init__(self, lines: list[bytes], ids: np.ndarray, window: int) -> None:
        self.number: dict[bytes, int] = {}
        self.window = window
        self.seqs = [np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in line.split(b" ")), np.int64) for line in lines]
        text, starts = joined(self.seqs)
        self.fm = FMIndex(text, locate=False)
        order, self.fm.order = self.fm.order, None
        shorter, whole = prefix_groups(text, order, window - 1), prefix_groups(text, order, window)
        self.shorter, self.edges = Bits(shorter), np.append(np.flatnonzero(shorter), self.fm.n).astype(np.int32 if self.fm.n < 1 << 31 else np.int64)
        self.whole = Bits(whole)
        self.least = np.minimum.reduceat(ids[np.searchsorted(starts, order, side="right") - 1], np.flatnonzero(whole))

    def least_at(self, low: np.ndarray) -> np.ndarray:
        return self.least[self.whole.rank(low + 1) - 1]

    def statistics(self) -> list[np.ndarray]:
        """For each of its own passages, the least id among the occurrences of each window.

        All are streamed at once, from their ends: a match of the window's length first loses its last
        symbol (its range widens to the run of suffixes equal in one symbol less), then grows at the
        front by a step of backward search.
        """
        cap, fm = self.window, self.fm
        sizes = np.array([len(s) for s in self.seqs], np.int64)
        by = np.argsort(-sizes, kind="stable")
        flat, first = np.concatenate(self.seqs), np.cumsum(sizes) - sizes
        first, ordered = first[by], sizes[by]
        found = np.full(len(flat), NOWHERE)
        low, high, length = np.zeros(len(by), np.int64), np.full(len(by), fm.n, np.int64), np.zeros(len(by), np.int64)
        live = len(by)
        for step in range(int(ordered[0])):
            while live and ordered[live - 1] <= step:
                live -= 1
            at = first[:live] + ordered[:live] - 1 - step
            lo, hi, n = low[:live], high[:live], length[:live]
            full = np.flatnonzero(n == cap)
            if len(full):
                g = self.shorter.rank(lo[full] + 1) - 1
                lo[full], hi[full], n[full] = self.edges[g], self.edges[g + 1], cap - 1
            lo[:], hi[:] = fm.extend(flat[at], lo, hi)
            n += 1
            full = np.flatnonzero(n == cap)
            found[at[full]] = self.least_at(lo[full])
        ends = np.cumsum(sizes)
        return [found[b - n : b - cap + 1] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def search(self, lines: list[bytes]) -> list[np.ndarray]:
        """The same for passages of other shards: NOWHERE where a window does not occur. Equal windows are searched once.

        At most 2 * SLICE windows are laid out at a time, however long a passage is.
        """
        known = self.number.get
        split = [line.split(b" ") for line in lines]
        seqs = [np.fromiter((known(w, 0) for w in own), np.int64, len(own)) for own in split]
        windows = [np.lib.stride_tricks.sliding_window_view(q, self.window) for q in seqs]
        out = [np.full(len(w), NOWHERE) for w in windows]
        cuts = [(k, a, min(a + SLICE, len(w))) for k, w in enumerate(windows) for a in range(0, len(w), SLICE)]
        while cuts:
            mine, size = [], 0
            while cuts and size < SLICE:
                mine.append(cuts.pop())
                size += mine[-1][2] - mine[-1][1]
            part = np.concatenate([windows[k][a:b] for k, a, b in mine])
            fine = np.flatnonzero((part > 0).all(1))
            if not len(fine):
                continue
            rows, back = np.unique(part[fine], axis=0, return_inverse=True)
            low, high = self.fm.search(rows)
            least = np.full(len(rows), NOWHERE)
            hit = np.flatnonzero(low < high)
            least[hit] = self.least_at(low[hit])
            flat = np.full(len(part), NOWHERE)
            flat[fine] = least[back.reshape(-1)]
            at = 0
            for k, a, b in mine:
                out[k][a:b] = flat[at : at + b - a]
                at += b - a
        return out


def shards(distinct: DataFrame, window: int, shard_words: int) -> DataFrame:
    """distinct (passage, shard_key, words, n, least): rows (passage, least_ids)."""
    weights = distinct.groupBy("shard_key").agg(F.sum("n").alias("weight"), F.count("*").alias("n_"))
    facts = weights.agg(F.sum("weight"), F.sum("n_")).first()
    count = max(partitions(distinct.sparkSession), int(facts[0] or 0) // shard_words + 1)
    large = weights.filter(F.col("weight") > shard_words).select("shard_key", "n_", F.ceil(F.col("weight") / shard_words).cast("int").alias("blocks"))
    dealt = look_up(distinct, large, "shard_key", int(facts[1] or 0)) if not large.isEmpty() else distinct.withColumn("blocks", F.lit(None).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("passage"), F.col("blocks")).cast("int"))
    cell = lambda key, i, j: F.struct(key.alias("key"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    several = F.sequence(F.lit(0), F.col("blocks") - 1)
    crossed = F.flatten(F.transform(several, lambda k: F.when(k == F.col("block"), F.array(cell(F.col("shard_key"), k, k))).otherwise(F.array(cell(F.col("shard_key"), F.col("block"), k), cell(F.col("shard_key"), k, F.col("block"))))))
    alone = F.array(cell(F.pmod(F.xxhash64("shard_key"), F.lit(count)), F.lit(-1), F.lit(-1)))
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(crossed)))
    cells = cells.select("passage", "words", "least", F.coalesce("block", F.lit(-1)).alias("block"), "cell.key", "cell.i", "cell.j")

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block = table["block"].to_numpy()
        index = table.filter(pa.array(block == i))
        stream = index if i == j else table.filter(pa.array(block == j))
        found: list[np.ndarray] = []
        if index.num_rows and stream.num_rows:
            shard = Shard(index["words"].to_pylist(), index["least"].to_numpy(), window)
            found = shard.statistics() if i == j else shard.search(stream["words"].to_pylist())
        return pa.table({"passage": stream["passage"] if found else pa.array([], pa.binary()), "least_ids": pa.array(found, pa.list_(pa.int64()))})

    return cells.groupBy("key", "i", "j").applyInArrow(run, "passage binary, least_ids array<long>")


def removed_words(starts: list[int], n: int, window: int) -> np.ndarray:
    """Which of n words lie under a window of these starts."""
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


RESULT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def kept_words(rows: DataFrame, window: int) -> DataFrame:
    """rows (doc_id, text_key, text, starts): (doc_id, text_key, n_words, n_removed, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, BATCH_BYTES):
            out = []
            for doc, key, text, starts in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), text_bytes(batch), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                if not is_text(words, key):
                    continue
                gone = removed_words(starts, len(words), window)
                kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
                out.append((doc, key, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RESULT.types, strict=True)], schema=RESULT)

    return rows.mapInArrow(run, "doc_id long, text_key binary, n_words long, n_removed long, kept_sha256 string")


def repeated(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each document row."""
    staged: list[Staged] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        staged.append(Staged(df, name))
        return staged[-1].read()

    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = keep(scanned(documents, window, gram), "scanned")
    rows = scan.count()

    # 1. one text of each kind, that of the least id
    texts = keep(scan.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_"), F.first("anchors").alias("anchors")).filter("least is not null"), "texts")
    first = texts.filter(F.size("anchors") > 0)

    # 2. anchors of more than one text
    posts = first.select(F.col("least").alias("doc_id"), "text_key", F.explode(F.array_distinct("anchors")).alias("anchor"))
    spread = posts.groupBy("anchor").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.count("*").alias("n_")).filter("a < b")
    shared = look_up(posts, spread.select("anchor", "n_", F.lit(True).alias("met")), "anchor", rows).filter("met")
    own = shared.groupBy("doc_id", "text_key").agg(F.collect_list("anchor").alias("shared"))

    # 3. passages
    suspects = keep(documents.join(own, "doc_id"), "suspects")
    found = keep(passages(suspects, window, gram), "passages")
    distinct = keep(found.groupBy("passage", "shard_key").agg(F.min("doc_id").alias("least"), F.first("words").alias("words"), F.first("n").alias("n"), F.count("*").alias("n_")), "distinct-passages")

    # 4. the least id of each window
    least = keep(shards(distinct.drop("n_"), window, shard_words), "least-ids")
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))
    merged = least.groupBy("passage").agg(F.collect_list("least_ids").alias("all"))
    merged = merged.select("passage", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.element_at("all", 1), both).alias("least_ids"))
    hits = look_up(found.select("passage", "doc_id", "text_key", "start"), merged.join(distinct.select("passage", "n_"), "passage"), "passage", rows)
    starts = F.transform(F.filter(F.transform("least_ids", lambda x, i: F.struct(x.alias("least"), i.cast("long").alias("i"))), lambda x: x["least"] < F.col("doc_id")), lambda x: x["i"] + F.col("start"))
    gone = hits.select("doc_id", "text_key", starts.alias("starts")).filter(F.size("starts") > 0).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    # 5. repeats of a whole text lose all windows, others those found
    changed = kept_words(suspects.select("doc_id", "text_key", "text").join(gone, ["doc_id", "text_key"]), window)
    changed = changed.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.col("n_removed").alias("some"), F.col("kept_sha256").alias("rest"))
    told = keep(texts.select("text_key", "n_", "least").join(changed.withColumnRenamed("doc_id", "least"), ["least", "text_key"], "left"), "told")
    out = look_up(scan.select("doc_id", "text_key", "n_words", "kept_sha256"), told, "text_key", rows)
    whole = (F.col("least") < F.col("doc_id")) & (F.col("n_words") >= window)
    mine = F.col("least") == F.col("doc_id")
    nothing = hashlib.sha256(b"").hexdigest()
    for table in staged[1:-1]:
        table.drop()
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).when(mine, F.coalesce("some", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, F.lit(nothing)).when(mine, F.coalesce("rest", "kept_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(read(spark, sf_dir, "documents"))
