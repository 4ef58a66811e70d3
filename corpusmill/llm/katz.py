"""Language-model scoring: Katz backoff with Good-Turing discounts, trigrams by default.

Tokens are lower-cased words and an end per document; a token's context is the `order - 1` tokens before it,
the first of a document having a start before it and no longer context. A seen n-gram has its discounted
relative frequency; an unseen one backs off to the n-gram one word shorter, times the weight that makes the
context's probabilities sum to one exactly, and so on down to the unigram and one unknown word, which has
what Good-Turing leaves.

Nothing model-sized is broadcast. Documents are read once into chunks of about `CHUNK_WORDS` tokens with
a vocabulary of their own. Each chunk asks for the counts of its distinct words, then of its distinct
bigrams, then of its distinct trigrams; requests carry the chunk's own training counts, so that the tables of
a level, dealt by hash of the context into buckets of bounded size, are made by adding them up and answered
in place and stored by bucket and chunk; each next level, and the scoring of every token at last, reads the
answers to all levels below. A context that one chunk alone holds is not asked for: that chunk has all its followers. It knows so
from the level below, whose buckets tell which n-grams one chunk alone listed. Contexts with more than
1/`HOT` of all tokens are spread over buckets by the whole n-gram; their sums, at most `HOT` rows a level, are
shared.

A context's sums are sent and kept only where a follower was not seen, as only its weight needs them. The
weight of a context takes the probabilities that its seen followers have one level below. These are
discounted counts times a factor of the shorter context, as a seen n-gram's shorter one is seen too; so
requests carry counts, buckets add up discounted ones, and the chunk multiplies by the factor it knows.

Words are told apart by 64-bit hashes. The buckets of words name them by their places in order of
frequency, so that requests are mostly small numbers. Nulls: a null text is empty (one end token); a document
with a null id is learned from. Repeated rows count and are scored each. Of equally frequent words (ties)
names go by hash, which no score depends on. A text may be of any length; a very long one is a chunk by
itself. Columns besides doc_id, text and those `held` reads are not read. An empty table gives no rows.
With no training tokens every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Staged, WordHashes, mix, read, text_batches, text_bytes
from corpusmill.llm.quality import held_out

CHUNK_WORDS, BUCKET_KEYS, HOT, TOP, BATCH_BYTES = 1_600_000, 800_000, 40_000, 5, 2 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
START, END = 1 << 62, np.uint64(0x5EED0000_00000002)  # a name, a hash


def squeeze(x: np.ndarray) -> bytes:
    """Compressed bytes, those of equal place together."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()) if len(x) else b""


def squeeze_floats(x: np.ndarray) -> bytes:
    """Compressed whole values: many are equal."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(x.tobytes()) if len(x) else b""


def expand_floats(b: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.float64) if b else np.zeros(0)


def expand(b: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    if not b:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.uint64, copy=False), prepend=np.uint64(0))


CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("trained", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("vocab", pa.binary()), ("counts", pa.binary()), ("n_vocab", pa.int64()), ("n_train", pa.int64())])


def chunked(documents: DataFrame, held: Column) -> DataFrame:
    """Rows of CHUNKS. tokens: places in the chunk's vocabulary, which is in order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, base, made = WordHashes(200_000), TaskContext.get().partitionId() << 24, 0
        ids: list = []
        trained: list[bool] = []
        rows: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(r) for r in rows], np.int64)
            vocab, place, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
            by = np.argsort(-n, kind="stable")
            new = np.empty(len(by), np.int64)
            new[by] = np.arange(len(by))
            tokens, vocab = new[place], vocab[by]
            used = np.repeat(np.array(trained), lengths)
            counts = np.bincount(tokens[used], minlength=len(vocab)).astype(np.int64)
            row = [base + made, ids, trained, lengths.tolist(), squeeze(tokens.astype(np.uint32)), squeeze(vocab), squeeze(counts), len(vocab), int(counts.sum())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, CHUNKS.types, strict=True)], schema=CHUNKS)

        for batch in text_batches(batches, BATCH_BYTES):
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), text_bytes(batch), strict=True):
                ids.append(doc)
                trained.append(not out)
                rows.append(np.append(hashes.of(text.translate(LOWER).split()), END))
                size += len(rows[-1])
            if size > CHUNK_WORDS:
                yield flush()
                ids, trained, rows, size, made = [], [], [], 0, made + 1
        if rows:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text")
    return docs.mapInArrow(run, "chunk long, doc_ids array<long>, trained array<boolean>, lengths array<long>, tokens binary, vocab binary, counts binary, n_vocab long, n_train long")


def buckets_for(keys: int) -> int:
    """A power of two, so that a bucket has about BUCKET_KEYS keys."""
    return 1 << max(0, (max(1, keys) // BUCKET_KEYS)).bit_length()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) & np.uint64(buckets - 1)).astype(np.int64)


def by_bucket(which: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) with the places in `order` within each bucket."""
    values = which[order]
    if len(values) and values.max() < 1 << 16:
        values = values.astype(np.uint16)  # sorted digit by digit
    order = order[np.argsort(values, kind="stable")]
    values = which[order]
    cuts = np.flatnonzero(np.diff(values)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(which[part[0]]), part


def step(df: DataFrame, name: str, *used: Staged) -> Staged:
    """A written table; the shuffle files behind it go with the query that writes it, and the tables `used` up by it."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        written = Staged(df, name)
    finally:
        conf.set(key, before)
    for table in used:
        table.drop()
    return written


# --- words ---------------------------------------------------------------------------------------

ASKED = "bucket long, chunk long, words binary, counts binary"
ANSWER = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("ranks", pa.binary()), ("totals", pa.binary()), ("sole", pa.binary()), ("stats", pa.list_(pa.int64()))])
ANSWERED = "bucket long, chunk long, ranks binary, totals binary, sole binary, stats array<long>"


def word_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocab, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "vocab", "counts")), strict=True):
                v, n = expand(vocab, np.uint64), expand(counts, np.int64)
                out = [(b, chunk, squeeze(deltas(v[at])), squeeze(n[at])) for b, at in by_bucket(bucket_of(v, buckets), np.argsort(v))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "chunk", "words", "counts"])

    return chunks.select("chunk", "vocab", "counts").mapInArrow(run, ASKED)


def count_of_counts(totals: np.ndarray) -> list[int]:
    return np.bincount(totals[(totals > 0) & (totals <= TOP + 1)], minlength=TOP + 2).tolist()


def word_answers(requests: DataFrame, buckets: int) -> DataFrame:
    """For each chunk its words' ranks in the bucket, totals and which it alone has; for each bucket (chunk null) count-of-counts and distinct words.

    ranks and sole: in the words' order; totals: ascending, so from the last rank to the first.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(expand(b, np.uint64), dtype=np.uint64) for b in table["words"].to_pylist()]
        own = [expand(b, np.int64) for b in table["counts"].to_pylist()]
        values, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(values), np.int64)
        np.add.at(totals, place, np.concatenate(own))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        bucket = table["bucket"][0].as_py()
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-totals, kind="stable")] = np.arange(len(values))
        sole = np.bincount(place) == 1
        rows = [(bucket, c, squeeze(rank[at]), squeeze(deltas(np.sort(totals[at]))), squeeze(np.packbits(sole[at])), None) for c, at in zip(table["chunk"].to_pylist(), np.split(place, cuts), strict=True)]
        rows.append((bucket, None, None, None, None, [*count_of_counts(totals), int((totals > 0).sum())]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ANSWER.types, strict=True)], schema=ANSWER)

    return requests.groupBy("bucket").applyInArrow(run, ANSWERED)


# --- the model -----------------------------------------------------------------------------------


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount of each count from 0 to TOP (1 beyond), by Katz's formula; n[r]: kinds seen r times.

    Where the raw counts of counts give no valid discounts (copies make even counts too common), they are
    smoothed by a line through log n[r] over log r, whose discounts are valid if it falls steeper than
    -1; else half a count is taken off.
    """
    r = np.arange(1, TOP + 2)
    counts = np.array(n[1 : TOP + 2], float)

    def katz(ratio: np.ndarray, common: float) -> np.ndarray | None:
        d = (ratio - common) / (1 - common) if common < 1 else ratio * 0
        return np.concatenate([[1.0], d]) if ((d > 0) & (d < 1)).all() else None

    if (counts > 0).all():
        raw = katz(r[1:] * counts[1:] / counts[:-1] / r[:-1], (TOP + 1) * counts[-1] / counts[0])
        if raw is not None:
            return raw
    some = counts > 0
    if some.sum() > 1:
        slope = np.polyfit(np.log(r[some]), np.log(counts[some]), 1)[0] + 1
        smooth = katz((1 + 1 / r[:-1]) ** slope, (TOP + 1) ** slope)
        if smooth is not None:
            return smooth
    return np.concatenate([[1.0], (r[:-1] - 0.5) / r[:-1]])


class Words:
    """Unigram probabilities from counts. The unknown word has exactly what they leave."""

    def __init__(self, n: list[int], total: int) -> None:
        self.total, self.d = total, discounts(n)
        off = sum((1 - self.d[r]) * r * n[r] for r in range(1, TOP + 1))
        self.scale = 1.0 if off > 0 or not total else total / (total + 1)
        self.unknown = (off / total if off > 0 else 1 / (total + 1)) if total else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        p = self.d[np.minimum(c, TOP) * (c <= TOP)] * c * self.scale / max(1, self.total)
        return np.where(c > 0, p, self.unknown)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, TOP) * (c <= TOP)] * c


def backoff_weights(c: np.ndarray, few: np.ndarray, covered: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of contexts seen c times, `few[:, r - 1]` of whose followers r times, the followers' probabilities one level below adding up to `covered`."""
    off = few @ ((1 - d[1:]) * np.arange(1, TOP + 1))
    left = np.where(off > 0, off / np.maximum(c, 1), 1 / (c + 1.0))
    return np.where(c > 0, left / np.maximum(1 - covered, 1e-300), 1.0)


# --- n-grams of a chunk ----------------------------------------------------------------------------

STATE = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("trained", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("names", pa.binary()), ("totals", pa.binary()), ("sole", pa.binary())])
STATES = "chunk long, doc_ids array<long>, trained array<boolean>, lengths array<long>, tokens binary, names binary, totals binary, sole binary"


def bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(expand(b, np.uint8), count=n).astype(bool)


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def tally(owner: np.ndarray, count: np.ndarray, worth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(few, covered) of n contexts from their n-grams: owners, counts and what each follower has one level below."""
    some = (count > 0) & (count <= TOP)
    few = np.bincount(owner[some] * TOP + count[some] - 1, minlength=n * TOP).reshape(n, TOP)
    return few, np.bincount(owner, weights=np.where(count > 0, worth, 0.0), minlength=n).astype(float)  # of no rows it has whole numbers


class Level:
    """The distinct n-grams of one length in a chunk: places of contexts among the shorter n-grams (words and
    the start for bigrams), words, own training counts, the n-grams without their first word, and each
    token's n-gram, -1 for none. Once answered: counts, which n-grams no other chunk has, which contexts have
    rare followers (their n-grams are discounted), and the sums of contexts that lack a follower of theirs here."""

    counts: np.ndarray
    sole: np.ndarray
    rare: np.ndarray
    few: np.ndarray
    covered: np.ndarray

    def __init__(self, before: np.ndarray, tokens: np.ndarray, shorter: np.ndarray, trained: np.ndarray, n: int) -> None:
        at = np.flatnonzero(before >= 0)
        grams, place = np.unique(before[at].astype(np.int64) * n + tokens[at], return_inverse=True)
        self.place = np.full(len(tokens), -1, np.int32)
        self.place[at] = place
        self.own = np.bincount(place[trained[at]], minlength=len(grams)).astype(np.int32)
        self.context, self.word = (grams // n).astype(np.int32), (grams % n).astype(np.int32)
        self.shorter = np.empty(len(grams), np.int32)
        self.shorter[place] = shorter[at]

    def lacking(self, contexts: int) -> np.ndarray:
        """Contexts with a follower here that training has not: those whose backoff weights count."""
        out = np.zeros(contexts, bool)
        out[self.context[self.counts == 0]] = True
        return out


class Chunk:
    """A chunk with its n-grams up to some level."""

    def __init__(self, row: dict, trained_docs: int) -> None:
        lengths = np.array(row["lengths"], np.int64)
        self.tokens = expand(row["tokens"], np.uint32).astype(np.int32)
        self.starts = np.cumsum(lengths) - lengths
        self.trained = np.repeat(np.array(row["trained"], bool), lengths)
        self.totals = expand(row["totals"], np.int64)
        n = len(self.totals)
        self.names = np.append(expand(row["names"], np.int64), START)
        before = self.behind(self.tokens)
        before[self.starts] = n  # the start
        self.levels = [Level(before, self.tokens, self.tokens, self.trained, n)]
        self.context_counts = self.counts = np.append(self.totals, trained_docs)  # of the first and of the last level's contexts
        self.sole = np.append(bits(row["sole"], n), False)

    def deepen(self) -> None:
        """The last level is answered; the next one begins."""
        last = self.levels[-1]
        self.counts, self.sole = last.counts, last.sole
        self.levels.append(Level(self.behind(last.place), self.tokens, last.place, self.trained, len(self.totals)))

    def behind(self, x: np.ndarray) -> np.ndarray:
        """What the token before each one has; -1 for a document's first."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = -1
        return out

    def context_names(self, places: np.ndarray) -> list[np.ndarray]:
        """The words of the last level's contexts, the last one first."""
        return [self.names[w] for w in self.context_words(places)]

    def context_words(self, places: np.ndarray) -> list[np.ndarray]:
        out = []
        for level in self.levels[-2::-1]:
            out.append(level.word[places])
            places = level.context[places]
        return [*out, places]

    def parts(self, hot_least: int, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, n-grams by context and word, where their contexts begin, which contexts are hot) of n-grams asked for:
        those whose contexts training has and other chunks too."""
        last, n = self.levels[-1], len(self.names)
        at = np.flatnonzero((~self.sole & (self.counts > 0))[last.context])
        used, context = np.unique(last.context[at], return_inverse=True)
        rank = np.empty(n, np.int64)
        rank[np.argsort(self.names)] = np.arange(n)
        order = np.zeros(len(used), np.int64)  # of the contexts by their words
        for words in self.context_words(used):
            order = np.unique(order * n + rank[words], return_inverse=True)[1]
        columns = self.context_names(used)
        hot = (self.counts[used] > hot_least) | (columns[0] == START)
        key = columns[0].view(np.uint64)
        for c in columns[1:]:
            key = mix(key) + c.view(np.uint64)
        spread, which = hot[context], bucket_of(key, buckets)[context]
        which[spread] = bucket_of(mix(key)[context[spread]] + self.names[last.word[at[spread]]].view(np.uint64), buckets)
        out = []
        for bucket, part in by_bucket(which, np.argsort(order[context] * n + rank[last.word[at]])):
            first = firsts(context[part])
            out.append((bucket, at[part], first, hot[context[part[first]]]))
        return out

    def take(self, answers: list[dict], shared: dict, hot_least: int, buckets: int, words: Words, ds: list[np.ndarray]) -> Level:
        """The last level with its figures, from the buckets' answers, the hot contexts' sums and the chunk's own n-grams."""
        last, got, n = self.levels[-1], {a["bucket"]: a for a in answers}, len(self.counts)
        parts = self.parts(hot_least, buckets)
        last.counts, last.sole, last.rare = last.own.astype(np.int64), self.sole[last.context], np.zeros(n, bool)
        last.rare[last.context[(last.own > 0) & (last.own <= TOP)]] = True  # of others' contexts it is answered
        for bucket, at, first, _ in parts:
            a = got[bucket]
            last.counts[at], last.sole[at] = expand(a["counts"], np.int64), bits(a["sole"], len(at))
            last.rare[last.context[at[first]]] = bits(a["rare"], len(first))
        lacking = last.lacking(n)
        index = np.cumsum(lacking) - 1
        mine = np.flatnonzero((lacking & self.sole)[last.context])
        shorter = self.counts[last.shorter[mine]]
        few, last.covered = tally(index[last.context[mine]], last.own[mine], discounted(shorter, ds[-1]) if ds else words.probability(shorter), int(lacking.sum()))
        last.few = few.astype(np.int32)
        for bucket, at, first, _ in parts:
            contexts = last.context[at[first]]
            # the answer has sums of contexts that lack one of the followers asked for in this part
            here = contexts[np.logical_or.reduceat(last.counts[at] == 0, first)]
            last.few[index[here]], last.covered[index[here]] = expand(got[bucket]["few"], np.int32).reshape(-1, TOP), expand_floats(got[bucket]["covered"])
        for _, at, first, hot in parts:
            common = last.context[at[first[hot]]]
            for c, name in zip(common.tolist(), zip(*(x.tolist() for x in self.context_names(common)), strict=True), strict=True):
                few, covered = shared[name]
                last.rare[c] = any(few)
                if lacking[c]:
                    last.few[index[c]], last.covered[index[c]] = few, covered
        return last

    def scores(self, words: Words, ds: list[np.ndarray]) -> np.ndarray:
        """log10 of each token's probability: the seen n-gram's, or the weight times that one level below."""
        p, c, factor, shorter = words.probability(self.totals)[self.tokens], self.context_counts, None, None
        for level, d in zip(self.levels, ds, strict=True):
            lacking = level.lacking(len(c))
            covered = level.covered if factor is None else level.covered * factor[shorter[lacking]]
            weight = backoff_weights(c[lacking], level.few, covered, d)
            factor, shorter = np.where(level.rare, 1.0, c / (c + 1.0)) / np.maximum(c, 1), level.shorter
            at = np.flatnonzero(level.place >= 0)
            gram = level.place[at]
            context, seen = level.context[gram], level.counts[gram] > 0
            p[at[seen]] = discounted(level.counts[gram[seen]], d) * factor[context[seen]]
            p[at[~seen]] *= weight[(np.cumsum(lacking) - 1)[context[~seen]]]
            c = level.counts
        return np.log10(p)


def named(row: dict, answers: list[dict], buckets: int) -> dict:
    """The state of a chunk whose words are answered."""
    vocab = expand(row.pop("vocab"), np.uint64)
    names, totals, sole = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64), np.zeros(len(vocab), bool)
    got = {a["bucket"]: a for a in answers}
    for b, at in by_bucket(bucket_of(vocab, buckets), np.argsort(vocab)):
        rank = expand(got[b]["ranks"], np.int64)
        names[at], sole[at] = rank * buckets + b, bits(got[b]["sole"], len(at))
        totals[at[np.argsort(-rank)]] = np.cumsum(expand(got[b]["totals"], np.uint64), dtype=np.uint64).astype(np.int64)
    return {**row, "names": squeeze(names), "totals": squeeze(totals), "sole": squeeze(np.packbits(sole))}


def named_chunks(chunks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([named(row, right.to_pylist(), buckets) for row in left.to_pylist()], schema=STATE)

    left = chunks.select("chunk", "doc_ids", "trained", "lengths", "tokens", "vocab")
    right = answers.filter("chunk is not null").select("chunk", "bucket", "ranks", "totals", "sole")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, STATES)


# --- tables of n-grams -----------------------------------------------------------------------------

GRAMS_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("contexts", pa.list_(pa.binary())), *((n, pa.binary()) for n in ("hot", "sizes", "words", "counts", "shorter")), ("stats", pa.list_(pa.int64()))])
GRAMS = "bucket long, chunk long, contexts array<binary>, hot binary, sizes binary, words binary, counts binary, shorter binary, stats array<long>"
FOUND_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((n, pa.binary()) for n in ("counts", "sole", "rare", "few", "covered")), ("stats", pa.list_(pa.int64())), ("hot", pa.list_(pa.list_(pa.int64()))), ("hot_few", pa.list_(pa.list_(pa.int64()))), ("hot_covered", pa.list_(pa.float64()))])
FOUND = "bucket long, chunk long, counts binary, sole binary, rare binary, few binary, covered binary, stats array<long>, hot array<array<long>>, hot_few array<array<long>>, hot_covered array<double>"


@dataclass
class Model:
    """What is known of the levels answered: discounts and hot contexts' sums (at most HOT + 1 rows a level)."""

    words: Words
    trained_docs: int
    hot_least: int
    buckets: int
    ds: list[np.ndarray] = field(default_factory=list)
    shared: list[dict] = field(default_factory=list)

    def chunk(self, row: dict, answers: list[dict]) -> Chunk:
        chunk = Chunk(row, self.trained_docs)
        for k, shared in enumerate(self.shared):
            if k:
                chunk.deepen()
            chunk.take([a for a in answers if a["level"] == k], shared, self.hot_least, self.buckets, self.words, self.ds[:k])
        return chunk


def answered(states: DataFrame, found: list[Staged], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`run` over each chunk and all answers to it."""
    rows = [f.read().filter("counts is not null").select("chunk", "bucket", "counts", "sole", "rare", "few", "covered", F.lit(k).alias("level")) for k, f in enumerate(found)]
    return states.groupBy("chunk").cogroup(reduce(DataFrame.union, rows).groupBy("chunk")).applyInArrow(run, schema)


def gram_requests(states: DataFrame, found: list[Staged], model: Model) -> DataFrame:
    """For each chunk and bucket the n-grams asked for; one row a chunk has the count-of-counts of those it alone holds."""

    def of(row: dict, answers: list[dict]) -> Iterator[dict]:
        chunk = model.chunk(row, answers)
        if model.shared:
            chunk.deepen()
        last = chunk.levels[-1]
        alone = last.own[chunk.sole[last.context]]
        yield {"bucket": row["chunk"] % model.buckets, "chunk": row["chunk"], "stats": count_of_counts(alone)}
        for bucket, at, first, hot in chunk.parts(model.hot_least, model.buckets):
            columns, word = chunk.context_names(last.context[at[first]]), chunk.names[last.word[at]]
            steps = np.diff(word, prepend=0)  # ascending within a context
            steps[first] = word[first]
            arrays = {"hot": hot, "sizes": np.diff(np.append(first, len(at))).astype(np.int32), "words": steps, "counts": last.own[at], "shorter": chunk.counts[last.shorter[at]]}
            yield {"bucket": bucket, "chunk": row["chunk"], "contexts": [squeeze(deltas(columns[0])), *map(squeeze, columns[1:])], **{k: squeeze(v) for k, v in arrays.items()}}

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(list(of(batch.slice(i, 1).to_pylist()[0], [])), schema=GRAMS_ARROW)

    def next_level(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([r for row in left.to_pylist() for r in of(row, right.to_pylist())], schema=GRAMS_ARROW)

    return answered(states, found, next_level, GRAMS) if found else states.mapInArrow(first_level, GRAMS)


def number(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each row, equal for equal rows and in their order; one place of each number)."""
    ids, first = np.zeros(len(columns[0]), np.int64), np.zeros(0, np.int64)
    for c in columns:
        values, at = np.unique(c, return_inverse=True)
        values, ids = np.unique(ids * len(values) + at, return_inverse=True)
        first = np.empty(len(values), np.int64)
        first[ids] = np.arange(len(ids))
    return ids, first


def gram_answers(requests: DataFrame, words: Words, ds: list[np.ndarray]) -> DataFrame:
    """For each chunk its n-grams' totals, which it alone has, and its contexts' sums; for each bucket (chunk null) count-of-counts and hot contexts' sums."""

    def run(table: pa.Table) -> pa.Table:
        bucket, stats = table["bucket"][0].as_py(), np.zeros(TOP + 2, np.int64)
        for s in table["stats"].drop_null().to_pylist():
            stats += s
        asked = table.filter(pc.is_null(table["stats"]))
        out: list[dict] = []
        if asked.num_rows:
            whole = lambda name, kind: [expand(b, kind) for b in asked[name].to_pylist()]
            sizes, chunks = whole("sizes", np.int32), asked["chunk"].to_pylist()
            columns = [[expand(b, np.int64) for b in column] for column in zip(*asked["contexts"].to_pylist(), strict=True)]
            columns[0] = [np.cumsum(c) for c in columns[0]]
            flat = [np.concatenate(c) for c in columns]
            context, one = number(flat)
            size = np.concatenate(sizes).astype(np.int64)
            first = np.cumsum(size) - size
            steps = np.concatenate(whole("words", np.int64))
            word = np.cumsum(steps)
            word -= np.repeat(word[first] - steps[first], size)
            gram, at = number([np.repeat(context, size), word])
            count = np.bincount(gram, weights=np.concatenate(whole("counts", np.int32))).astype(np.int64)
            sole = np.bincount(gram) == 1
            shorter = np.concatenate(whole("shorter", np.int64))[at]
            few, covered = tally(np.repeat(context, size)[at], count, discounted(shorter, ds[-1]) if ds else words.probability(shorter), len(one))
            stats += count_of_counts(count)
            ends, cuts = np.cumsum([int(s.sum()) for s in sizes])[:-1], np.cumsum([len(s) for s in sizes])[:-1]
            rare, few = few.any(axis=1), few.astype(np.int32)
            for chunk, g, c, n in zip(chunks, np.split(gram, ends), np.split(context, cuts), sizes, strict=True):
                here = c[np.logical_or.reduceat(count[g] == 0, np.cumsum(n) - n)]  # only their weights count
                out.append({"bucket": bucket, "chunk": chunk, "counts": squeeze(count[g]), "sole": squeeze(np.packbits(sole[g])), "rare": squeeze(np.packbits(rare[c])), "few": squeeze(few[here].reshape(-1)), "covered": squeeze_floats(covered[here])})
            hot = np.flatnonzero(np.concatenate(whole("hot", np.uint8))[one])
            out.append({"bucket": bucket, "hot": np.stack([c[one[hot]] for c in flat], 1).tolist(), "hot_few": few[hot].tolist(), "hot_covered": covered[hot].tolist()})
        out.append({"bucket": bucket, "stats": stats.tolist()})
        return pa.Table.from_pylist(out, schema=FOUND_ARROW)

    return requests.groupBy("bucket").applyInArrow(run, FOUND)


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def by_place(df: DataFrame) -> dict[int, int]:
    return {r[0]: int(r[1]) for r in df.filter("chunk is null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col")).collect()}


def score_documents(documents: DataFrame, held: Column, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by n-grams of up to `order` words, 2 or more; learned from documents not `held`."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    chunks = step(chunked(documents, held), "chunks")
    facts = chunks.read().agg(F.sum("n_vocab"), F.sum("n_train"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.aggregate("trained", F.lit(0), lambda a, x: a + x.cast("int")))).first()
    n_vocab, total, n_tokens, trained_docs = (int(x or 0) for x in facts)
    word_buckets, buckets, hot_least = buckets_for(n_vocab), buckets_for(n_tokens * 2 // 3), max(1, total // HOT)
    answers = step(word_answers(word_requests(chunks.read(), word_buckets), word_buckets), "word-answers")
    stats = by_place(answers.read())
    words, distinct = Words([stats.get(r, 0) for r in range(TOP + 2)], total), stats.get(TOP + 2, 0)
    states = step(named_chunks(chunks.read(), answers.read(), word_buckets), "word-states", chunks, answers)
    model, found = Model(words, trained_docs, hot_least, buckets), []
    for n in range(2, order + 1):
        found.append(step(gram_answers(gram_requests(states.read(), found, model), words, list(model.ds)), f"answers-{n}"))
        stats, rows = by_place(found[-1].read()), found[-1].read().filter("hot is not null")
        spread = rows.select(F.explode(F.arrays_zip("hot", "hot_few", "hot_covered")).alias("x")).select("x.*").groupBy("hot")
        sums = spread.agg(F.array(*[F.sum(F.col("hot_few")[r]) for r in range(TOP)]).alias("few"), F.sum("hot_covered").alias("covered")).collect()
        model.ds.append(discounts([stats.get(r, 0) for r in range(TOP + 2)]))
        model.shared.append({tuple(r.hot): (r.few, r.covered) for r in sums})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = model.chunk(row, right.to_pylist())
            score = np.add.reduceat(b.scores(words, model.ds), b.starts)
            base = np.add.reduceat(np.log10((b.totals + 1) / (total + distinct + 1))[b.tokens], b.starts)
            known = np.add.reduceat((b.totals > 0)[b.tokens].astype(np.int64), b.starts)
            columns = [row["doc_ids"], [not t for t in row["trained"]], row["lengths"], known, [total] * len(known), base, score]
            out.append(pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, SCORED.types, strict=True)], schema=SCORED))
        return pa.concat_tables(out) if out else SCORED.empty_table()

    return answered(states.read(), found, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))
