"""Packing in slices and exact prefixes against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import pack
from corpusmill.plans import jobs
from corpusmill.sources.corpus import CorpusCase, read_cache

CASE = CorpusCase("small", "", "", "", "default", "train", "body")
L = 16


def ids_of(text):
    return [20 + len(w) for w in text.split()]


def tokenizer(seen=None):
    """An object that pickles by value: executors don't import tests."""

    class Words:
        def tokenize(self, text):
            if seen is not None:
                seen.add(1)
            return [20 + len(w) for w in text.split()]

    return Words()


def corpus():
    rng = random.Random(4)
    return [(i, " ".join("x" * rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 3, 7, 15, 40]))), None) for i in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "id long, body string, text string").repartition(5)


def in_order(seed):
    """(digest, id, ids) of each document by seeded order."""
    return sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, ids_of(t)) for i, t, _ in corpus())


def plain_segments(ids):
    framed = [2, *ids, 3]
    return [(framed[k : k + L + 1][:-1], framed[k : k + L + 1][1:]) for k in range(0, len(framed) - 1, L)]


def plain_pack(documents, buffer=pack.BUFFER):
    """Inputs of the examples of one packer, by a list that is searched whole each time."""
    held, out, number = [], [], 0

    def take():
        room, own = L, []
        while fitting := [s for s in held if len(s[1]) <= room]:
            best = max(fitting, key=lambda s: (len(s[1]), -pack.order_key("small", s[0])))
            held.remove(best)
            own += best[1]
            room -= len(best[1])
        out.append(own + [0] * room)

    for ids in documents:
        for inputs, _ in plain_segments(ids):
            held.append((number, inputs))
            number += 1
            if len(held) >= buffer:
                take()
    while held:
        take()
    return out


@pytest.mark.parametrize("world, slices", [(1, 1), (1, 4), (3, 4), (5, 1)])
def test_slices_hold_what_a_plain_packer_makes(spark, docs, world, slices):
    made = jobs.examples(docs, "id", tokenizer(), CASE, L, world, 2, 23, slices)
    got: dict = {}
    for r in made.orderBy("pass_index", "slice", "rank", "example_no").collect():
        got.setdefault((r.pass_index, r.slice, r["rank"]), []).append(r.inputs)
    want: dict = {}
    for p in (0, 1):
        for n, (digest, _, ids) in enumerate(in_order(23 + p)):
            want.setdefault((p, int(digest[:8], 16) * slices >> 32, n % world), []).append(ids)
    assert got == {k: plain_pack(v) for k, v in want.items()}
    other = jobs.examples(docs.repartition(2), "id", tokenizer(), CASE, L, world, 2, 23, slices)
    rows = lambda df: sorted(map(str, df.collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert rows(other) == rows(made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_move_once(spark, docs):
    """One exchange by (pass, slice) below the packers; the offsets come by broadcast."""
    made = jobs.examples(docs.select("id", "body"), "id", tokenizer(), CASE, L, 3, 1, 23, 4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    texts = plan[: plan.index("BroadcastExchange")]
    assert texts.count("Exchange hashpartitioning(pass_index") == 1 and "rangepartitioning" not in texts


@pytest.mark.parametrize("n, slice_tokens", [(1, 10**6), (37, 100), (60, 10**6)])
def test_exact_cache_against_a_plain_prefix(spark, docs, tmp_path, n, slice_tokens):
    path = f"file://{tmp_path}/cache"
    jobs.validation_cache(docs, "id", tokenizer(), CASE, path, n, L, {"corpus_signature": "s"}, 17, slice_tokens)
    slices, before = {}, 0
    for _, _, ids in in_order(17):
        if before < n * L:
            slices.setdefault(before // slice_tokens, []).append(ids)
        before += len(ids) + 1
    want = [x for k in sorted(slices) for x in plain_pack(slices[k])]
    assert len(want) >= n
    got = read_cache(spark, path, n, L, {"corpus_signature": "s"}).orderBy("example_no").collect()
    assert [r.example_no for r in got] == list(range(n)) and [r.inputs for r in got] == want[:n]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["cache"]


def test_no_more_is_tokenized_than_a_prefix_needs(spark, docs, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    many = docs.withColumn("body", F.repeat(F.lit("word "), 40))
    prefix = jobs.first_documents(many, "id", tokenizer(seen), "body", 5, L, f"file://{tmp_path}/w", 17, 10**6)
    assert 2 <= prefix.count() <= 4 and seen.value < 30


def test_a_corpus_that_gives_too_few_is_refused(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="needs 9999"):
        jobs.validation_cache(docs, "id", tokenizer(), CASE, f"file://{tmp_path}/cache", 9999, L, {})
    with pytest.raises(ValueError, match="needs 1"):
        jobs.validation_cache(docs.limit(0), "id", tokenizer(), CASE, f"file://{tmp_path}/cache", 1, L, {})
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith(".")]
