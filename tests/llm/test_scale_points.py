"""Cases where work or results once depended on size: very long near pairs, null items, flagged templates, sums of many tasks."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import chat_format, decontamination, minhash_dedup, quality, substring_dedup


def long_texts(n, words, share):
    rng = random.Random(words)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(words), int(share * words)):
            own[k] = f"x{i}-{k}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n, words", [(12, 100_000), (24, 100_000), (6, 400_000)])
def test_very_long_texts_below_the_threshold_make_no_pairs(n, words):
    """Similarity about 0.77, as measured on the first two."""
    sets = minhash_dedup.shingle_sets([t.encode() for t in long_texts(n, words, 0.0336)], 2, minhash_dedup.WordHashes())
    shared = len(np.intersect1d(sets[0], sets[1]))
    assert 0.76 < shared / (len(sets[0]) + len(sets[1]) - shared) < 0.78
    samples = minhash_dedup.odd_sketches(minhash_dedup.signatures(sets)).view(np.int64)
    table = pa.table({"node": list(range(n)), "component": list(range(n)), "n_shingles": [len(s) for s in sets], "sketch": pa.array(list(samples)), "parity": pa.array([minhash_dedup.set_parity(s).view(np.int64) for s in sets])})
    for every in (False, True):
        assert minhash_dedup.forest(minhash_dedup.Block(table), None, 80, {}, every)[0] == []


def test_bitmaps_of_any_width_never_refuse_a_link():
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 1 << 62, 90_000).astype(np.uint64)
    sets = [np.unique(whole[:n]) for n in (300, 340, 5000, 6000, 70_000, 86_000, 90_000)]
    n = len(sets)
    sketch = pa.array([[0] * 16] * n, pa.list_(pa.int64()))  # leaves the decision to the bitmaps
    table = pa.table({"node": list(range(n)), "component": list(range(n)), "n_shingles": [len(s) for s in sets], "sketch": sketch, "parity": pa.array([minhash_dedup.set_parity(s).view(np.int64) for s in sets])})
    heads, members, _ = minhash_dedup.forest(minhash_dedup.Block(table), None, 80, {}, True)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i]) >= 0.8 * len(sets[j])}
    assert want <= {(min(a, b), max(a, b)) for a, b in zip(heads, members, strict=True)}


def test_blocks_of_long_sets_are_bound_by_elements(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(long_texts(10, 600, 0.03) + long_texts(10, 601, 0.05))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shown = lambda: sorted(map(tuple, minhash_dedup.near_duplicates(df, 80, 2).collect()))
    one = shown()
    monkeypatch.setattr(minhash_dedup, "BLOCK_ELEMENTS", 900)
    assert shown() == one


def test_items_without_an_id_mark_words(spark, tmp_path):
    docs = [(1, "alpha beta gamma"), (2, "beta"), (3, None)]
    items = [(None, "alpha beta"), (7, "gamma"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = decontamination.op10_decontamination(spark, f"file://{tmp_path}").toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(decontamination.OP10_SQL).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
    assert got.set_index("doc_id").loc[1].n_hit == 3 and got.set_index("doc_id").loc[1].n_items == 1


def test_a_template_that_says_too_much_of_itself_is_reported():
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(70)]

    def forgets(turns):
        return chat_format.chatml(turns[-66:])

    forgets.concatenative = True
    rows = list(chat_format.render(iter([(1, iter(turns))]), forgets, "assistant"))
    assert [r["rewritten"] for r in rows] == [False, True]
    rows = list(chat_format.render(iter([(1, iter(turns))]), chat_format.chatml, "assistant"))
    assert not any(r["rewritten"] for r in rows) and "".join(r["formatted"] for r in rows) == chat_format.chatml(turns)


def test_vectors_do_not_depend_on_tasks_or_levels_of_sums(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(" ".join(rng.choice(["aa", "Bb", "c1", "d!", "ee"]) for _ in range(30)),) for _ in range(40)], "text string")
    one = quality.random_indexing(df.coalesce(1))
    monkeypatch.setattr(quality, "FAN", 2)
    many = quality.random_indexing(df.repartition(13))
    assert one.words == many.words and np.array_equal(one.word_table, many.word_table) and np.array_equal(one.shape_table, many.shape_table)
    few = quality.random_indexing(df, n_words=2, n_shapes=3, least=1)
    assert len(few.words) == 2 and len(few.shapes) == 3


@pytest.mark.parametrize("size", [3, 64, 1 << 16])
def test_search_of_foreign_passages_in_slices(monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "SLICE", size)
    rng, window = random.Random(9), 6
    draw = lambda n: [rng.choice("abc") for _ in range(n)]
    held = [draw(rng.randrange(6, 60)) for _ in range(12)]
    streamed = [draw(rng.randrange(6, 200)) for _ in range(8)] + [held[3] + ["unknown"] * 9 + held[4]]
    ids = np.array([50 - k for k in range(12)])
    shard = substring_dedup.Shard([" ".join(h).encode() for h in held], ids, window)
    least = {}
    for h, i in zip(held, ids.tolist(), strict=True):
        for k in range(len(h) - window + 1):
            least[tuple(h[k : k + window])] = min(i, least.get(tuple(h[k : k + window]), i))
    got = shard.search([" ".join(q).encode() for q in streamed])
    for q, own in zip(streamed, got, strict=True):
        assert own.tolist() == [least.get(tuple(q[k : k + window]), substring_dedup.NOWHERE) for k in range(len(q) - window + 1)]


def test_a_million_repeated_words_are_searched_in_bounded_memory():
    import tracemalloc

    shard = substring_dedup.Shard([b" ".join([b"again"] * 90), b" ".join(b"w%d" % k for k in range(200))], np.array([4, 7]), 50)
    line = b" ".join([b"again"] * 1_000_000)
    tracemalloc.start()
    got = shard.search([line])[0]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (got == 4).all() and len(got) == 1_000_000 - 49 and peak < 300e6
