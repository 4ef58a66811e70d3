"""Steps over whole texts read few megabytes at a time, and leave the session as it was."""

from corpusmill.llm import common, minhash_dedup


def test_near_dedup_reads_texts_in_small_batches(spark, monkeypatch):
    seen, before = {}, {key: spark.conf.get(key) for key in common.SMALL}

    class Spy(common.Staged):
        def __init__(self, df, name, *more):
            seen.setdefault(name, []).append({key: spark.conf.get(key) for key in common.SMALL})
            super().__init__(df, name, *more)

    monkeypatch.setattr(minhash_dedup, "Staged", Spy)
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words"), (4, None)], "doc_id long, text string")
    out = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert out == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
    assert seen["signatures"] == [common.SMALL] and set(map(str, seen["shingle-sets"])) == {str(common.SMALL)}
    assert seen["classes"] == [before] and {key: spark.conf.get(key) for key in common.SMALL} == before


def test_batches_within_are_small(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', 4096) AS text")
    sizes = lambda batches: (b.__class__.from_arrays([[b.nbytes]], names=["n"]) for b in batches)
    with common.small_batches(spark):
        assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 6 << 20
