"""Order and shards by place in files, masks as intervals, filters over rows, table functions."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import decode
from corpusmill.functions.table_functions import register
from corpusmill.operators import mask, pack
from corpusmill.operators.segment import segments
from corpusmill.sources.corpus import CorpusCase, block_shard, first_rows, scan, take


@pytest.fixture
def files(spark, tmp_path):
    """Five files of 7, 0 or more rows, and the rows in the order of files and places."""
    for k, n in enumerate((7, 3, 1, 12, 5)):
        rows = [(100 * k + n - i, f"text {k} {i}") for i in range(n)]
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/t")
    case = CorpusCase("t", "", "", f"file://{tmp_path}/t", "default", "train", "text")
    df = scan(spark, case)
    whole = df.select("id", F.col("_metadata.file_path").alias("p"), F.col("_metadata.row_index").alias("r")).collect()
    return case, df, [x.id for x in sorted(whole, key=lambda x: (x.p, x.r))]


@pytest.mark.parametrize("n", [1, 3, 8, 20, 28, 99])
def test_first_rows_by_place_without_an_exchange(spark, files, n):
    case, df, order = files
    got = first_rows(df, n)
    assert sorted(r.id for r in got.collect()) == sorted(order[:n])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    limited = CorpusCase(**{**case.fields(), "sample_count": n, "max_chars": 4})
    assert take(df, limited).filter("text = 'text'").count() == min(n, 28)
    with pytest.raises(ValueError, match="positive"):
        first_rows(df, 0)


def test_shards_follow_blocks_of_rows_not_tasks(spark, files):
    _, df, order = files
    shard = block_shard(3, 4)
    label = lambda d: {r.id: r.s for r in d.select("id", shard.alias("s")).collect()}
    one = label(df)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert label(df) == one and sorted(one) == sorted(order) and set(one.values()) <= {0, 1, 2} and len(set(one.values())) > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="positive"):
        block_shard(0)


def test_masks_as_intervals(spark):
    rng = random.Random(1)
    rows = [([],), ([-1, -1],), ([0],)]
    for _ in range(30):
        own = [s for s in range(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 6))]
        rows.append((own + [-1] * rng.randrange(4),))
    df = spark.createDataFrame(rows, "s array<int>")
    size = F.size("s")
    out = df.select("s", mask.packed_mask(F.col("s")).alias("m"), mask.bounds(F.col("s")).alias("b"), F.transform(mask.bounds(F.col("s")), lambda b: F.transform(F.filter(F.sequence(F.lit(0), size), lambda k: k < size), lambda k: mask.sees(b, k))).alias("each"))
    for r in out.collect():
        want = [[k <= q and r.s[k] >= 0 and (r.s[q] < 0 or r.s[q] == r.s[k]) for k in range(len(r.s))] for q in range(len(r.s))]
        assert r.m == want == r.each and len(r.b) == len(r.s)


def test_filters_over_rows_equal_those_over_arrays(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-6, 6)) for _ in range(rng.randrange(1, 40))]) for i in range(40)]
    wide = spark.createDataFrame(rows, "row int, x array<double>")
    long = wide.select("row", F.posexplode("x").alias("token", "logit"))
    kept = lambda df: {(r.row, t) for r in df.collect() for t in r.ids}
    for k in (1, 3, 50):
        got = decode.top_k_rows(long, "row", "logit", k)
        assert {(r.row, r.token) for r in got.collect()} == kept(wide.select("row", decode.kept_ids(decode.top_k(F.col("x"), k)).alias("ids")))
        assert got.columns == long.columns and "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    for p in (0.05, 0.5, 0.9, 1):
        got = decode.top_p_rows(long, "row", "token", "logit", p)
        assert {(r.row, r.token) for r in got.collect()} == kept(wide.select("row", decode.kept_ids(decode.top_p(F.col("x"), p)).alias("ids")))
    with pytest.raises(ValueError, match="p must"):
        decode.top_p_rows(long, "row", "token", "logit", 0)


def test_table_functions_from_sql(spark):
    register(spark)
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.randrange(20, 90) for _ in range(rng.randrange(0, 30))]) for i in range(50)] + [(50, 0, None)]
    spark.createDataFrame(rows, "id int, rank int, tokens array<int>").repartition(4).createOrReplaceTempView("some_docs")
    made = spark.sql("SELECT * FROM token_segments(TABLE(some_docs), max_len => 8, bos => 2, eos => 3)")
    own = segments(spark.table("some_docs").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<int>"))), "tokens", 8, 2, 3)
    shown = lambda df: sorted(map(str, df.select("id", "rank", "segment_no", "inputs", "labels").collect()))
    assert shown(made) == shown(own)
    made.createOrReplaceTempView("some_segments")
    packed = spark.sql("SELECT * FROM pack_best_fit(TABLE(some_segments) PARTITION BY rank ORDER BY (id, segment_no), corpus => 'c', max_len => 8, keep => 'rank')")
    dealt = own.repartition(2, "rank").sortWithinPartitions("rank", "id", "segment_no")
    want = pack.pack(dealt, "c", 8)
    rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert rows(packed) == rows(want)
    for bad, said in (("token_segments(TABLE(SELECT 1 AS tokens), max_len => 8, bos => 2, eos => 3)", "tokens"), ("token_segments(TABLE(some_docs), max_len => 0, bos => 2, eos => 3)", "at least 1"), ("pack_best_fit(TABLE(some_docs), corpus => 'c', max_len => 8, keep => 'rank')", "inputs")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM {bad}").collect()
