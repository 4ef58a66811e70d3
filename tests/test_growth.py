"""Steps whose time or memory grew faster than their input: the same results, and the shape that keeps them from it."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions.bpe import SPECIAL, Bpe, decode_udf, encode_udf, in_parts, inspected, merge_words, train
from corpusmill.functions.bpe_training import train_any
from corpusmill.operators import mask, pack
from corpusmill.operators.segment import segments
from corpusmill.plans import queries

TEXTS = [None, "", "a", "né |<eos>| x", "ab" * 700, "|<", "x y\nz " * 60, "\U0001f600é" * 40]


def test_a_vocabulary_of_more_words_than_the_driver_holds(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}x{i % 7}" for i in range(40)),)], "text string")
    assert train_any(df, "text", 300, most_words=5) == train(df, "text", 300)


def test_encoding_in_parts_gives_what_encoding_one_text_gives(spark):
    assert [x for p in in_parts(pa.array(["aaa", "b", None, "ccccc", ""]), 4) for x in p.to_pylist()] == ["aaa", "b", None, "ccccc", ""]
    assert max(len(p) for p in in_parts(pa.array(["xyz"] * 50), 6)) == 2
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").coalesce(1)
    for bpe in (Bpe(), Bpe(allow_special=False), merge_words([("ab" * 3, 5), (" né", 4)], 275)):
        rows = df.withColumn("ids", encode_udf(bpe)("text")).withColumn("back", decode_udf(bpe)("ids")).collect()
        assert [r.ids for r in rows] == [None if t is None else bpe.encode(t) for t in TEXTS]
        assert [r.back for r in rows] == [None if t is None else bpe.decode(bpe.encode(t)) for t in TEXTS]


def test_segment_rows_do_not_carry_the_whole_text(spark):
    df = spark.createDataFrame([(1, [20] * 10), (2, []), (3, None)], "id int, tokens array<int>")
    out = segments(df, "tokens", 4, 2, 3)
    assert [(r.id, r.segment_no, r.inputs, r.labels) for r in out.orderBy("id", "segment_no").collect()] == [
        (1, 0, [2, 20, 20, 20], [20] * 4), (1, 1, [20] * 4, [20] * 4), (1, 2, [20] * 3, [20, 20, 3]), (2, 0, [2], [3])]
    generate = re.search(r"Generate .*", out._jdf.queryExecution().optimizedPlan().toString())[0]
    assert "posexplode" in generate and re.search(r"\), \[\d+\], false", generate)  # a column of the child, the framed text, is left out


def test_texts_packed_in_one_step_are_their_segments_packed(spark):
    rng = random.Random(3)
    rows = [(i % 3, i, rng.choice(TEXTS)) for i in range(120)]
    df = spark.createDataFrame(rows, "rank int, i int, text string").repartition("rank").sortWithinPartitions("rank", "i")
    own = segments(df.select("rank", encode_udf(Bpe())("text").alias("tokens")), "tokens", 64, SPECIAL["bos"], SPECIAL["eos"])
    want = pack.pack(own, "c", 64, buffer=9).orderBy("rank", "example_no").collect()
    assert pack.pack_texts(df, Bpe(), "c", 64, SPECIAL["bos"], SPECIAL["eos"], buffer=9).orderBy("rank", "example_no").collect() == want
    some = pack.pack_texts(df, Bpe(), "c", 64, SPECIAL["bos"], SPECIAL["eos"], buffer=9, arrays=["segments"])
    assert some.columns == ["rank", "example_no", "segments"] and some.orderBy("rank", "example_no").collect() == [(r["rank"], r.example_no, r.segments) for r in want]


def test_bounds_are_built_of_whole_arrays(spark):
    rows = [[0, 0, 1, 2, 2, 2, -1, -1], [0], [-1, -1], list(range(9)), [0] * 5]
    df = spark.createDataFrame([(r,) for r in rows], "s array<int>")
    want = [[(r.index(x), q) if x >= 0 else (0, len(r) - r.count(-1) - 1) for q, x in enumerate(r)] for r in rows]
    assert [[tuple(b) for b in r.b] for r in df.select(mask.bounds(F.col("s")).alias("b")).collect()] == want
    assert [r.n for r in df.select(mask.places(F.col("s")).alias("n")).collect()] == [6, 1, 0, 9, 5]


def test_sql_packers_are_as_many_as_the_corpus_asks_for(spark, monkeypatch):
    monkeypatch.setattr(queries.jobs, "slice_count", lambda docs, text: 5)
    out = queries.sql_packing(spark, "/root/testdata/sf0.001")
    assert re.search(r"hashpartitioning\([^,()]+, [^,()]+, \d+\), REPARTITION", out._jdf.queryExecution().executedPlan().toString())  # by rank and slice
    assert out.agg(F.sum("tokens")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").agg(F.sum(F.octet_length("text") + 1)).first()[0]


def test_inspection_of_special_and_broken_tokens(spark):
    bpe = merge_words([("éé", 5), (" né", 4)], 275)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = inspected(df, "text", bpe).orderBy("i").collect()
    assert [(r.ids, r.decoded_text) for r in rows] == [(None, None) if t is None else (bpe.encode(t), bpe.decode(bpe.encode(t))) for t in TEXTS]
    assert rows[3].formatted_tokens[0] == "nÃ©" and "|<eos>|" in rows[3].formatted_tokens and "\n" in rows[6].formatted_tokens
    plan = inspected(df, "text", bpe)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
