"""Looking up keys of which some are held by many rows."""

import re

from pyspark.sql import functions as F

from corpusmill.llm.common import look_up


def test_frequent_null_and_missing_keys_are_looked_up_and_no_outer_join_sees_the_frequent(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") < 900, 1).when(F.col("id") < 1390, F.col("id") % 7 + 2).when(F.col("id") < 1395, 77).cast("long").alias("k"))
    right = left.filter("k <> 77 OR k IS NULL").groupBy("k").agg(F.count("*").alias("n_")).withColumn("v", F.col("k") * 10)
    out = look_up(left, right, "k", 2000)
    assert out.columns == ["id", "k", "v"]
    want = [(i, k, None if k in (None, 77) else k * 10) for i, k in left.collect()]
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("LeftOuter", plan)) == 1 and len(re.findall("LeftAnti", plan)) == 1
