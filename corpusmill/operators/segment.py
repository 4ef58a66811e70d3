"""Framing and overlap-by-one segments, by array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def framed(tokens: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), tokens, F.array(F.lit(eos)))


def segments(df: DataFrame, tokens: str, max_len: int, bos: int, eos: int) -> DataFrame:
    """One row a segment: segment_no, inputs, labels. Windows are max_len + 1 wide and max_len apart, so each transition is predicted once."""
    if max_len <= 0:
        raise ValueError("max_len must be positive")
    out = df.withColumn("framed_", framed(F.col(tokens), bos, eos)).drop(tokens)
    # windows are cut before rows are made of them: a row with the whole text's ids for each segment would be quadratic in the text
    starts = F.sequence(F.lit(0), F.size("framed_") - 2, F.lit(max_len))
    windows = F.transform(starts, lambda s: F.slice("framed_", s + 1, F.lit(max_len + 1)))
    out = out.select(*[c for c in out.columns if c != "framed_"], F.posexplode(windows).alias("segment_no", "window_"))
    out = out.withColumn("inputs", F.slice("window_", F.lit(1), F.size("window_") - 1)).withColumn("labels", F.slice("window_", F.lit(2), F.size("window_") - 1))
    return out.drop("window_")
