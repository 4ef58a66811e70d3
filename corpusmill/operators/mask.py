"""The attention mask of packed segments, within a row: no self-join, no shuffle.

A query sees one interval of keys, so a mask is a pair of bounds a query; rows of the mask are made on demand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.decode import let


def places(segments: Column) -> Column:
    """How many places are not padding (-1), by a built-in function: no expression is evaluated for each place."""
    return F.size(F.array_remove(segments, F.lit(-1)))


def bounds(segments: Column) -> Column:
    """array<struct<first, last>>: a query sees the keys of its own segment up to itself; a padding query all earlier keys that are not padding.

    Segments lie side by side, numbered from 0, with padding (-1) at the end. Both ends are whole arrays of built-in
    functions, and one search finds where a segment begins: no expression is evaluated for each place.
    """
    s, used = segments, places(segments)
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(F.array_max(s), F.lit(0))), lambda n: n <= F.array_max(s))
    begins = F.transform(numbers, lambda n: (F.array_position(s, n) - 1).cast("int"))
    run = lambda t: F.transform(t["b"], lambda first, n: F.array_repeat(first, F.coalesce(F.get(t["b"], n + 1), t["u"]) - first))
    firsts = F.flatten(let(F.struct(begins.alias("b"), used.alias("u")), run))
    lasts = F.slice(F.sequence(F.lit(0), F.greatest(used - 1, F.lit(0))), F.lit(1), used)
    padding = lambda value: F.array_repeat(value.cast("int"), F.size(s) - used)
    return F.arrays_zip(F.concat(firsts, padding(F.lit(0))).alias("first"), F.concat(lasts, padding(used - 1)).alias("last"))


def sees(bound: Column, key: Column) -> Column:
    """Whether the query of this bound sees a key."""
    return (key >= bound["first"]) & (key <= bound["last"])


def mask_row(bound: Column, size: Column) -> Column:
    """array<boolean>: one query's row of the mask."""
    run = lambda value, n: F.array_repeat(F.lit(value), n)
    return F.concat(run(False, bound["first"]), run(True, bound["last"] - bound["first"] + 1), run(False, size - bound["last"] - 1))


def packed_mask(segments: Column) -> Column:
    """array<array<boolean>>: all rows of the mask."""
    return let(segments, lambda s: F.transform(bounds(s), lambda b: mask_row(b, F.size(s))))


def visible_keys(segments: Column, positions: Column) -> Column:
    """How many keys each query sees, in one pass: its position plus one, or all real keys for padding."""
    real = places(segments)
    return F.zip_with(segments, positions, lambda s, p: F.when(s >= 0, p + 1).otherwise(real))
