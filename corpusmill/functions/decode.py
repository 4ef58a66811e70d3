"""Next-token filters over logits arrays. Ids are places in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:  # noqa: ANN001
    """f of a value that is computed once, not wherever f uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Seen ids lose: negative logits times the penalty, others divided by it."""
    if penalty <= 0:
        raise ValueError("the penalty must be positive")
    return let(F.array_distinct(seen), lambda used: F.transform(logits, lambda x, i: F.when(F.array_contains(used, i), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x)))


def blocked_by_ngram(ids: Column, n: int) -> Column:
    """Ids that would complete an n-gram already present. Nothing for n <= 1 with a history, as one id has no prefix to meet."""
    none = F.array().cast("array<int>")
    if n <= 1:
        return none

    def found(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - n + 1)
        tail = F.slice(h, F.greatest(F.size(h) - n + 2, F.lit(1)), F.lit(n - 1))
        hits = let(tail, lambda t: F.filter(starts, lambda i: F.slice(h, i, F.lit(n - 1)) == t))
        return F.array_distinct(F.transform(hits, lambda i: F.element_at(h, i + (n - 1)).cast("int")))

    return F.when(F.size(ids) >= n, let(ids, found)).otherwise(none)


def block(logits: Column, ids: Column) -> Column:
    return let(ids, lambda own: F.transform(logits, lambda x, i: F.when(F.array_contains(own, i), F.lit(float("-inf"))).otherwise(x)))


def top_k(logits: Column, k: int) -> Column:
    """Keep logits of at least the k-th value, ties included; 0 keeps all."""
    if k <= 0:
        return logits
    def keep(x: Column) -> Column:
        kth = F.element_at(F.reverse(F.array_sort(x)), F.least(F.lit(k), F.size(x)))
        return let(kth, lambda low: F.transform(x, lambda v: F.when(v >= low, v).otherwise(F.lit(float("-inf")))))

    return let(logits, keep)


def softmax(logits: Column) -> Column:
    def shares(x: Column) -> Column:
        parts = let(F.array_max(x), lambda high: F.transform(x, lambda v: F.exp(v - high)))
        return let(parts, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(p, lambda v: v / total)))

    return let(logits, shares)


def top_p(logits: Column, p: float) -> Column:
    """Keep the ids, by falling logit, until their probability passes p; the one that passes it stays."""
    if not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    if p == 1:
        return logits
    def cut(x: Column) -> Column:
        zipped = F.arrays_zip(softmax(x).alias("p"), x.alias("l"))
        ranked = F.array_sort(F.transform(zipped, lambda v, i: F.struct((-v["l"]).alias("n"), i.alias("i"), v["p"].alias("p"))))
        state = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("n"), F.lit(-1).alias("i"))
        step = lambda s, v: F.struct((s["sum"] + v["p"]).alias("sum"), F.when(s["sum"] <= p, v["n"]).otherwise(s["n"]).alias("n"), F.when(s["sum"] <= p, v["i"]).otherwise(s["i"]).alias("i"))
        last = F.aggregate(ranked, state, step, lambda s: F.struct(s["n"].alias("n"), s["i"].alias("i")))
        # all up to the last kept one, in one pass
        return let(last, lambda t: F.transform(x, lambda v, i: F.when((-v < t["n"]) | ((-v == t["n"]) & (i <= t["i"])), v).otherwise(F.lit(float("-inf")))))

    return let(logits, cut)


def top_k_rows(logits: DataFrame, row: str, logit: str, k: int) -> DataFrame:
    """The same over a table of one logit a row (row, id, logit): each task keeps k of a row's logits and their ties before any move."""
    if k <= 0:
        return logits
    place = F.rank().over(Window.partitionBy(row).orderBy(F.desc(logit)))
    return logits.withColumn("place_", place).filter(F.col("place_") <= k).drop("place_")


def top_p_rows(logits: DataFrame, row: str, token: str, logit: str, p: float) -> DataFrame:
    """The same over a table of one logit a row: a row's logits are summed up where they lie, then ranked."""
    if not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    if p == 1:
        return logits
    high = logits.groupBy(row).agg(F.max(logit).alias("high_"))
    shares = logits.join(high, row).withColumn("share_", F.exp(F.col(logit) - F.col("high_"))).drop("high_")
    whole = Window.partitionBy(row)
    before = F.coalesce(F.sum("share_").over(whole.orderBy(F.desc(logit), token).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return shares.withColumn("before_", before).withColumn("total_", F.sum("share_").over(whole)).filter(F.col("before_") <= p * F.col("total_")).drop("share_", "before_", "total_")


def kept_ids(logits: Column) -> Column:
    numbered = F.transform(logits, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda s: s["x"] > float("-inf")), lambda s: s["i"])


def greedy(logits: Column) -> Column:
    """The id of the largest logit, the smallest of equals."""
    return let(logits, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def sample(logits: Column, u: Column) -> Column:
    """Inverse-CDF choice for a given u in [0, 1)."""
    p = softmax(logits)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("pick"), F.lit(-1).alias("last"))
    step = lambda s, x: F.struct((s["sum"] + x["p"]).alias("sum"), F.when((s["pick"] < 0) & (u < s["sum"] + x["p"]), x["i"]).otherwise(s["pick"]).alias("pick"), F.when(x["p"] > 0, x["i"]).otherwise(s["last"]).alias("last"))
    return F.aggregate(F.transform(p, lambda x, i: F.struct(x.alias("p"), i.alias("i"))), state, step, lambda s: F.when(s["pick"] >= 0, s["pick"]).otherwise(s["last"]))


def next_token(logits: Column, history: Column, penalty: float = 1.0, ngram: int = 0, temperature: float = 1.0, k: int = 0, p: float = 1.0, u: Column | None = None) -> Column:
    """Penalty, then n-gram blocks, then greedy (u None) or temperature, top-k, top-p and a draw."""
    out = block(repetition_penalty(logits, history, penalty), blocked_by_ngram(history, ngram))
    if u is None:
        return greedy(out)
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    return sample(top_p(top_k(F.transform(out, lambda x: x / temperature), k), p), u)


def generate(prompt: Column, provider: Callable[[Column], Column], most: int, stops: list[int], u: Column | None = None, **selection: float) -> Column:
    """At most `most` ids after the prompt, within a row: `provider` gives the logits of the next id from all ids so far.

    The id that stops is the last one. `u` has a number in [0, 1) for each step (None: greedy); `selection`
    goes to next_token, whose history is the prompt and what was made.
    """
    if most <= 0:
        raise ValueError("the number of new tokens must be positive")

    def step(state: Column, i: Column) -> Column:
        ids = F.concat(state["prompt"], state["made"])
        draw = None if u is None else F.element_at(u, i)
        # all of a step is within the lambda of the state: nothing is looked at once a stop was made
        new = F.when(state["done"], F.lit(None).cast("int")).otherwise(let(ids, lambda own: next_token(provider(own), own, u=draw, **selection)).cast("int"))
        return let(F.struct(state.alias("s"), new.alias("new")), lambda x: F.struct(x["s"]["prompt"].alias("prompt"), F.when(x["new"].isNull(), x["s"]["made"]).otherwise(F.array_append(x["s"]["made"], x["new"])).alias("made"), (x["s"]["done"] | F.coalesce(x["new"].isin(stops), F.lit(False))).alias("done")))

    ids = F.transform(prompt, lambda x: x.cast("int"))
    start = F.struct(ids.alias("prompt"), F.array().cast("array<int>").alias("made"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["made"])


#: The characters that Python's str.strip() takes off.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def asks_to_end(text: Column) -> Column:
    """Whether an input line ends a session: fixed values."""
    return stripped(text).isin("", "exit", "quit")
