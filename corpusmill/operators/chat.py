"""Chat template, loss mask, shifted examples and prompts, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.bpe import SPECIAL

#: The accepted role names and the role each stands for.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system"}


def normalize_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))).cast("string"))


def role_id(role: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for r in ("system", "user", "assistant") for x in (r, SPECIAL[r])]), normalize_role(role))


def conversations(turns: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(conv_id, messages): array<struct<turn, role, tokens>> in order of turns."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col(tokens).alias("tokens")))).alias("messages"))


def serialized(messages: Column) -> Column:
    """array<struct<id, target>>: start, then for each message its marker, content and end of turn, then the end."""
    item = lambda i, t: F.struct(i.cast("int").alias("id"), t.alias("target"))
    one = lambda i, t: F.array(item(F.lit(i) if isinstance(i, int) else i, t if isinstance(t, Column) else F.lit(t)))

    def message(m: Column) -> Column:
        mine = normalize_role(m["role"]) == "assistant"
        return F.concat(one(role_id(m["role"]), False), F.transform(m["tokens"], lambda x: item(x, mine)), one(SPECIAL["end_of_turn"], mine))

    body = F.flatten(F.transform(messages, message))
    last = F.coalesce(normalize_role(F.try_element_at(messages, F.lit(-1))["role"]) == "assistant", F.lit(False))
    last = F.when(F.size(messages) > 0, last).otherwise(F.lit(False))
    return F.concat(one(SPECIAL["bos"], False), body, one(SPECIAL["eos"], last))


def example(items: Column, max_len: int, pad: int = SPECIAL["pad"]) -> Column:
    """struct<input_ids, labels>: shifted by one, cut on the right, labels outside the mask and the rest padded."""
    fill = lambda a: F.concat(a, F.array_repeat(F.lit(pad), F.lit(max_len) - F.size(a)))
    ids = F.transform(F.slice(items, F.lit(1), F.least(F.size(items) - 1, F.lit(max_len))), lambda x: x["id"])
    labels = F.transform(F.slice(items, F.lit(2), F.least(F.size(items) - 1, F.lit(max_len))), lambda x: F.when(x["target"], x["id"]).otherwise(F.lit(pad)))
    return F.struct(fill(ids).alias("input_ids"), fill(labels).alias("labels"))


def chat_prompt(messages: Column) -> Column:
    """Ids that ask for an assistant turn: no end after the last marker."""
    body = F.flatten(F.transform(messages, lambda m: F.concat(F.array(role_id(m["role"])), m["tokens"], F.array(F.lit(SPECIAL["end_of_turn"])))))
    return F.concat(F.array(F.lit(SPECIAL["bos"])), body, F.array(F.lit(SPECIAL["assistant"])))


def continuation_prompt(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(SPECIAL["bos"])), tokens)


def validation_prompt(inputs: Column, segments: Column, most: int = 128) -> Column:
    """The first half of the first segment, one id at least and `most` at most."""
    own = F.transform(F.filter(F.arrays_zip(inputs.alias("i"), segments.alias("s")), lambda x: x["s"] == 0), lambda x: x["i"])
    return F.slice(own, F.lit(1), F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.size(own) / 2).cast("int"))))


def without_stops(ids: Column, stops: list[int]) -> Column:
    return F.filter(ids, lambda x: ~x.isin(stops))
