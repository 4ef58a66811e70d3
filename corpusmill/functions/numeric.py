"""Schedules, budgets, losses, rotary positions, small layers and facts of training runs as column expressions.

The layers are for small dimensions: they state what a model computes, within a row and without Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.decode import let, softmax


def warmup_cosine(step: Column, highest: float, lowest: float, warmup: int, total: int) -> Column:
    if not 0 <= warmup < total:
        raise ValueError("warmup must lie below the total steps")
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(total - warmup)))
    falling = lowest + (highest - lowest) * 0.5 * (1 + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, highest * step / F.lit(float(max(1, warmup)))).otherwise(falling)


def token_budget(steps: Column, batch: Column, devices: Column, accumulate: Column, max_len: Column) -> Column:
    return steps.cast("long") * batch * devices * accumulate * max_len


def sft_steps(rows: Column, batch: Column, devices: Column, epochs: Column) -> Column:
    return F.ceil(rows / (batch * devices)) * epochs


def log_sum_exp(x: Column) -> Column:
    return let(x, lambda own: let(F.array_max(own), lambda high: high + F.log(F.aggregate(own, F.lit(0.0), lambda a, v: a + F.exp(v - high)))))


def token_loss(logits: Column, label: Column) -> Column:
    return log_sum_exp(logits) - F.element_at(logits, label.cast("int") + 1)


def masked_mean(loss: Column, label: Column, ignore: int = 0) -> Column:
    """An aggregate: the mean loss where the label counts; NaN where none does."""
    n = F.sum(F.when(label != ignore, 1).otherwise(0))
    return F.when(n > 0, F.try_divide(F.sum(F.when(label != ignore, loss)), n)).otherwise(F.lit(float("nan")))


#: The base of rotary positions, the norm's epsilon.
ROTARY_BASE, NORM_EPSILON = 10000.0, 1e-6


def rotate(x: Column, position: Column, dim: int, base: float = ROTARY_BASE) -> Column:
    """Rotary position: pairs of neighbours are turned by position * base^(-2i/dim)."""
    if dim % 2:
        raise ValueError("the dimension must be even")

    def pair(i: Column) -> Column:
        angle = position * F.pow(F.lit(base), -2.0 * i / dim)
        a, b = F.element_at(x, 2 * i + 1), F.element_at(x, 2 * i + 2)
        return F.array(a * F.cos(angle) - b * F.sin(angle), a * F.sin(angle) + b * F.cos(angle))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), pair))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def rms_norm(x: Column, weight: Column, epsilon: float = NORM_EPSILON) -> Column:
    return let(F.sqrt(dot(x, x) / F.size(x) + epsilon), lambda scale: F.zip_with(x, weight, lambda a, w: a / scale * w))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: silu(g) * u)


def linear(weight: Column, x: Column) -> Column:
    """A matrix (array of rows) times a vector."""
    return F.transform(weight, lambda row: dot(row, x))


def feed_forward(x: Column, gate: Column, up: Column, down: Column) -> Column:
    """The gated layer with its three projections, each computed once."""
    return let(swiglu(linear(gate, x), linear(up, x)), lambda h: linear(down, h))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def attention(query: Column, keys: Column, values: Column, dim: int) -> Column:
    """Softmax attention of one query over small arrays of keys and values."""
    weight = softmax(F.transform(keys, lambda k: dot(query, k) / math.sqrt(dim)))
    mixed = F.zip_with(weight, values, lambda w, v: F.transform(v, lambda x: x * w))
    return F.aggregate(mixed, F.array_repeat(F.lit(0.0), dim), add)


def heads_of(x: Column, heads: int, dim: int) -> Column:
    """A vector cut into `heads` parts of `dim` values."""
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(x, h * dim + 1, F.lit(dim)))


def multi_head_attention(queries: Column, keys: Column, values: Column, heads: int, dim: int, past: Column | None = None) -> Column:
    """Causal attention, head by head with rotary positions: one output for each query, its heads side by side.

    `past` is a cache, struct(keys, values) of rotated keys that all lie before the queries.
    """
    if dim % 2:
        raise ValueError("the dimension of a head must be even")
    before = F.lit(0) if past is None else F.size(past["keys"])
    turn = lambda rows: F.transform(rows, lambda x, i: F.flatten(F.transform(heads_of(x, heads, dim), lambda h: rotate(h, i + before, dim))))
    state = F.struct(turn(queries).alias("q"), (turn(keys) if past is None else F.concat(past["keys"], turn(keys))).alias("k"), (values if past is None else F.concat(past["values"], values)).alias("v"))

    def attend(s: Column) -> Column:
        def one(q: Column, i: Column) -> Column:
            seen = lambda rows, h: F.transform(F.slice(rows, F.lit(1), i + 1 + before), lambda r: F.slice(r, h * dim + 1, F.lit(dim)))
            return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: attention(F.slice(q, h * dim + 1, F.lit(dim)), seen(s["k"], h), seen(s["v"], h), dim)))

        return F.struct(F.transform(s["q"], one).alias("outputs"), s["k"].alias("keys"), s["v"].alias("values"))

    return let(state, attend)


def decoder_block(rows: Column, layer: Column, heads: int, dim: int, past: Column | None = None) -> Column:
    """A pre-norm block over a sequence: struct(rows, keys, values). `layer` has norm1, q, k, v, out, norm2, gate, up, down."""
    project = lambda x, w: F.transform(x, lambda r: linear(w, r))
    normed = F.transform(rows, lambda r: rms_norm(r, layer["norm1"]))

    def run(n: Column) -> Column:
        return multi_head_attention(project(n, layer["q"]), project(n, layer["k"]), project(n, layer["v"]), heads, dim, past)

    def rest(a: Column) -> Column:
        middle = F.zip_with(rows, project(a["outputs"], layer["out"]), add)
        finish = lambda r: add(r, feed_forward(rms_norm(r, layer["norm2"]), layer["gate"], layer["up"], layer["down"]))
        return F.struct(F.transform(middle, finish).alias("rows"), a["keys"].alias("keys"), a["values"].alias("values"))

    return let(let(normed, run), rest)


def embed(ids: Column, table: Column) -> Column:
    return F.transform(ids, lambda i: F.element_at(table, i.cast("int") + 1))


def tied_logits(rows: Column, norm: Column, table: Column) -> Column:
    """Logits of each row by the embedding table itself."""
    return F.transform(rows, lambda r: linear(table, rms_norm(r, norm)))


# --- aggregates and metadata of training runs --------------------------------------------------------


def mean_loss(loss: Column) -> Column:
    """An aggregate over the steps or batches of a group."""
    return F.avg(loss)


def best_checkpoint(checkpoint: Column, loss: Column) -> Column:
    """An aggregate: the checkpoint of the least loss, the first of equals; losses that are null or NaN don't count."""
    fine = loss.isNotNull() & ~F.isnan(loss)
    return F.min_by(checkpoint, F.when(fine, F.struct(loss, checkpoint)))


def sample_count(batch: Column, batches: Column, devices: Column) -> Column:
    return batch.cast("long") * batches * devices


def parameters(spark: SparkSession, vocab: int, d_model: int, layers: int, d_ff: int) -> DataFrame:
    """(name, kind, shape) of a decoder's parameters. The output head is tied to the embeddings."""
    block = [("attention.norm", "norm", [d_model]), *((f"attention.{n}", "projection", [d_model, d_model]) for n in "qkvo"), ("feed_forward.norm", "norm", [d_model]), ("feed_forward.gate", "projection", [d_ff, d_model]), ("feed_forward.up", "projection", [d_ff, d_model]), ("feed_forward.down", "projection", [d_model, d_ff])]
    rows = [("embedding", "embedding", [vocab, d_model]), *((f"block.{i}.{n}", kind, shape) for i in range(layers) for n, kind, shape in block), ("norm", "norm", [d_model])]
    return spark.createDataFrame(rows, "name string, kind string, shape array<long>")


def numel(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, n: a * n)


def weight_decay(name: Column, kind: Column, decay: float = 0.01) -> Column:
    """Projections decay; embeddings, norms and biases don't."""
    return F.when(kind.isin("embedding", "norm") | name.endswith(".bias"), F.lit(0.0)).otherwise(F.lit(decay))
