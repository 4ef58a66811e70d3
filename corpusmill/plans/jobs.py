"""Whole jobs, from a corpus to files: tokenizer training, encoding, packed examples, chat examples."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.bpe import SPECIAL, Bpe, Tokenizer, encode_udf, inspected
from corpusmill.functions.bpe_training import train_any
from corpusmill.operators import chat, mask, pack, split
from corpusmill.operators.segment import segments
from corpusmill.plans.settings import MIDTRAINING, POSTTRAINING, PRETRAINING, validate
from corpusmill.sources.corpus import CorpusCase, cache_path, chain, read_instructions, scan, take, write_cache
from corpusmill.sources.files import file_system, write_json, write_model_config
from corpusmill.streaming.passes import run_passes

#: Fixed values of a packed corpus: the name of its packing, the seed of its order.
PACKING, SEED = "best_fit", 17
#: Bytes of text in a slice of a rank's order, ids in a slice of a validation cache.
SLICE_BYTES, SLICE_TOKENS = 64 << 20, 8 << 20
#: For the first guess of how much text gives so many ids: bytes of a token, and how much more is taken.
BYTES_A_TOKEN, SPARE = 4, 1.2


def train_tokenizer(spark: SparkSession, cases: Iterable[tuple[CorpusCase, str | None]], folder: str, vocab_size: int = 65536) -> Bpe:
    """cases: a corpus and the column that orders its rows (None: the order of its files). The tokenizer is saved as a folder."""
    texts = chain([take(scan(spark, case), case, order and [order]) for case, order in cases])
    bpe = train_any(texts, "text", vocab_size)
    bpe.save_folder(spark, folder)
    return bpe


def encode(spark: SparkSession, tokenizer: str, texts: list[str]) -> list[str]:
    """Each text's ids, decoded text and tokens as JSON."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.inspection for r in inspected(rows, "text", Bpe.load(spark, tokenizer)).orderBy("i").select("inspection").collect()]


def slice_count(docs: DataFrame, text: str, size: int = SLICE_BYTES) -> int:
    """So many slices that one has about `size` bytes of text: it follows the corpus, not the cluster."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // size))


def examples(docs: DataFrame, key: str, tokenizer: Tokenizer, case: CorpusCase, max_len: int, world: int = 1, passes: int = 1, seed: int = SEED, slices: int = 1, arrays: Sequence[str] = pack.ARRAYS) -> DataFrame:
    """Packed examples of documents (key, text): seeded order, ranks in slices, segments, best fit.

    What an example holds depends on world, slices and seed alone. Texts move once, to their slice's task.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(case.text_column).alias("text"))
    ordered = split.slices(split.passes(rows, "key", seed, passes, required=True), "key", world, slices)
    return packed(ordered, tokenizer, case, max_len, arrays)


def packed(ordered: DataFrame, tokenizer: Tokenizer, case: CorpusCase, max_len: int, arrays: Sequence[str] = pack.ARRAYS) -> DataFrame:
    """Examples of documents (text) as split.slices leaves them."""
    dealt = pack.in_slices(ordered, ["shuffle_key", "key"])
    return pack.pack_texts(dealt, tokenizer, case.name, max_len, SPECIAL["bos"], SPECIAL["eos"], by=pack.SLICED, arrays=arrays)


def stream_examples(docs: DataFrame, key: str, tokenizer: Tokenizer, case: CorpusCase, max_len: int, folder: str, checkpoint: str, slices: int, world: int = 1, seed: int = SEED, step: int = 1, first: int = 0, last: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Packed examples of pass after pass, `step` slices a micro-batch, without end; the same as examples() makes of those passes.

    Each micro-batch is a folder of its own and replaces what a failed one left there.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(case.text_column).alias("text"))

    def each(ordered: DataFrame, number: int) -> None:
        packed(ordered, tokenizer, case, max_len).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return run_passes(rows, "key", seed, slices, checkpoint, each, world, step, first, last, trigger)


def tokenized(docs: DataFrame, tokenizer: Tokenizer, low: float, high: float) -> DataFrame:
    """Documents (key, text) whose place in the seeded order lies in [low, high) of all, as (shuffle_key, key, tokens); no other text is read further."""
    place = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    part = docs.filter((place >= int(low * (1 << 32))) & (place < int(high * (1 << 32))))
    return part.select("shuffle_key", "key", encode_udf(tokenizer)("text").alias("tokens"))


def first_documents(docs: DataFrame, key: str, tokenizer: Tokenizer, text: str, n: int, max_len: int, folder: str, seed: int = SEED, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """The shortest prefix of the seeded order that gives n packed examples: (shuffle_key, key, tokens, slice, n_inputs).

    Examples hold at most max_len ids, so a prefix with n * max_len ids gives n whichever way it is packed. The
    order is a digest's, so a share of its range is a share of the corpus: a share that should do is tokenized and
    written to `folder`, then, if it falls short, as much more as it lacks. Prefix sums over the written ranges
    then cut the prefix and its slices of `slice_tokens` ids each. What lies beyond is neither tokenized nor sorted.
    """
    spark, need = docs.sparkSession, n * max_len
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("shuffle_key", split.shuffle_key(F.col("key"), seed))
    total = rows.agg(F.sum(F.octet_length("text") / BYTES_A_TOKEN + 1)).first()[0] or 0
    have, low, high, parts = 0, 0.0, min(1.0, SPARE * need / max(total, 1)), 0
    while True:
        tokenized(rows, tokenizer, low, high).write.parquet(f"{folder}/{parts}")
        have += spark.read.parquet(f"{folder}/{parts}").agg(F.sum(F.size("tokens") + 1)).first()[0] or 0
        parts += 1
        if have >= need or high >= 1:
            break
        low, high = high, min(1.0, high * max(1.25, min(16.0, SPARE * need / max(have, 1))))
    held = spark.read.parquet(*[f"{folder}/{k}" for k in range(parts)]).withColumn("n_inputs", (F.size("tokens") + 1).cast("long"))
    ranges = max(1, -(-have // slice_tokens))
    summed = prefix_sums(held.withColumn("range_", split.place_in_order(F.col("shuffle_key"), ranges)), "range_", ["shuffle_key", "key"], "n_inputs", "before_")
    return summed.filter(F.col("before_") < need).withColumn("slice", F.floor(F.col("before_") / slice_tokens).cast("int")).drop("before_", "range_")


def prefix_sums(df: DataFrame, part: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with column `name`: the sum of `value` over all rows before, in the order of (part, order). One number a part is shipped."""
    sums = df.groupBy(part).agg(F.sum(value).alias("sum_"))
    before = sums.select(part, F.coalesce(F.sum("sum_").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sums_"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(name, own).join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("sums_")).drop("sums_")


def first_examples(prefix: DataFrame, case: CorpusCase, max_len: int, n: int, folder: str) -> DataFrame:
    """The first n examples of first_documents' prefix, each slice packed by itself: (example_no, inputs, labels, positions, segments), kept in `folder`."""
    spark = prefix.sparkSession
    dealt = prefix.repartition("slice").sortWithinPartitions("slice", "shuffle_key", "key")
    own = segments(dealt.select("slice", "tokens"), "tokens", max_len, SPECIAL["bos"], SPECIAL["eos"])
    pack.pack(own, case.name, max_len, by=("slice",)).write.parquet(f"{folder}/packed")
    made = spark.read.parquet(f"{folder}/packed")
    counts = made.groupBy("slice").agg(F.count("*").alias("n_"))
    before = counts.select("slice", F.coalesce(F.sum("n_").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("made_"))
    return made.join(F.broadcast(before), "slice").withColumn("example_no", F.col("example_no") + F.col("made_")).filter(F.col("example_no") < n).drop("slice", "made_")


def validation_cache(docs: DataFrame, key: str, tokenizer: Tokenizer, case: CorpusCase, path: str, n: int, max_len: int, metadata: dict, seed: int = SEED, slice_tokens: int = SLICE_TOKENS) -> None:
    """Exactly n packed examples of the first documents, cached at `path`; refused if the corpus gives fewer."""
    spark, work = docs.sparkSession, f"{path}.work-{uuid.uuid4().hex}"
    try:
        prefix = first_documents(docs, key, tokenizer, case.text_column, n, max_len, work, seed, slice_tokens)
        write_cache(first_examples(prefix, case, max_len, n, work), path, n, max_len, metadata)
    finally:
        fs, p = file_system(spark, work)
        fs.delete(p, True)


def pack_corpus(spark: SparkSession, case: CorpusCase, key: str, tokenizer: str, folder: str, settings: dict, inherited: dict | None = None, world: int = 1, passes: int = 1, global_step: int | None = None) -> dict:
    """Write a run's training examples, its validation cache and its config; returns the config.

    Each rank's examples are in slices, as many as the corpus has SLICE_BYTES; a run reads them by pass, slice and number.
    `inherited` is the config of the model that a middle run goes on from.
    """
    validate(settings, MIDTRAINING if inherited is not None else PRETRAINING)
    bpe, max_len = Bpe.load(spark, tokenizer), settings.get("max_len") or (inherited or {}).get("max_len")
    modulo, index = settings["val_split_modulo"], settings["val_split_index"]
    docs, seed = scan(spark, case), split.resumed_seed(SEED, global_step)
    part = lambda indexes: split.keep_buckets(docs, case.text_column, modulo, indexes)
    training = part(split.train_indexes(modulo, index))
    slices = slice_count(training, case.text_column)
    seen, used = Observation(), mask.places(F.col("segments"))
    made = examples(training, key, bpe, case, max_len, world, passes, seed, slices)
    made.observe(seen, F.count(F.lit(1)).alias("examples"), F.sum(used).alias("tokens")).write.mode("overwrite").partitionBy("rank").parquet(f"{folder}/examples")
    samples = settings["batch_size"] * settings["val_batches"] * world
    cache = cache_path(folder, case, PACKING, max_len, samples, modulo, index, settings.get("validation_cache_path") or "")
    validation_cache(part((index,)), key, bpe, case, cache, samples, max_len, {"packing_version": PACKING, "corpus_signature": case.signature(), "corpus_case": case.fields()})
    config = settings | {"max_len": max_len, "device_count": world, "slices": slices, "train_examples": seen.get["examples"], "train_tokens": seen.get["tokens"], "lr_schedule": "warmup_cosine", "corpus_signature": case.signature(), "dataset_case": case.fields()}
    config |= {"global_batch_size": settings["batch_size"] * world, "effective_batch_size": settings["batch_size"] * settings["gradient_accumulation_steps"], "min_learning_rate": settings["learning_rate"] * settings["min_learning_rate_ratio"]}
    config |= {"validation_cache_path": cache, "validation_sample_count": samples, "packing_version": PACKING, "base_shuffle_seed": SEED, "shuffle_seed": seed, **{f"{n}_token_id": SPECIAL[n] for n in ("pad", "bos", "eos")}}
    full = write_model_config(spark, folder, config, inherited)
    bpe.save_folder(spark, folder)
    return full


def chat_examples(spark: SparkSession, case: CorpusCase, tokenizer: str, folder: str, max_len: int, repeat_epochs: int = 1, prompt: str = "text", answer: str = "output") -> int:
    """Write an instruction corpus as (input_ids, labels); returns the number of rows."""
    validate({"repeat_epochs": repeat_epochs}, POSTTRAINING)
    ids = encode_udf(Bpe.load(spark, tokenizer))
    pairs = read_instructions(spark, case, prompt, answer).select(*[F.col("messages")[i]["content"].alias(f"t{i}") for i in (0, 1)])
    message = lambda role, c: F.struct(F.lit(role).alias("role"), ids(c).alias("tokens"))
    items = pairs.select(chat.serialized(F.array(message("user", "t0"), message("assistant", "t1"))).alias("items"))
    seen, made = Observation(), items.select(chat.example(F.col("items"), max_len).alias("e"), F.size(F.filter("items", lambda x: x["target"])).alias("n")).select("e.*", "n")
    facts = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("targets")]
    made.observe(seen, *facts).drop("n").write.mode("overwrite").parquet(f"{folder}/examples")
    n = seen.get["rows"]
    write_json(spark, f"{folder}/run.json", {"rows": n, "targets": seen.get["targets"], "max_len": max_len, "repeat_epochs": repeat_epochs, "dataset_case": case.fields()})
    return n
