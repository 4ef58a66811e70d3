"""Queries over the supplied tables, each with the SQL that it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import decode, numeric
from corpusmill.functions.bpe import SPECIAL, Bpe, decode_udf, encode_udf, inspected, pretoken_counts
from corpusmill.functions.bpe import byte_tokens as tokens_of_bytes
from corpusmill.functions.bpe_training import train_any, train_partitioned
from corpusmill.functions.table_functions import register as register_table_functions
from corpusmill.operators import chat, mask, pack, split
from corpusmill.operators.segment import segments
from corpusmill.plans import jobs
from corpusmill.sources.corpus import CorpusCase, block_shard, chain, instruction_chats, limit_batches, preview, read_cache, read_instructions, scan, take, write_cache, write_generations, write_metrics
from corpusmill.sources.files import work_folder

MAX_LEN, RANKS = 1024, 8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def case(sf: str, name: str, table: str, column: str = "text", **limits: int) -> CorpusCase:
    return CorpusCase(name, "synthetic", "mixed", f"{sf}/{table}.parquet", "default", "train", column, **limits)


# --- sources, splits, order ------------------------------------------------------------------------


@query("SELECT substring(text, 1, 100) AS text, doc_id FROM documents ORDER BY doc_id LIMIT 200")
def corpus_take_truncate(spark: SparkSession, sf: str) -> DataFrame:
    own = case(sf, "documents", "documents", sample_count=200, max_chars=100)
    out = take(scan(spark, own), own, ["doc_id"])
    return out.select("text", F.col("order_0").alias("doc_id"))


@query("SELECT 0 AS case_ordinal, doc_id AS ordinal, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark")
def corpus_chain(spark: SparkSession, sf: str) -> DataFrame:
    cases = [(case(sf, "documents", "documents"), "doc_id"), (case(sf, "benchmark", "benchmark"), "item_id")]
    return chain([take(scan(spark, c), c, [order]) for c, order in cases]).select("case_ordinal", F.col("order_0").alias("ordinal"), "text")


MD5_BUCKET = "CAST(CAST('0x' || substring(md5(text), 1, 16) AS UBIGINT) % 100 AS INTEGER)"


@query(f"SELECT {MD5_BUCKET} AS bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def split_md5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(split.bucket(F.col("text"), 100, "md5").alias("bucket")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT doc_id, CASE WHEN {MD5_BUCKET} = 7 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_labels(spark: SparkSession, sf: str) -> DataFrame:
    return split.label_split(table(spark, sf, "documents").select("doc_id", "text"), "text", 100, 7, "md5").select("doc_id", "split")


@query(f"SELECT doc_id FROM documents WHERE {MD5_BUCKET} <> 7")
def split_train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split.keep_buckets(table(spark, sf, "documents"), "text", 100, split.train_indexes(100, 7), "md5").select("doc_id")


@query()
def split_blake2b(spark: SparkSession, sf: str) -> DataFrame:
    return split.label_split(table(spark, sf, "documents").select("doc_id", "text"), "text", 100, 0).select("doc_id", "split")


@query(f"""SELECT doc_id, p AS pass_index, (row_number() OVER (PARTITION BY p ORDER BY md5(CAST(17 + p AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % {RANKS} AS rank
FROM documents, (SELECT unnest([0, 1]) AS p)""")
def shuffle_rank_partition(spark: SparkSession, sf: str) -> DataFrame:
    out = split.ranks(split.passes(table(spark, sf, "documents").select("doc_id"), "doc_id", 17, 2), "doc_id", RANKS)
    return out.select("doc_id", "pass_index", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, substring(text, 1, 100) AS text FROM documents ORDER BY doc_id LIMIT 5")
def corpus_preview(spark: SparkSession, sf: str) -> DataFrame:
    return preview(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], ["text"])


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 96")
def validation_batches(spark: SparkSession, sf: str) -> DataFrame:
    return limit_batches(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], 16, 6)


@query("SELECT CAST(item_id AS BIGINT) AS item_id, text AS prompt, 'assistant' AS answer_role, text AS answer FROM benchmark")
def instruction_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = read_instructions(spark, case(sf, "benchmark", "benchmark"), "text", "text", keep=["item_id"])
    user, reply = F.col("messages")[0], F.col("messages")[1]
    return out.select(F.col("item_id").cast("long").alias("item_id"), user["content"].alias("prompt"), reply["role"].alias("answer_role"), reply["content"].alias("answer"))


@query("SELECT substring(text, 1, 100) AS text, doc_id AS place FROM documents ORDER BY doc_id LIMIT 200")
def corpus_take_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the files as they lie, without an ordering column; a row's place is its number in the file."""
    own = case(sf, "documents", "documents", sample_count=200, max_chars=100)
    return take(scan(spark, own), own).select("text", F.col("order_1").alias("place"))


@query("SELECT count(*) AS n, true AS each_has_one_shard FROM documents")
def corpus_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All rows labelled with shards by their place in files, and read again shard by shard."""
    docs, shard = scan(spark, case(sf, "documents", "documents")), block_shard(4, 50)
    parts = [docs.filter(shard == k).select(shard.alias("shard"), F.lit(k).alias("k")) for k in range(4)]
    return reduce(DataFrame.union, parts).agg(F.count("*").alias("n"), F.bool_and(F.col("shard") == F.col("k")).alias("each_has_one_shard"))


@query("SELECT CAST(doc_id AS BIGINT) AS example_no, n_chars FROM documents ORDER BY doc_id LIMIT 64")
def cache_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written, read through the guard, written again over the first."""
    path, facts = f"{work_folder(spark, 'cache')}/validation", {"corpus_signature": case(sf, "documents", "documents").signature()}
    examples = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("example_no"), "n_chars")
    for _ in range(2):
        write_cache(examples, path, 64, 1024, facts)
    return read_cache(spark, path, 64, 1024, facts).select("example_no", "n_chars")


@query("SELECT doc_id AS sample_index, text AS prompt, n_chars AS global_step FROM documents")
def generations_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark, "generations")
    records = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_index"), F.col("text").alias("prompt"), F.col("n_chars").alias("global_step"))
    write_generations(records, folder, 3)
    return spark.read.schema(records.schema).json(f"{folder}/step-3")


@query("SELECT vec_id AS step, label AS epoch FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings")
def metrics_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark, "metrics")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("step"), F.col("label").alias("epoch"))
    for shift in (0, 1000000):
        write_metrics(rows.withColumn("step", F.col("step") + shift), folder)
    return spark.read.schema(rows.schema).option("header", True).csv(folder)


# --- tokens, segments, packing ---------------------------------------------------------------------

BYTES = Bpe()


def byte_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", encode_udf(BYTES)("text").alias("tokens"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens, CAST(strlen(text) - strlen(replace(text, ' ', '')) AS BIGINT) AS n_spaces FROM documents")
def byte_tokens(spark: SparkSession, sf: str) -> DataFrame:
    space = BYTES.token_to_id("Ġ")
    spaces = F.size(F.filter("tokens", lambda x: x == space)).cast("long")
    return byte_documents(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), spaces.alias("n_spaces"))


SEGMENT_SQL = f"""SELECT doc_id, CAST(s AS BIGINT) AS segment_no, CAST(least({MAX_LEN}, strlen(text) + 1 - s * {MAX_LEN}) AS BIGINT) AS size
 FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 1 + {MAX_LEN} - 1) // {MAX_LEN})) AS s FROM documents)"""


@query(SEGMENT_SQL)
def doc_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = segments(byte_documents(spark, sf), "tokens", MAX_LEN, SPECIAL["bos"], SPECIAL["eos"])
    return out.select("doc_id", F.col("segment_no").cast("long").alias("segment_no"), F.size("inputs").cast("long").alias("size"))


def packed(spark: SparkSession, sf: str, *arrays: str) -> DataFrame:
    docs = split.ranks(split.passes(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 17), "doc_id", RANKS)
    dealt = pack.deal(docs, ["shuffle_key", "doc_id"], RANKS)
    return pack.pack_texts(dealt, BYTES, "documents", MAX_LEN, SPECIAL["bos"], SPECIAL["eos"], arrays=arrays)


@query(f"SELECT size, count(*) AS n FROM ({SEGMENT_SQL}) GROUP BY size")
def pack_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """How many places each segment has in its example."""
    own = lambda n: F.size("segments") - F.size(F.array_remove("segments", n))
    sizes = F.transform(F.sequence(F.lit(0), F.array_max("segments")), own)
    return packed(spark, sf, "segments").select(F.explode(sizes).alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query()
def pack_fill_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = packed(spark, sf, "segments").select("rank", mask.places(F.col("segments")).alias("used"))
    return out.groupBy("rank").agg(F.count("*").alias("examples"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * MAX_LEN)).alias("fill"))


@query(f"""SELECT true AS sound, CAST(sum(strlen(text) + 1) AS BIGINT) AS tokens FROM documents""")
def padded_layout(spark: SparkSession, sf: str) -> DataFrame:
    rest = lambda c, v: F.forall(F.slice(c, F.col("used") + 1, F.lit(MAX_LEN)), lambda x: x == v)
    same = (F.size("inputs") == MAX_LEN) & (F.size("labels") == MAX_LEN) & (F.size("positions") == MAX_LEN) & (F.size("segments") == MAX_LEN)
    sound = same & rest("inputs", 0) & rest("labels", 0) & rest("positions", 0) & rest("segments", -1)
    out = packed(spark, sf, *pack.ARRAYS).withColumn("used", mask.places(F.col("segments")))
    return out.agg(F.bool_and(sound).alias("sound"), F.sum("used").cast("long").alias("tokens"))


@query(f"SELECT CAST(sum(size * (size + 1) // 2) AS BIGINT) AS visible FROM ({SEGMENT_SQL})")
def mask_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The masks of all packed documents as intervals: how many pairs of query and key they hold, padding left out."""
    real = F.slice(mask.bounds(F.col("segments")), F.lit(1), mask.places(F.col("segments")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return packed(spark, sf, "segments").select(real.alias("real")).agg(F.sum(total(F.col("real.last")) - total(F.col("real.first")) + F.size("real")).alias("visible"))


@query(SEGMENT_SQL)
def sql_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments by the table function, called from SQL."""
    register_table_functions(spark)
    table(spark, sf, "documents").select("doc_id", tokens_of_bytes(F.col("text")).alias("tokens")).createOrReplaceTempView("corpusmill_docs")
    return spark.sql(f"SELECT doc_id, CAST(segment_no AS BIGINT) AS segment_no, CAST(size(inputs) AS BIGINT) AS size FROM token_segments(TABLE(corpusmill_docs), max_len => {MAX_LEN}, bos => {SPECIAL['bos']}, eos => {SPECIAL['eos']})")


@query(f"SELECT CAST(doc_id % {RANKS} AS BIGINT) AS rank, CAST(sum(strlen(text) + 1) AS BIGINT) AS tokens, CAST(sum((strlen(text) + {MAX_LEN}) // {MAX_LEN}) AS BIGINT) AS segments FROM documents GROUP BY 1")
def sql_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents segmented and packed in SQL, a packer for each partition of the call: a rank's slice, of which there are more in a larger corpus."""
    register_table_functions(spark)
    docs = table(spark, sf, "documents")
    own = split.place_in_order(split.shuffle_key(F.col("doc_id"), jobs.SEED), jobs.slice_count(docs, "text"))
    ids = docs.select("doc_id", (F.col("doc_id") % RANKS).alias("rank"), own.alias("slice"), tokens_of_bytes(F.col("text")).alias("tokens"))
    ids.createOrReplaceTempView("corpusmill_docs")
    return spark.sql(f"""WITH s AS (SELECT * FROM token_segments(TABLE(corpusmill_docs), max_len => {MAX_LEN}, bos => {SPECIAL['bos']}, eos => {SPECIAL['eos']}))
     SELECT rank, CAST(sum(size(filter(segments, x -> x >= 0))) AS BIGINT) AS tokens, CAST(sum(array_max(segments) + 1) AS BIGINT) AS segments
     FROM pack_best_fit(TABLE(s) PARTITION BY (rank, slice) ORDER BY (doc_id, segment_no), corpus => 'documents', max_len => {MAX_LEN}, keep => 'rank') GROUP BY rank""")


@query(f"SELECT CAST(sum(size * (size + 1) // 2) AS BIGINT) AS visible FROM ({SEGMENT_SQL})")
def packed_mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    seen = mask.visible_keys(F.col("segments"), F.col("positions"))
    real = F.slice(seen, F.lit(1), mask.places(F.col("segments")))
    return packed(spark, sf, "positions", "segments").agg(F.sum(F.aggregate(real, F.lit(0).cast("long"), lambda a, x: a + x)).alias("visible"))


WORLD, SLICES = 3, 6
ORDER_KEY = "md5('17:' || CAST(doc_id AS VARCHAR))"
PLACE_SQL = f"CAST('0x' || substring({ORDER_KEY}, 1, 8) AS UBIGINT)"


@query(f"""SELECT CAST(p * {SLICES} // 4294967296 AS INTEGER) AS slice, CAST((n - 1) % {WORLD} AS INTEGER) AS rank, CAST(sum(size) AS BIGINT) AS tokens, CAST(sum((size + {MAX_LEN} - 1) // {MAX_LEN}) AS BIGINT) AS segments
 FROM (SELECT {PLACE_SQL} AS p, row_number() OVER (ORDER BY {ORDER_KEY}, doc_id) AS n, strlen(text) + 1 AS size FROM documents) GROUP BY 1, 2""")
def pack_slices(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed by (rank, slice): what each packer took."""
    own = case(sf, "documents", "documents")
    out = jobs.examples(table(spark, sf, "documents"), "doc_id", BYTES, own, MAX_LEN, WORLD, slices=SLICES, arrays=["segments"])
    return out.groupBy("slice", "rank").agg(F.sum(mask.places(F.col("segments"))).cast("long").alias("tokens"), F.sum(F.array_max("segments") + 1).cast("long").alias("segments"))


CACHED, CACHE_SLICE = 100, 20_000


@query(f"""SELECT doc_id, CAST(size AS BIGINT) AS n_inputs, CAST(before // {CACHE_SLICE} AS INTEGER) AS slice
 FROM (SELECT doc_id, size, sum(size) OVER (ORDER BY {ORDER_KEY}, doc_id) - size AS before FROM (SELECT doc_id, strlen(text) + 1 AS size FROM documents)) WHERE before < {CACHED * MAX_LEN}""")
def exact_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, by seeded order, that give so many examples, and the slices they are packed in."""
    out = jobs.first_documents(table(spark, sf, "documents"), "doc_id", BYTES, "text", CACHED, MAX_LEN, work_folder(spark, "prefix"), slice_tokens=CACHE_SLICE)
    return out.select(F.col("key").alias("doc_id"), "n_inputs", "slice")


@query(f"SELECT range AS example_no, {MAX_LEN} AS size, true AS sound FROM range({CACHED})")
def packed_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly so many packed examples of the corpus, written as a cache and read through its guard."""
    own, path = case(sf, "documents", "documents"), f"{work_folder(spark, 'packed-cache')}/validation"
    facts = {"corpus_signature": own.signature()}
    jobs.validation_cache(table(spark, sf, "documents"), "doc_id", BYTES, own, path, CACHED, MAX_LEN, facts, slice_tokens=CACHE_SLICE)
    used = F.filter(F.arrays_zip("inputs", "labels", "segments"), lambda x: x["segments"] >= 0)
    shifted = F.forall(F.sequence(F.lit(1), F.size("u") - 1), lambda i: (F.get("u", i)["segments"] != F.get("u", i - 1)["segments"]) | (F.get("u", i)["inputs"] == F.get("u", i - 1)["labels"]))
    return read_cache(spark, path, CACHED, MAX_LEN, facts).withColumn("u", used).select("example_no", F.size("inputs").alias("size"), ((F.size("u") < 2) | shifted).alias("sound"))


@query("SELECT doc_id, text FROM documents")
def bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    bpe = train_any(docs, "text", 1000)
    return docs.select("doc_id", decode_udf(bpe)(encode_udf(bpe)("text")).alias("text"))


@query()
def bpe_merges(spark: SparkSession, sf: str) -> DataFrame:
    """The first merges of a vocabulary over all documents, trained over partitioned tables. Rounds of merges are beyond SQL; tests hold it against the public trainer."""
    merges = train_partitioned(table(spark, sf, "documents").select("text"), "text", 340).merges
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left_id int, right_id int")


@query()
def pretoken_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All pre-tokens of all documents: their pattern looks ahead, which SQL's regular expressions can't."""
    return pretoken_counts(table(spark, sf, "documents"), "text").select("pretoken", "n")


# --- chat ------------------------------------------------------------------------------------------


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return chat.conversations(table(spark, sf, "conversations").withColumn("tokens", encode_udf(BYTES)("text")))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM conversations)
SELECT conv_id, CAST(2 + sum(strlen(text) + 2) AS BIGINT) AS n_ids,
 CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN strlen(text) + 1 + CAST(last AS INT) END), 0) AS BIGINT) AS n_targets,
 CAST(least(1 + sum(strlen(text) + 2), {MAX_LEN}) AS BIGINT) AS n_inputs FROM t GROUP BY conv_id""")
def chat_loss_mask(spark: SparkSession, sf: str) -> DataFrame:
    items = chats(spark, sf).select("conv_id", chat.serialized(F.col("messages")).alias("items"))
    out = items.withColumn("example", chat.example(F.col("items"), MAX_LEN))
    return out.select("conv_id", F.size("items").cast("long").alias("n_ids"), F.size(F.filter("items", lambda x: x["target"])).cast("long").alias("n_targets"), F.size(F.filter("example.input_ids", lambda x: x != 0)).cast("long").alias("n_inputs"))


@query("SELECT conv_id, CAST(2 + sum(strlen(text) + 2) AS BIGINT) AS n_ids FROM conversations GROUP BY conv_id")
def chat_prompt_length(spark: SparkSession, sf: str) -> DataFrame:
    return chats(spark, sf).select("conv_id", F.size(chat.chat_prompt(F.col("messages"))).cast("long").alias("n_ids"))


@query("""SELECT conv_id, turn, text AS prompt, next_text AS answer FROM (SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def sft_pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    after = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    pairs = turns.filter("role = 'user'").select("conv_id", "turn", "text").join(after, ["conv_id", "turn"])
    out = instruction_chats(pairs, keep=["conv_id", "turn"])
    return out.select("conv_id", "turn", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("answer"))


@query(f"""SELECT doc_id, CAST(least(128, greatest(1, (doc_id % n + 1) // 2)) AS BIGINT) AS n
 FROM (SELECT doc_id, least({MAX_LEN}, strlen(text) + 1) AS n FROM documents)""")
def validation_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The inputs as if their first segment ended somewhere within them."""
    first = segments(byte_documents(spark, sf), "tokens", MAX_LEN, SPECIAL["bos"], SPECIAL["eos"]).filter("segment_no = 0")
    own = (F.col("doc_id") % F.size("inputs") + 1).cast("int")
    parts = F.transform("inputs", lambda x, i: F.when(i < own, 0).otherwise(1))
    return first.select("doc_id", F.size(chat.validation_prompt(F.col("inputs"), parts)).cast("long").alias("n"))


@query("SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_ids, CAST(2 AS INTEGER) AS first_id, CAST(strlen(replace(text, ' ', '')) + 1 AS BIGINT) AS n_left FROM documents")
def continuation_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The start, then the text; and what is left when an id is taken out."""
    ids = F.transform(chat.continuation_prompt(F.col("tokens")), lambda x: x.cast("int"))
    return byte_documents(spark, sf).select("doc_id", F.size(ids).cast("long").alias("n_ids"), ids[0].alias("first_id"), F.size(chat.without_stops(ids, [BYTES.token_to_id("Ġ")])).cast("long").alias("n_left"))


CHAT_LABELS_SQL = f"""WITH t AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 8 ELSE 9 END AS marker, role = 'assistant' AS mine,
 list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c) + 100) AS ids FROM conversations),
m AS (SELECT conv_id, turn, mine, list_concat([marker], ids, [12]) AS ids, list_concat([false], list_transform(ids, lambda x: mine), [mine]) AS mask FROM t),
c AS (SELECT conv_id, list_concat([2], flatten(list(ids ORDER BY turn)), [3]) AS ids, list_concat([false], flatten(list(mask ORDER BY turn)), [last(mine ORDER BY turn)]) AS mask FROM m GROUP BY conv_id),
l AS (SELECT conv_id, ids, list_transform(range(2, least(len(ids), {MAX_LEN} + 1) + 1), lambda i: CASE WHEN mask[i] THEN ids[i] ELSE 0 END) AS labels FROM c)
SELECT conv_id, md5(array_to_string(ids[1:least(len(ids) - 1, {MAX_LEN})], ',')) AS inputs, md5(array_to_string(labels, ',')) AS labels FROM l"""


@query(CHAT_LABELS_SQL)
def chat_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Shifted ids and labels themselves, with code points for a tokenizer."""
    code = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c) + 100)
    own = chat.conversations(table(spark, sf, "conversations").withColumn("tokens", code))
    out = own.select("conv_id", F.size(chat.serialized(F.col("messages"))).alias("n"), chat.example(chat.serialized(F.col("messages")), MAX_LEN).alias("e"))
    shown = lambda c: F.md5(F.array_join(F.slice(c, F.lit(1), F.least(F.col("n") - 1, F.lit(MAX_LEN))), ","))
    return out.select("conv_id", shown("e.input_ids").alias("inputs"), shown("e.labels").alias("labels"))


@query("SELECT doc_id, text, text AS decoded_text, CAST(strlen(text) AS BIGINT) AS n_ids, CAST(strlen(text) AS BIGINT) AS n_shown FROM documents")
def encode_inspector(spark: SparkSession, sf: str) -> DataFrame:
    """What the JSON form says of each text, read back."""
    out = inspected(table(spark, sf, "documents").select("doc_id", "text"), "text", BYTES)
    back = F.from_json("inspection", "text string, ids array<int>, decoded_text string, formatted_tokens array<string>").alias("back")
    return out.select("doc_id", back).select("doc_id", "back.text", "back.decoded_text", F.size("back.ids").cast("long").alias("n_ids"), F.size("back.formatted_tokens").cast("long").alias("n_shown"))


@query(f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens FROM documents")
def byte_tokens_native(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ids by built-in functions, held against the tokenizer's own: none may differ."""
    ids = table(spark, sf, "documents").select("doc_id", tokens_of_bytes(F.col("text")).alias("native"), encode_udf(BYTES)("text").alias("tokens"))
    return ids.select("doc_id", F.when(F.col("native") == F.col("tokens"), F.size("native")).cast("long").alias("n_tokens"))


@query("SELECT item_id, CAST(sum(size * (size + 1) // 2) AS BIGINT) AS visible, true AS padding_sees_all FROM (SELECT item_id, CAST(least(64, strlen(text) + 1 - s * 64) AS BIGINT) AS size FROM (SELECT item_id, text, unnest(range(0, (strlen(text) + 64) // 64)) AS s FROM benchmark)) GROUP BY item_id")
def packed_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The mask itself, over examples of 64 places packed from one item each."""
    items = table(spark, sf, "benchmark").withColumn("rank", F.col("item_id").cast("int"))
    own = segments(items.select("rank", encode_udf(BYTES)("text").alias("tokens")).repartition("rank").sortWithinPartitions("rank"), "tokens", 64, SPECIAL["bos"], SPECIAL["eos"])
    seen = F.zip_with(mask.packed_mask(F.col("segments")), "segments", lambda row, s: F.struct(F.size(F.filter(row, lambda x: x)).alias("n"), s.alias("s")))
    out = pack.pack(own, "benchmark", 64).select("rank", seen.alias("seen"), F.size(F.filter("segments", lambda s: s >= 0)).alias("used"))
    total = F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + F.when(x["s"] >= 0, x["n"]).otherwise(0))
    padding = F.forall("seen", lambda x: (x["s"] >= 0) | (x["n"] == F.col("used")))
    return out.groupBy("rank").agg(F.sum(total).alias("visible"), F.bool_and(padding).alias("padding_sees_all")).join(items.select("rank", "item_id"), "rank").select("item_id", "visible", "padding_sees_all")


# --- decoding and numeric kernels ------------------------------------------------------------------

LOGITS = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS x FROM embeddings"
EACH = f"SELECT vec_id, unnest(x) AS l, unnest(range(len(x))) AS i FROM ({LOGITS})"


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10).alias("x"))


def logit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", F.posexplode("x").alias("token", "logit"))


def ids(c: Column) -> Column:
    return F.array_join(c, ",").alias("kept")


@query(f"""SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS kept FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY l DESC) AS r FROM ({EACH})) WHERE r <= 8 GROUP BY vec_id""")
def topk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", ids(decode.kept_ids(decode.top_k(F.col("x"), 8))))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS token, l AS logit FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY l DESC) AS r FROM ({EACH})) WHERE r <= 8")
def topk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return decode.top_k_rows(logit_rows(spark, sf), "vec_id", "logit", 8)


@query(f"""SELECT vec_id, CAST(i AS INTEGER) AS token, l AS logit FROM (SELECT *, coalesce(sum(e) OVER (PARTITION BY vec_id ORDER BY l DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(e) OVER (PARTITION BY vec_id) AS total
 FROM (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM ({EACH}))) WHERE before <= 0.9 * total""")
def topp_rows(spark: SparkSession, sf: str) -> DataFrame:
    return decode.top_p_rows(logit_rows(spark, sf), "vec_id", "token", "logit", 0.9)


@query(f"""WITH k AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY l DESC) AS r, max(l) OVER (PARTITION BY vec_id) AS m FROM ({EACH})) WHERE r <= 8),
p AS (SELECT *, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY vec_id) AS p FROM k),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY l DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS kept FROM c WHERE before <= 0.85 GROUP BY vec_id""")
def topp_filter(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", ids(decode.kept_ids(decode.top_p(decode.top_k(F.col("x"), 8), 0.85))))


@query(f"""SELECT vec_id, round(sum(CASE WHEN i IN (0, vec_id % 64) THEN CASE WHEN l < 0 THEN l * 1.3 ELSE l / 1.3 END ELSE l END * (i + 1)), 6) AS mark FROM ({EACH}) GROUP BY vec_id""")
def repetition_penalty(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.array(F.lit(0), (F.col("vec_id") % 64).cast("int"))
    out = decode.repetition_penalty(F.col("x"), seen, 1.3)
    weighted = F.transform(out, lambda x, i: x * (i + 1))
    return logits(spark, sf).select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v), 6).alias("mark"))


@query("""WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(x) * 20) AS INTEGER) % 4) AS ids FROM embeddings)
SELECT vec_id, coalesce((SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT ids[i + 2] AS v FROM range(1, len(ids) - 1) t(i)
 WHERE ids[i] = ids[len(ids) - 1] AND ids[i + 1] = ids[len(ids)])), '') AS blocked FROM h""")
def no_repeat_ngram(spark: SparkSession, sf: str) -> DataFrame:
    history = F.transform("embedding", lambda x: F.floor(F.abs(x) * 20).cast("int") % 4)
    blocked = F.array_join(F.array_sort(decode.blocked_by_ngram(history, 3)), ",")
    return table(spark, sf, "embeddings").select("vec_id", blocked.alias("blocked"))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, i) AS r FROM ({EACH})) WHERE r = 1")
def greedy_next(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", decode.next_token(F.col("x"), F.array().cast("array<int>")).alias("token"))


@query(f"""SELECT label, round(sum(CASE WHEN t <> 0 THEN loss END) / sum(CASE WHEN t <> 0 THEN 1 END), 6) AS loss FROM (
 SELECT label, vec_id % 64 AS t, ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[vec_id % 64 + 1] AS loss FROM ({LOGITS}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)) GROUP BY label""")
def masked_ce(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 64).alias("t"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10).alias("x"))
    return rows.groupBy("label").agg(F.round(numeric.masked_mean(numeric.token_loss(F.col("x"), F.col("t")), F.col("t")), 6).alias("loss"))


BATCH, WARMUP, STEPS = 16, 20, 100_000


@query(f"""SELECT doc_id, CAST(before // {BATCH} AS BIGINT) AS step, round(CASE WHEN before // {BATCH} < {WARMUP} THEN 2e-4 * (before // {BATCH}) / {WARMUP} ELSE 2e-5 + 1.8e-4 * 0.5 * (1 + cos(pi() * least(1.0, (before // {BATCH} - {WARMUP}) / {STEPS - WARMUP}))) END, 12) AS rate
 FROM (SELECT doc_id, sum(n) OVER (ORDER BY {ORDER_KEY}, doc_id) - n AS before FROM (SELECT doc_id, (strlen(text) + {MAX_LEN}) // {MAX_LEN} AS n FROM documents))""")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The step at which each document's first segment comes, by seeded order, and the learning rate there."""
    docs = table(spark, sf, "documents").select("doc_id", F.floor((F.octet_length("text") + MAX_LEN) / MAX_LEN).cast("long").alias("n"))
    ordered = docs.withColumn("shuffle_key", split.shuffle_key(F.col("doc_id"), 17))
    ordered = ordered.withColumn("range_", split.place_in_order(F.col("shuffle_key"), RANKS))
    summed = jobs.prefix_sums(ordered, "range_", ["shuffle_key", "doc_id"], "n", "before")
    step = F.floor(F.col("before") / BATCH)
    return summed.select("doc_id", step.alias("step"), F.round(numeric.warmup_cosine(step, 2e-4, 2e-5, WARMUP, STEPS), 12).alias("rate"))


@query("SELECT source, CAST(ceil(count(*) / 32.0) * 3 AS BIGINT) AS steps, CAST(ceil(count(*) / 32.0) * 3 * 16 * 2 * 2 * 1024 AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """What three epochs over each source take on two devices."""
    two, rows = F.lit(2), table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    steps = numeric.sft_steps(F.col("n"), F.lit(16), two, F.lit(3)).cast("long")
    return rows.select("source", steps.alias("steps"), numeric.token_budget(steps, F.lit(16), two, F.lit(2), F.lit(1024)).alias("tokens"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(0, 32), lambda i:
 (embedding[2 * i + 1] * cos((vec_id % 16) * pow(10000, -2.0 * i / 64)) - embedding[2 * i + 2] * sin((vec_id % 16) * pow(10000, -2.0 * i / 64))) * (2 * i + 1)
 + (embedding[2 * i + 1] * sin((vec_id % 16) * pow(10000, -2.0 * i / 64)) + embedding[2 * i + 2] * cos((vec_id % 16) * pow(10000, -2.0 * i / 64))) * (2 * i + 2))), 4) AS mark
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)""")
def rope_rotate(spark: SparkSession, sf: str) -> DataFrame:
    out = numeric.rotate(F.col("embedding").cast("array<double>"), F.col("vec_id") % 16, 64)
    mark = F.aggregate(F.transform(out, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return table(spark, sf, "embeddings").select("vec_id", F.round(mark, 4).alias("mark"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i] * i)) / sqrt(list_sum(list_transform(embedding, lambda x: x * x)) / 64 + 1e-6), 4) AS mark
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)""")
def rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    out = numeric.rms_norm(F.col("embedding").cast("array<double>"), F.transform("embedding", lambda x, i: (i + 1).cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, v: a + v), 4).alias("mark"))


@query(f"""WITH k AS (SELECT * FROM (SELECT *, l / 0.7 AS t, rank() OVER (PARTITION BY vec_id ORDER BY l DESC) AS r FROM ({EACH})) WHERE r <= 8),
p AS (SELECT *, exp(t - max(t) OVER (PARTITION BY vec_id)) AS e FROM k), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY l DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
s AS (SELECT vec_id, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) / sum(p) OVER (PARTITION BY vec_id) AS upto FROM c WHERE before <= 0.85)
SELECT vec_id, CAST(min(i) AS INTEGER) AS token FROM s WHERE upto > (vec_id * 37 % 101) / 101.0 GROUP BY vec_id""")
def sampled_next(spark: SparkSession, sf: str) -> DataFrame:
    """Temperature, top-k, top-p, then a draw by a given number."""
    u = (F.col("vec_id") * 37 % 101) / 101.0
    return logits(spark, sf).select("vec_id", decode.next_token(F.col("x"), F.array().cast("array<int>"), temperature=0.7, k=8, p=0.85, u=u).alias("token"))


@query("""WITH RECURSIVE g(vec_id, last, n) AS (SELECT vec_id, CAST(vec_id % 16 AS INTEGER), 0 FROM embeddings
 UNION ALL SELECT vec_id, CAST((last * 5 + 3) % 16 AS INTEGER), n + 1 FROM g WHERE n < 12 AND (n = 0 OR last <> 7))
SELECT vec_id, string_agg(CAST(last AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n > 0) AS made, coalesce(string_agg(CAST(last AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n > 0 AND last <> 7), '') AS shown FROM g GROUP BY vec_id""")
def greedy_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve steps at most, ending with the stop id; a provider whose best id follows from the last one."""
    provider = lambda ids: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda v: -F.abs(v - (F.element_at(ids, -1) * 5 + 3) % 16).cast("double"))
    made = decode.generate(F.array((F.col("vec_id") % 16).cast("int")), provider, 12, [7])
    out = table(spark, sf, "embeddings").select("vec_id", made.alias("made"))
    return out.select("vec_id", F.array_join("made", ",").alias("made"), F.array_join(chat.without_stops(F.col("made"), [7]), ",").alias("shown"))


STRIPPED = "trim(concat(CASE turn % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ' ' ELSE '' END, CASE WHEN turn % 4 = 3 THEN 'quit' ELSE text END, chr(10)), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT conv_id, turn, {STRIPPED} AS line, {STRIPPED} IN ('', 'exit', 'quit') AS ends FROM conversations")
def input_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of all conversations as typed lines, every fourth asking to end."""
    before = F.when(F.col("turn") % 3 == 0, "\t").when(F.col("turn") % 3 == 1, " ").otherwise("")
    line = F.concat(before, F.when(F.col("turn") % 4 == 3, "quit").otherwise(F.col("text")), F.lit("\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", decode.stripped(line).alias("line"), decode.asks_to_end(line).alias("ends"))


@query("""WITH m AS (SELECT label, avg(l) AS loss FROM (SELECT label, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS l FROM embeddings) GROUP BY label)
SELECT (SELECT count(*) FROM m) AS epochs, (SELECT arg_min(label, loss) FROM m) AS best, round((SELECT min(loss) FROM m), 9) AS loss""")
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Mean loss of each epoch, and the checkpoint of the least."""
    rows = table(spark, sf, "embeddings").select("label", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("l"))
    epochs = rows.groupBy("label").agg(numeric.mean_loss(F.col("l")).alias("loss"))
    return epochs.agg(F.count("*").alias("epochs"), numeric.best_checkpoint(F.col("label"), F.col("loss")).alias("best"), F.round(F.min("loss"), 9).alias("loss"))


@query("""SELECT 0.0::DOUBLE AS decay, count(DISTINCT label) AS n, CAST(count(DISTINCT label) * 64 AS BIGINT) AS weights FROM embeddings
UNION ALL SELECT 0.01::DOUBLE, count(DISTINCT label), CAST(count(*) * 64 AS BIGINT) FROM embeddings""")
def parameter_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of each label as a matrix, and its norm: which of them decay, and their weights."""
    labels = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("d"))
    named = lambda kind, *shape: F.struct(F.concat(F.lit("block."), "label", F.lit(f".{kind}")).alias("name"), F.lit(kind).alias("kind"), F.array(*shape).alias("shape"))
    rows = labels.select(F.inline(F.array(named("projection", F.col("n"), F.col("d")), named("norm", F.col("d")))))
    return rows.groupBy(numeric.weight_decay(F.col("name"), F.col("kind")).alias("decay")).agg(F.count("*").alias("n"), F.sum(numeric.numel(F.col("shape"))).alias("weights"))


@query("SELECT lang, CAST(ceil(count(*) / 16.0) * 16 * 2 AS BIGINT) AS samples FROM documents GROUP BY lang")
def validation_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The examples of a validation over each language on two devices, in whole batches."""
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.select("lang", numeric.sample_count(F.lit(16), F.ceil(F.col("n") / 16), F.lit(2)).alias("samples"))


ROWS = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"


@query(f"""WITH w AS (SELECT vec_id, e, [list_dot_product(e[1:16], e[17:32]) / 4, list_dot_product(e[1:16], e[33:48]) / 4, list_dot_product(e[1:16], e[49:64]) / 4] AS s FROM ({ROWS}))
SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda j: j * (exp(s[1]) * e[16 + j] + exp(s[2]) * e[32 + j] + exp(s[3]) * e[48 + j]))) / (exp(s[1]) + exp(s[2]) + exp(s[3])), 5) AS mark FROM w""")
def attention_mix(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda k: F.slice(F.col("embedding").cast("array<double>"), 16 * k + 1, 16)
    keys = F.array(part(1), part(2), part(3))
    out = numeric.attention(part(0), keys, keys, 16)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(F.transform(out, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("mark"))


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: i * e[i] / (1 + exp(-e[i])) * e[32 + i])), 5) AS mark FROM ({ROWS})""")
def gated_unit(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda k: F.slice(F.col("embedding").cast("array<double>"), 32 * k + 1, 32)
    out = F.transform(numeric.swiglu(part(0), part(1)), lambda x, i: x * (i + 1))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, v: a + v), 5).alias("mark"))
