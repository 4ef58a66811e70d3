"""Files, settings, jobs, layers, streams and packing on small fixtures."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.__main__ import main, parser
from corpusmill.functions import numeric
from corpusmill.functions.bpe import SPECIAL, Bpe, decode_udf, encode_udf, inspected, merge_words
from corpusmill.operators import pack, split
from corpusmill.plans import jobs, settings
from corpusmill.sources import files
from corpusmill.sources.corpus import CorpusCase, cache_path, reshard, scan, scan_stream
from corpusmill.streaming.packing import pack_stream

RUN = {"max_len": 32, "d_model": 12, "num_layers": 2, "num_heads": 3, "d_ff": 16, "learning_rate": 2e-4, "batch_size": 2, "gradient_accumulation_steps": 1, "max_steps": 10, "num_workers": 0, "val_split_modulo": 4, "val_split_index": 1, "val_batches": 1, "val_check_interval": 1, "checkpoint_every_n_steps": 1, "metric_log_every_n_steps": 1, "loss_chunk_size": 8, "lr_warmup_steps": 0, "min_learning_rate_ratio": 0.1}


@pytest.fixture(scope="module")
def bpe():
    rng = random.Random(3)
    return merge_words([("".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9))).strip() or "a", rng.randrange(1, 9)) for _ in range(200)], 330)


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}"


def test_tokenizer_files_and_public_form(spark, at, bpe):
    from tokenizers import Tokenizer

    texts = ["abc dé  abc|<bos>|x", "naïve 漢字 😀\n\n it's", "", "aaaa aaa"]
    public = Tokenizer.from_str(json.dumps(bpe.public()))
    for t in texts:
        ids = bpe.encode(t)
        assert public.encode(t, add_special_tokens=False).ids == ids and public.decode(ids) == bpe.decode(ids)
    bpe.save_folder(spark, f"{at}/tok")
    bpe.save(spark, f"{at}/one.json")
    for path in (f"{at}/tok", f"{at}/tok/tokenizer.json", f"{at}/one.json"):
        assert Bpe.load(spark, path) == bpe
    special = files.read_json(spark, f"{at}/tok/special_tokens_map.json")
    assert special["bos_token"] == "|<bos>|" and special["unk_token"] == "|<unknown>|" and "|<end_of_turn>|" in special["extra_special_tokens"]
    with pytest.raises(FileNotFoundError):
        Bpe.load(spark, f"{at}/none")
    broken = bpe.public()
    broken["model"]["merges"] = broken["model"]["merges"][::-1]
    with pytest.raises(ValueError, match="ids are not"):
        Bpe.loads(json.dumps(broken))


def test_tokenizer_protocol_and_inspection(spark, bpe):
    class Words:
        """Any object with tokenize() serves for packing."""

        def tokenize(self, text):
            return [100 + len(w) for w in text.split()]

    df = spark.createDataFrame([("abc é",), (None,), ("",)], "text string")
    assert [r.t for r in df.select(encode_udf(Words())("text").alias("t")).collect()] == [[103, 101], None, []]
    assert [r.t for r in df.select(decode_udf(bpe)(encode_udf(bpe)("text")).alias("t")).collect()] == ["abc é", None, ""]
    shown = json.loads(inspected(df.limit(1), "text", bpe).first().inspection)
    assert shown["decoded_text"] == shown["text"] == "abc é" and shown["ids"] == bpe.encode("abc é")
    assert shown["formatted_tokens"][0].startswith("a") and "".join(shown["formatted_tokens"]).startswith("abc ")


def test_publish_keeps_the_old_one_until_the_new_one_stands(spark, at, tmp_path):
    files.write_text(spark, f"{at}/x.txt", "one é")
    files.write_text(spark, f"{at}/x.txt", "two")
    assert files.read_text(spark, f"{at}/x.txt") == "two"
    with pytest.raises(FileNotFoundError):
        files.publish(spark, f"{at}/missing", f"{at}/x.txt")
    assert files.read_text(spark, f"{at}/x.txt") == "two"
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.txt"]
    assert files.wait_for(spark, f"{at}/x.txt", 1) == f"{at}/x.txt"
    with pytest.raises(TimeoutError):
        files.wait_for(spark, f"{at}/never", 0.05, 0.01)


def test_model_folders_and_configs(spark, at):
    with pytest.raises(FileNotFoundError):
        files.model_dir(spark, f"{at}/m")
    base = files.write_model_config(spark, f"{at}/m", {"max_len": 8, "d_model": 4}, {"midtraining_epochs": 3, "d_model": 2, "old": 1})
    assert base == {"d_model": 4, "old": 1, "max_len": 8} == files.model_config(spark, f"{at}/m/")
    assert files.model_config(spark, f"{at}/m", max_len=16, learning_rate=None)["max_len"] == 16
    chat = files.chat_config(base, {"max_len": 8, "learning_rate": 5e-5, "base_model_id": "b", "repeat_epochs": 3, "posttraining_steps": 9, "batch_size": 4}, SPECIAL, ["d:train"], "d:test")
    assert chat["global_batch_size"] == 4 and chat["end_of_turn_token_id"] == 12 and chat["d_model"] == 4 and chat["chat_template_version"] == 1
    assert files.publishable(["model.pth", "tokenizer.json", "train.py", "checkpoints/a.pth", "validation-cache-x", "other.bin"]) == ["model.pth", "tokenizer.json"]


def test_settings():
    assert settings.validate(dict(RUN), settings.PRETRAINING) == RUN
    assert settings.failures(RUN | {"num_heads": 0, "lr_warmup_steps": 10}, settings.PRETRAINING) == ["num_heads must be greater than 0", "lr_warmup_steps must lie within max_steps"]
    for change, said in (({"d_model": 13}, "divisible"), ({"d_model": 9}, "even"), ({"val_split_index": 4}, "val_split_index"), ({"val_split_modulo": 1, "val_split_index": 0}, "val_split_modulo"), ({"num_workers": -1}, "num_workers"), ({"min_learning_rate_ratio": 1.5}, "ratio"), ({"learning_rate": 0}, "learning_rate")):
        with pytest.raises(ValueError, match=said):
            settings.validate(RUN | change, settings.PRETRAINING)
    assert settings.validate(RUN | {"max_len": None}, settings.MIDTRAINING)
    with pytest.raises(ValueError, match="repeat_epochs"):
        settings.validate({"repeat_epochs": 0}, settings.POSTTRAINING)
    assert settings.positive("0.5") == 0.5 and settings.probability(1) == 1 and settings.count("0") == 0
    for f, bad in ((settings.positive, 0), (settings.probability, 0), (settings.probability, 1.1), (settings.count, -1)):
        with pytest.raises(ValueError):
            f(bad)
    assert settings.schedule() is None and settings.schedule(lr_warmup_steps=0, lr_total_steps=5, min_learning_rate=0.0)
    with pytest.raises(ValueError, match="schedule"):
        settings.schedule(lr_warmup_steps=1)
    assert settings.NUMBER_TYPES["auto"] is None
    config = settings.sft_config((330, 12), 2, 3, (16, 12), 32, 1e-3, SPECIAL)
    assert config["d_ff"] == 16 and config["eos_token_id"] == 3


def doubles(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def matrix(m):
    return F.array(*[doubles(*row) for row in m])


def test_decoder_block_against_numpy_with_and_without_a_cache(spark):
    r = np.random.default_rng(4)
    heads, dim, d_ff, vocab = 2, 2, 6, 5
    d = heads * dim
    w = {n: r.normal(size=s) for n, s in (("q", (d, d)), ("k", (d, d)), ("v", (d, d)), ("out", (d, d)), ("gate", (d_ff, d)), ("up", (d_ff, d)), ("down", (d, d_ff)))}
    norms = {n: r.normal(size=d) for n in ("norm1", "norm2", "last")}
    table, ids = r.normal(size=(vocab, d)), [1, 4, 0]
    norm = lambda x, g: x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-6) * g

    def turned(x):
        out = x.reshape(len(x), heads, dim // 2, 2).copy()
        for p in range(len(x)):
            for i in range(dim // 2):
                angle = p * 10000 ** (-2 * i / dim)
                a, b = out[p, :, i, 0].copy(), out[p, :, i, 1].copy()
                out[p, :, i, 0], out[p, :, i, 1] = a * math.cos(angle) - b * math.sin(angle), a * math.sin(angle) + b * math.cos(angle)
        return out.reshape(len(x), heads, dim)

    x = table[ids]
    n = norm(x, norms["norm1"])
    q, k, v = turned(n @ w["q"].T), turned(n @ w["k"].T), (n @ w["v"].T).reshape(-1, heads, dim)
    mixed = np.zeros_like(v)
    for t in range(len(ids)):
        for h in range(heads):
            s = np.exp(k[: t + 1, h] @ q[t, h] / math.sqrt(dim))
            mixed[t, h] = (s / s.sum()) @ v[: t + 1, h]
    x = x + mixed.reshape(-1, d) @ w["out"].T
    n = norm(x, norms["norm2"])
    g = n @ w["gate"].T
    x = x + (g / (1 + np.exp(-g)) * (n @ w["up"].T)) @ w["down"].T
    logits = norm(x, norms["last"]) @ table.T

    layer = F.struct(*[matrix(m).alias(name) for name, m in w.items()], *[doubles(*norms[n]).alias(n) for n in ("norm1", "norm2")])
    df = spark.range(1).select(layer.alias("layer"), matrix(table).alias("table")).cache()
    rows = lambda own: numeric.embed(F.array(*map(F.lit, own)), F.col("table"))
    whole = df.select("*", numeric.decoder_block(rows(ids), F.col("layer"), heads, dim).alias("b"))
    got = whole.select("b.rows", numeric.tied_logits(F.col("b.rows"), doubles(*norms["last"]), F.col("table")).alias("logits")).first()
    np.testing.assert_allclose(np.array(got["rows"]), x, rtol=1e-9)
    np.testing.assert_allclose(np.array(got.logits), logits, rtol=1e-9)
    start = df.select("*", numeric.decoder_block(rows(ids[:2]), F.col("layer"), heads, dim).alias("past"))
    went_on = start.select(numeric.decoder_block(rows(ids[2:]), F.col("layer"), heads, dim, F.col("past")).alias("b")).first().b
    np.testing.assert_allclose(np.array(went_on["rows"]), x[2:], rtol=1e-9)
    assert len(went_on["keys"]) == len(went_on["values"]) == 3
    with pytest.raises(ValueError, match="even"):
        numeric.multi_head_attention(F.col("a"), F.col("a"), F.col("a"), 1, 3)


def plain_packing(sizes, case, max_len, buffer):
    """Groups of segment numbers by a list that is searched whole each time."""
    key = lambda i: pack.order_key(case, i)
    held, out = [], []

    def group():
        room, own = max_len, []
        while fitting := [i for i in held if sizes[i] <= room]:
            i = max(fitting, key=lambda i: (sizes[i], -key(i)))
            held.remove(i)
            own.append(i)
            room -= sizes[i]
        out.append(own)

    for i in range(len(sizes)):
        held.append(i)
        if len(held) >= buffer:
            group()
    while held:
        group()
    return out


def test_packing_picks_as_a_plain_packer_does():
    rng = random.Random(8)
    sizes = [rng.randrange(1, 33) for _ in range(400)]
    packer, got = pack.Packer("c", 32, 50), []
    for i, n in enumerate(sizes):
        got += [[x[0] for x, _ in group] for group in packer.add([i] * n, [i] * n)]
    got += [[x[0] for x, _ in group] for group in packer.rest()]
    assert got == plain_packing(sizes, "c", 32, 50)


def test_stream_packs_as_a_batch_and_goes_on(spark, at):
    rng = random.Random(9)
    schema = "rank int, inputs array<int>, labels array<int>"
    rows = [(i % 2, [i] * rng.randrange(1, 9), [i]) for i in range(60)]
    rows = [(r, a, a) for r, a, _ in rows]
    case = CorpusCase("c", "", "", f"{at}/segments", "default", "train", "rank")

    def feed(given):
        spark.createDataFrame(given, schema).coalesce(1).write.mode("append").parquet(f"{at}/segments")
        stream = pack_stream(spark.readStream.schema(schema).parquet(case.dataset_path), "c", 16, 0, 5)
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{at}/out").orderBy("rank", "example_no").collect()

    got = feed(rows[:40])
    waiting = 40 - sum(len(set(s for s in r.segments if s >= 0)) for r in got)
    assert 0 < waiting <= 2 * 5
    feed(rows[40:])
    got = feed([(0, None, None), (1, None, None)])
    for rank in (0, 1):
        own = [r for r in got if r["rank"] == rank]
        assert [r.example_no for r in own] == list(range(len(own)))
        sizes = {r[1][0]: len(r[1]) for r in rows if r[0] == rank}
        seen = [x for r in own for x in dict.fromkeys(i for i, s in zip(r.inputs, r.segments, strict=True) if s >= 0)]
        assert sorted(seen) == sorted(sizes) and all(sum(s >= 0 for s in r.segments) <= 16 for r in own)
    assert feed([(0, [7, 7], [7, 7]), (0, None, None)])[-1]["rank"] == 1 and spark.read.parquet(f"{at}/out").count() == len(got) + 1


def test_scan_as_a_stream_and_null_texts(spark, at):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").repartition(2).write.parquet(f"{at}/docs")
    case = CorpusCase("docs", "", "", f"{at}/docs", "default", "train", "text")
    out = scan_stream(spark, case, "doc_id long, text string", files_per_trigger=1)
    assert out.isStreaming
    out.writeStream.format("parquet").option("path", f"{at}/seen").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{at}/seen").count() == 2 == scan(spark, case).count()
    assert reshard(scan(spark, case), 3).rdd.getNumPartitions() == 3
    spark.createDataFrame([(3, None)], "doc_id long, text string").write.mode("append").parquet(f"{at}/docs")
    with pytest.raises(Exception, match="null text in corpus docs"):
        scan(spark, case).collect()


def test_split_and_passes_of_the_corpus(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.split for r in split.label_split(docs, "text", 10, 3).collect()}
    for r in docs.collect():
        own = int.from_bytes(hashlib.blake2b(r.text.encode(), digest_size=8).digest(), "big") % 10
        assert got[r.doc_id] == ("validation" if own == 3 else "train")
    with pytest.raises(ValueError, match="empty"):
        split.passes(docs.limit(0), "doc_id", 17, 2, required=True)


def test_jobs_from_corpus_to_files(spark, at, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.limit(60).withColumn("output", F.upper(F.substring("text", 1, 40))).write.parquet(f"{at}/docs")
    corpus = ["--corpus", f"{at}/docs", "--out"]
    main(["train-tokenizer", *corpus, f"{at}/tok", "--vocab-size", "300", "--max-chars", "400"])
    main(["encode", "--tokenizer", f"{at}/tok", "hello"])
    said = capsys.readouterr().out.split("\n")
    assert said[0] == "300" and json.loads(said[1])["decoded_text"] == "hello"
    main(["pack", *corpus, f"{at}/run", "--tokenizer", f"{at}/tok", "--max-len", "64", "--batch-size", "1", "--val-batches", "2", "--val-split-modulo", "4", "--world", "2"])
    config = files.model_config(spark, f"{at}/run")
    assert config["validation_sample_count"] == 4 and config["global_batch_size"] == 2
    case = CorpusCase("docs", "", "", f"{at}/docs", "default", "train", "text")
    assert config["validation_cache_path"] == cache_path(f"{at}/run", case, "best_fit", 64, 4, 4, 0)
    bpe = Bpe.load(spark, f"{at}/run")
    train = split.keep_buckets(scan(spark, case), "text", 4, (1, 2, 3)).collect()
    used = spark.read.parquet(f"{at}/run/examples").select(F.size(F.filter("segments", lambda s: s >= 0)).alias("n")).agg(F.sum("n")).first()[0]
    assert used == sum(len(bpe.encode(r.text)) + 1 for r in train)
    inherited = jobs.pack_corpus(spark, case, "doc_id", f"{at}/tok", f"{at}/mid", {k: v for k, v in RUN.items() if k not in ("d_model", "num_layers", "num_heads", "d_ff")} | {"max_len": None}, config, global_step=5)
    assert inherited["max_len"] == 64 and inherited["d_model"] == 768 and inherited["shuffle_seed"] == 22
    main(["chat", *corpus, f"{at}/sft", "--tokenizer", f"{at}/tok", "--max-len", "48"])
    assert spark.read.parquet(f"{at}/sft/examples").filter("size(input_ids) = 48 and size(labels) = 48").count() == 60
    with pytest.raises(SystemExit):
        main(["pack", *corpus, f"{at}/run", "--tokenizer", f"{at}/tok", "--d-model", "7"])
    with pytest.raises(SystemExit):
        parser().parse_args(["pack", "--learning-rate", "-1"])
