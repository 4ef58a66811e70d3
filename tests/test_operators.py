"""The reference's operators on small fixtures with known results."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import decode, numeric
from corpusmill.functions.bpe import SPECIAL, Bpe, merge_words
from corpusmill.operators import chat, mask, pack, split
from corpusmill.operators.segment import segments
from corpusmill.sources.corpus import CorpusCase, read_cache, write_cache


def test_segments_overlap_by_one(spark):
    df = spark.createDataFrame([(1, [10, 11, 12, 13]), (2, [])], "doc int, t array<int>")
    out = [(r.doc, r.inputs, r.labels) for r in segments(df, "t", 3, 1, 2).orderBy("doc", "segment_no").collect()]
    assert out == [(1, [1, 10, 11], [10, 11, 12]), (1, [12, 13], [13, 2]), (2, [1], [2])]


def test_packing_golden_and_layout(spark):
    # fixed values: the ids of a known packing
    rows = [(0, i, [1, *d], [*d, 2]) for i, d in enumerate([[10, 11], [20], [30, 31]])]
    df = spark.createDataFrame(rows, "rank int, n int, inputs array<int>, labels array<int>")
    out = pack.pack(pack.deal(df, ["n"], 1), "custom", 6).orderBy("example_no").collect()
    assert [r.inputs for r in out] == [[1, 10, 11, 1, 30, 31], [1, 20, 0, 0, 0, 0]]
    assert out[0].labels == [10, 11, 2, 30, 31, 2] and out[0].positions == [0, 1, 2, 0, 1, 2]
    assert out[1].segments == [0, 0, -1, -1, -1, -1]


def test_order_keys():
    # fixed values: the contract's keys
    assert [pack.order_key("custom", i) for i in range(3)] == [10064941160879506248, 9091561828713820370, 10389098500249429391]


def test_full_buffer_conserves_segments():
    rng = random.Random(5)
    rows = [(0, [k] * rng.randrange(1, 30), [k] * 3) for k in range(500)]
    rows = [(r, i, i) for r, i, _ in rows]
    out = list(pack.pack_rows(rows, "c", 32, 0, 16))
    sizes = Counter(n for o in out for n in Counter(s for s in o[5].tolist() if s >= 0).values())
    assert sizes == Counter(len(i) for _, i, _ in rows)


def test_content_hash_and_split(spark):
    df = spark.createDataFrame([("hello",), ("",)], "text string")
    got = df.select("text", split.bucket(F.col("text"), 100).alias("b")).collect()
    assert {r.text: r.b for r in got} == {"hello": 41, "": 76}
    assert split.train_indexes(4, 1) == (0, 2, 3) and split.resumed_seed(17, 123) == 140
    assert split.keep_buckets(df, "text", 100, [41]).count() == 1


def test_ranks_are_disjoint_and_passes_differ(spark):
    out = split.ranks(split.passes(spark.range(40), "id", 17, 2), "id", 3).collect()
    for p in (0, 1):
        own = [r for r in out if r.pass_index == p]
        assert sorted(r.id for r in own) == list(range(40))
        assert sorted(Counter(r["rank"] for r in own).values()) == [13, 13, 14]
    order = [[r.id for r in sorted(out, key=lambda r: r.shuffle_key) if r.pass_index == p] for p in (0, 1)]
    assert order[0] != order[1]


def test_mask(spark):
    df = spark.createDataFrame([([0, 0, 1, -1], [0, 1, 0, 0])], "s array<int>, p array<int>")
    row = df.select(mask.packed_mask(F.col("s")).alias("m"), mask.visible_keys(F.col("s"), F.col("p")).alias("n")).first()
    assert row.m == [[True, False, False, False], [True, True, False, False], [False, False, True, False], [True, True, True, False]]
    assert row.n == [sum(r) for r in row.m]


def test_chat_ids_and_unknown_role(spark):
    df = spark.createDataFrame([(1, 0, "user", [20, 21]), (1, 1, "gpt", [22])], "conv_id int, turn int, role string, tokens array<int>")
    m = chat.conversations(df)
    row = m.select(chat.chat_prompt(F.col("messages")).alias("p"), chat.serialized(F.col("messages")).alias("i")).first()
    u, a, e = SPECIAL["user"], SPECIAL["assistant"], SPECIAL["end_of_turn"]
    assert row.p == [2, u, 20, 21, e, a, 22, e, a]
    assert [x.id for x in row.i if x.target] == [22, e, SPECIAL["eos"]]
    with pytest.raises(Exception, match="unknown role"):
        df.select(chat.normalize_role(F.lit("robot"))).collect()


def test_decoding_filters(spark):
    one = spark.range(1)
    logits = F.array(*[F.lit(float(x)) for x in (1, 3, 3, 2)])
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    row = one.select(
        decode.kept_ids(decode.top_k(logits, 1)).alias("ties"),
        decode.kept_ids(decode.top_p(logits, 0.3)).alias("first"),
        decode.blocked_by_ngram(ids(5, 6, 7, 5, 6), 3).alias("n3"),
        decode.blocked_by_ngram(ids(5, 6), 1).alias("n1"),
        decode.next_token(logits, ids(0), penalty=2.0).alias("pick"),
        decode.sample(logits, F.lit(0.0)).alias("drawn"),
    ).first()
    assert (row.ties, row.first, row.n3, row.n1, row.pick, row.drawn) == ([1, 2], [1], [7], [], 1, 0)


def test_schedule_and_nan_loss(spark):
    df = spark.createDataFrame([(0,), (1000,), (2000,), (600000,)], "s int")
    got = [r[0] for r in df.select(numeric.warmup_cosine(F.col("s"), 2e-4, 2e-5, 2000, 600000)).collect()]
    assert got == pytest.approx([0, 1e-4, 2e-4, 2e-5])
    loss = spark.createDataFrame([(1.0, 0)], "l double, t int").agg(numeric.masked_mean(F.col("l"), F.col("t"))).first()[0]
    assert loss != loss


def test_bpe_against_the_public_trainer():
    tokenizers = pytest.importorskip("tokenizers")
    import regex
    from tokenizers import models, pre_tokenizers, trainers

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(60)) for _ in range(40)]
    words = Counter(w for t in texts for w in regex.findall(r" ?\p{L}+|\s+", t))
    own = merge_words(list(words.items()), 400)
    from corpusmill.functions.bpe import SPECIAL_TOKENS

    other = tokenizers.Tokenizer(models.BPE())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=400, special_tokens=SPECIAL_TOKENS, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    for t in texts:
        assert own.encode(t) == other.encode(t, add_special_tokens=False).ids
    assert own.decode(own.encode("a|<bos>|é")) == "aé" and Bpe.loads(own.dumps()) == own


def test_cache_is_exact_and_guarded(spark, tmp_path):
    df = spark.createDataFrame([(i, [i] * 4) for i in range(5)], "example_no int, inputs array<int>")
    path = f"file://{tmp_path}/cache"
    with pytest.raises(ValueError, match="needs 9"):
        write_cache(df, path, 9, 4, {"corpus_signature": "x"})
    assert not (tmp_path / "cache").exists()
    write_cache(df, path, 3, 4, {"corpus_signature": "x", "more": 1})
    assert read_cache(spark, path, 3, 4, {"corpus_signature": "x"}).count() == 3
    with pytest.raises(ValueError, match="corpus_signature"):
        read_cache(spark, path, 3, 4, {"corpus_signature": "y"})
    case = CorpusCase("n", "g", "l", "p", "c", "s", "text")
    assert len(case.signature()) == 16 and case.signature() == hashlib.blake2b(b'{"config_name": "c", "dataset_path": "p", "genre": "g", "language": "l", "name": "n", "split": "s", "text_column": "text"}', digest_size=8).hexdigest()


def test_pretoken_totals_count_every_document(spark, tmp_path):
    import regex

    from corpusmill.functions.bpe import PRETOKEN
    from corpusmill.plans.queries import QUERIES

    texts = ["It's 42 o'clock, isn't it?  \n\n\tYes — 3.5%", "El niño comió 12 piñas", "Straße über-groß", "déjà vu\u00a0!", "漢字 123abc ٣٤ 😀😀", "   ", "plain words only", "plain words only", "", None]
    rows = [(k, t, ["en", "es", "de", None][k % 4]) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.pretoken, r.n) for r in QUERIES["pretoken_totals"](spark, str(tmp_path)).collect()]
    split = regex.compile(PRETOKEN.removeprefix("(?U)")).findall
    assert sorted(got) == sorted(Counter(w for t in texts for w in split(t or "")).items())
