"""Partitioned BPE training and the encoder against plain loops and the public trainer."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from corpusmill.functions.bpe import SPECIAL_TOKENS, Bpe, TooManyWords, merge_words, train
from corpusmill.functions.bpe_training import certain, merged, pair_counts, rewritten, train_partitioned, word_of


def plain_word(bpe, word):
    """Merge the earliest rank everywhere, again and again."""
    t = bpe.tables()
    ids = [t["to_id"][b] for b in word.encode()]
    while ranked := [(t["ranks"][p], p) for p in zip(ids, ids[1:], strict=False) if p in t["ranks"]]:
        rank, pair = min(ranked)
        out, i = [], 0
        while i < len(ids):
            two = i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair
            out.append(bpe.first_byte + 256 + rank if two else ids[i])
            i += 1 + two
        ids = out
    return ids


def test_encoder_against_a_plain_one_and_on_a_long_word():
    rng = random.Random(6)
    words = [("".join(rng.choice("aab") for _ in range(rng.randrange(1, 12))), rng.randrange(1, 9)) for _ in range(80)]
    bpe = merge_words(words, 330)
    for n in (1, 2, 3, 7, 50, 300):
        for _ in range(20):
            w = "".join(rng.choice("aabc") for _ in range(n))
            assert bpe._word(w) == plain_word(bpe, w)
    assert bpe._word("a" * 301) == plain_word(bpe, "a" * 301)
    began = time.process_time()
    bpe._word("ab" * 10_000)
    assert time.process_time() - began < 1


def test_merging_one_part():
    x = np.array([5, 5, 5, 5, 5, 0, 5, 6, 5, 0, 7, 0], np.int32)
    assert merged(x, (5, 5), 9).tolist() == [9, 9, 5, 0, 5, 6, 5, 0, 7, 0]
    counts = np.array([2, 3, 4])
    after, own, changes = rewritten(x, counts, [((5, 6), 9)])
    assert after.tolist() == [5, 5, 5, 5, 5, 0, 7, 0, 9, 5, 0] and own.tolist() == [2, 4, 3]
    shown = {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in changes.T}
    assert shown == {(5, 6): -3, (6, 5): -3, (9, 5): 3}
    assert word_of(x).tolist() == [0] * 6 + [1] * 4 + [2] * 2 and dict(zip(*map(np.ndarray.tolist, pair_counts(x, counts[word_of(x)])), strict=True))[5 << 32 | 5] == 8


def test_which_merges_are_certain():
    assert certain([(9, (1, 2)), (9, (2, 3)), (8, (4, 5))], 9, True) == [(1, 2)]
    assert certain([(9, (1, 2)), (8, (4, 5)), (3, (2, 7)), (2, (8, 9))], 9, True) == [(1, 2), (4, 5)]
    assert certain([(9, (1, 2)), (8, (4, 5)), (7, (6, 8))], 9, False) == [(1, 2), (4, 5)]
    assert certain([(9, (1, 1)), (8, (1, 5))], 9, True) == [(1, 1)] and certain([(9, (1, 2)), (8, (4, 5))], 1, True) == [(1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_partitioned_training_against_one_merge_at_a_time(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choice("aaabcdé") for _ in range(rng.randrange(1, 8))) for _ in range(40)) for _ in range(20)] + ["aaaaaaaa" * 9, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert train_partitioned(df, "text", 310) == train(df, "text", 310)
    with pytest.raises(TooManyWords):
        train(df, "text", 310, most_words=5)


def test_training_ends_when_nothing_is_left_to_merge(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "text string")
    assert len(train_partitioned(df, "text", 1000).merges) == 1
    assert train_partitioned(df.limit(0), "text", 1000) == Bpe()


def test_documents_against_the_public_trainer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    own = train_partitioned(docs, "text", 320)
    other = Tokenizer(models.BPE())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=320, special_tokens=SPECIAL_TOKENS, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    for t in texts[:50]:
        assert own.encode(t) == other.encode(t, add_special_tokens=False).ids
    assert Counter(i for t in texts[:50] for i in own.encode(t))[own.vocab_size() - 1] > 0


def test_a_round_has_no_files_for_each_part(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from corpusmill.functions import bpe_training

    monkeypatch.setattr(bpe_training, "PART_WORDS", 10)
    words = spark.createDataFrame([(f"w{k}x", k % 7 + 1) for k in range(400)], "pretoken string, n long")
    state = bpe_training.Training(spark, f"file://{tmp_path}/training")
    state.begin(words)
    top, _ = state.best()
    state.merge([(top[0][1], 269)], set(top[0][2]), 1)
    assert len(state.newest) > 30 and len(list(Path(tmp_path, "training", "1").rglob("*.parquet"))) <= 20
