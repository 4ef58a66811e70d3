"""Command line: python -m corpusmill {train-tokenizer, encode, pack, chat} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corpusmill.plans import jobs
from corpusmill.plans.settings import count, positive, probability
from corpusmill.sources.corpus import CorpusCase

#: Settings of a packing run and what they are by default.
DEFAULTS = {"max_len": 1024, "d_model": 768, "num_layers": 16, "num_heads": 12, "d_ff": 2048, "batch_size": 16, "gradient_accumulation_steps": 2, "max_steps": 40960, "val_split_modulo": 100, "val_split_index": 0, "val_batches": 64, "val_check_interval": 1000, "checkpoint_every_n_steps": 1000, "metric_log_every_n_steps": 10, "loss_chunk_size": 128, "lr_warmup_steps": 2000}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusmill")
    commands = out.add_subparsers(dest="command", required=True)

    def corpus(p: argparse.ArgumentParser) -> None:
        p.add_argument("--corpus", required=True, help="path of a Parquet table")
        p.add_argument("--text-column", default="text")
        p.add_argument("--key", default="doc_id", help="column that names and orders the rows")
        p.add_argument("--out", required=True)

    p = commands.add_parser("train-tokenizer")
    corpus(p)
    p.add_argument("--vocab-size", type=count, default=65536)
    p.add_argument("--sample-count", type=count, default=51200)
    p.add_argument("--max-chars", type=count, default=8192)
    p = commands.add_parser("encode")
    p.add_argument("--tokenizer", required=True)
    p.add_argument("text", nargs="+")
    p = commands.add_parser("pack")
    corpus(p)
    p.add_argument("--tokenizer", required=True)
    for name, value in DEFAULTS.items():
        p.add_argument("--" + name.replace("_", "-"), type=count, default=value)
    p.add_argument("--num-workers", type=count, default=0)
    p.add_argument("--learning-rate", type=positive, default=2e-4)
    p.add_argument("--min-learning-rate-ratio", type=probability, default=0.1)
    p.add_argument("--world", type=count, default=1)
    p.add_argument("--passes", type=count, default=1)
    p = commands.add_parser("chat")
    corpus(p)
    p.add_argument("--tokenizer", required=True)
    p.add_argument("--answer-column", default="output")
    p.add_argument("--max-len", type=count, default=1024)
    p.add_argument("--repeat-epochs", type=count, default=3)
    return out


def main(given: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    case = lambda **limits: CorpusCase(a.corpus.rstrip("/").rsplit("/", 1)[-1], "", "", a.corpus, "default", "train", a.text_column, **limits)
    try:
        if a.command == "train-tokenizer":
            print(jobs.train_tokenizer(spark, [(case(sample_count=a.sample_count, max_chars=a.max_chars), a.key)], a.out, a.vocab_size).vocab_size())
        elif a.command == "encode":
            print("\n".join(jobs.encode(spark, a.tokenizer, a.text)))
        elif a.command == "pack":
            settings = {k: v for k, v in vars(a).items() if k in DEFAULTS or k in ("num_workers", "learning_rate", "min_learning_rate_ratio")}
            jobs.pack_corpus(spark, case(), a.key, a.tokenizer, a.out, settings, None, a.world, a.passes)
        else:
            print(jobs.chat_examples(spark, case(), a.tokenizer, a.out, a.max_len, a.repeat_epochs, a.text_column, a.answer_column))
    except ValueError as e:
        p.error(str(e))


if __name__ == "__main__":
    main()
