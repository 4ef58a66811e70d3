"""The corpus pipeline: quality classifier, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a table
that is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.

In every stage: a null text is empty; a row with a null id is worked on like any other; texts may be of any
length; columns of any name and type besides doc_id and text are carried along unchanged (n_chars follows a
text that is changed); an empty table gives no rows. Repeated rows and ties: see each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, minhash_dedup, packing, quality, secrets
from corpusmill.llm.common import Staged, read, remove, shared_dir

#: SQL can't express the classifier or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, text, other_): the other columns in a struct, so that none clashes with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("other_"))


def widen(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("other_")[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a score of exactly 0.5 is not rejected.

    Each row is judged by its text alone, so repeated rows stay or go together. Without labels all scores
    are 0.5 and all rows stay.
    """
    model = quality.learned(spark, sf_dir)
    return widen(quality.score(narrow(docs), model).filter("score >= 0.5"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id.

    Empty texts are copies of nothing, and stay. Rows of one id are one document and stay together, but of
    rows with equal id and text one stays, that whose other columns come first as JSON. Rows without an id
    can't be the least of a group, nor be told apart, and stay, each text once.
    """
    kept = minhash_dedup.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    rows = narrow(docs)
    rows = rows.join(kept, "doc_id", "left_semi").union(rows.filter("doc_id is null"))
    one = rows.groupBy("doc_id", "text").agg(F.min_by("other_", F.to_json("other_")).alias("other_"))
    return widen(one, docs)


def cut_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Repeated rows stay or go together; an empty benchmark drops nothing."""
    scanned = decontamination.contamination(narrow(docs), read(spark, sf_dir, "benchmark"), keep_text=True)
    return widen(scanned.filter(F.size("spans") == 0), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, repeated ones too. Overlapping spans become one mark. The ledger's folder is a new one where none is given."""
    found, _ = secrets.scan(narrow(docs), ledger)
    out = found.withColumn("text", secrets.redact(F.col("text"), F.col("found")))
    if "n_chars" in docs.columns:
        length = F.when(F.size("found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("other_")["n_chars"])
        out = out.withColumn("other_", F.col("other_").withField("n_chars", length))
    return widen(out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens. Repeated rows are packed each; an empty text is its end id."""
    import public_tokenizers

    return packing.pack(packing.cut_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_test_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's table is deleted when the next one is written; the result refers to the pieces alone."""
    ledger = f"{shared_dir(spark)}/pipeline-ledger-{uuid.uuid4().hex}"
    docs, held = read(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        more = {"ledger": ledger} if name == "secrets" else {}
        after = Staged(step(spark, docs, sf_dir, **more), f"pipeline-{name}")
        if held is not None:
            held.drop()
        docs, held = after.read(), after
    remove(spark, ledger)
    out = STAGES[-1][1](spark, docs, sf_dir)
    held.drop()
    return out
