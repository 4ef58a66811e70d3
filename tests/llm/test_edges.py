"""All queries over odd tables: nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns, no rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm.click_dedup import OP12_SQL
from corpusmill.llm.queries import QUERIES

CLASHES = ["score", "spans", "items", "n_words", "found", "blob_id_", "blob", "set_key", "component", "component_id", "node", "a", "b", "key", "held", "row_", "text_key", "least", "anchors", "chunk", "bucket", "start", "length", "sequence_id", "kept", "rep", "shared", "n_tokens", "n_bytes", "quality", "other_"]
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "clicks": "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string",
}
NOON, HOUR = datetime(2024, 2, 1, 12), timedelta(hours=1)
QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}


def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    page, long = prose(120), prose(40_000)
    texts = [page, page, page + " more", None, "", " \n\t ", "one", "a " * 3000, long, long, "x" * 50_000, "token: ABCDEFGH12 " + "0123456789abcdef" * 3, "naïve 漢字 😀 \u0000   end", prose(40)]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs += [docs[0], docs[0], (None, page, None, None, None), (None, None, None, None, None), (None, None, None, None, None), (3, "the same id", None, None, 11), (40, prose(200), None, None, None)]
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)], 0) for k in range(6)]
    vectors += [vectors[0], (None, vectors[1][1], None), (7, None, None), (8, [], None), (9, [None] * 8, 1), (10, [0.0] * 8, 1), (11, [float("inf")] * 8, None), (12, vectors[2][1], None)]
    return {
        "documents": docs,
        "embeddings": vectors,
        "benchmark": [(1, " ".join(page.split()[5:30])), (1, "one"), (2, None), (None, "one"), (3, ""), (4, "!!")],
        "labels": [(k % 14, k % 2, None) for k in range(14)] + [(None, 1, 0), (1, None, None), (0, 0, 0), (99, 1, 1)],
        "clicks": [(5, NOON, NOON, 1, "a|b", 1.5, "{}")] * 3 + [(5, None, NOON + 30 * HOUR, None, None, None, None), (4, NOON, NOON, 1, "", float("nan"), "x" * 50_000), (8, NOON, NOON + 900 * HOUR, 1, "a", -0.005, None), (None, NOON, NOON, 1, "a", 1.0, ""), (2, NOON, None, 1, "a", 1.0, ""), (-1, NOON, NOON, 1, "a", 1.0, ""), (-3, NOON, NOON, 1, "a", float("inf"), "")],
        "conversations": [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 1, "assistant", "yes"), (1, None, "assistant", None), (None, 0, None, "<|im_end|>"), (2, 0, "system", "x\\n" * 5000), (2, None, None, None)],
    }


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    given = rows()
    for name, schema in TABLES.items():
        df = spark.createDataFrame(given[name] if request.param == "odd" else [], schema)
        for c in CLASHES:
            df = df if c in df.columns else df.withColumn(c, F.array(F.lit("x"), F.lit(None)))
        df.repartition(3).write.parquet(f"file://{at}/{name}.parquet")
    return f"file://{at}", {k: v if request.param == "odd" else [] for k, v in given.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_odd_tables(spark, folder, name):
    sf, given = folder
    got = QUERIES[name](spark, sf).collect()
    ids = lambda table: sorted((r[0] for r in given[table]), key=lambda x: (x is None, x))
    if name == "op1_embedding_dedup":
        assert sorted((r.vec_id for r in got), key=lambda x: (x is None, x or 0)) == ids("embeddings")
        shown = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
        want = [(0, 1, 0, True), (0, 1, 0, True), (1, 1, 1, True), (None, 1, 1, False), (2, 1, 2, True), (12, 1, 2, False), *((i, 0, i, True) for i in (3, 4, 5, *range(7, 12)))]
        assert shown == (Counter(want) if given["embeddings"] else Counter())
    elif name == "op2_chat_format":
        assert {r.conv_id for r in got} == {-1, *ids("conversations")} and len(got) == len({r.conv_id for r in got})
    elif name == "op12_click_dedup":
        con = duckdb.connect()
        con.sql(f"CREATE VIEW clicks AS SELECT * REPLACE (CASE WHEN isfinite(value) THEN value END AS value) FROM '{sf.removeprefix('file://')}/clicks.parquet/*.parquet'")
        want = con.sql(f"SELECT click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash FROM ({OP12_SQL})").fetchall() if given["clicks"] else []
        assert Counter(map(tuple, got)) == Counter(want) and (not given["clicks"] or {r.click_id for r in got} == {4, 5, 8, -3})
    elif name == "op13_whitening":
        first = sorted((r.vec_id for r in got if r.component == 1), key=lambda x: (x is None, x or 0))
        assert first == ([0, 0, 1, 2, 3, 4, 5, 10, 12, None] if given["embeddings"] else []) and all(r.n == 10 for r in got)
    elif name in ("op9_packing", "pipeline"):
        held: dict = {}
        for r in got:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in held.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096
        if name == "op9_packing":
            assert sorted((r.doc_id for r in got if r.start == 0), key=lambda x: (x is None, x or 0)) == ids("documents")
    else:
        assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x or 0)) == ids("documents")


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES[:-1])
def test_stages_keep_other_columns(spark, folder, name, step):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = step(spark, docs, sf)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    changed = [c for c in docs.columns if c not in ("text", "n_chars")]
    held = lambda df: Counter(map(str, df.select(*changed).collect()))
    assert not held(out) - held(docs)
