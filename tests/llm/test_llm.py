"""The training-data operators: odd rows, empty tables, and brute force on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat_format, decontamination, embedding_dedup, katz, minhash_dedup, packing, quality, secrets, substring_dedup, token_counts
from corpusmill.llm.fm_index import FMIndex, joined

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, LONG = prose(150), prose(30_000)
NEAR = BASE.split()
NEAR[3] = "changed"
ROWS = [(1, BASE), (2, BASE), (3, " ".join(NEAR)), (4, None), (5, ""), (6, " \n "), (7, "one"), (8, prose(80) + " " + BASE[:500]), (9, LONG), (10, "ſecret naïve 漢字 😀 token: ABCDEFGH12"), (8, "the same id"), (11, prose(60)), (11, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in ROWS], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_fm_index_against_scan():
    r = np.random.default_rng(1)
    seqs = [r.integers(1, 5, n) for n in (40, 1, 0, 77, 200)] + [np.ones(50, np.int64)]
    text, starts = joined(seqs)
    fm = FMIndex(text)
    for m in (1, 3, 6):
        patterns = r.integers(1, 6, (50, m))
        low, high = fm.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = sorted(int(s) + i for s, q in zip(starts, seqs, strict=True) for i in range(len(q) - m + 1) if (q[i : i + m] == p).all())
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_embedding_dedup_odd_vectors(spark):
    a = np.random.default_rng(2).normal(size=8)
    rows = [(1, a.tolist()), (2, a.tolist()), (3, (a * 2).tolist()), (4, None), (5, [0.0] * 8), (6, [float("nan")] * 8), (7, [None] * 8), (8, [1.0]), (9, (-a).tolist()), (2, a.tolist()), (10, (a + 0.05).tolist()), (None, (a * 3).tolist()), (None, None), (None, (-a).tolist()), (11, [1e300] * 8), (12, [1e-300] * 8), (13, [])]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = [(1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False), (3, 5, 1, False), (10, 5, 1, False), (None, 5, 1, False), (None, 0, None, False), (9, 1, 9, True), (None, 1, 9, False), (11, 1, 11, True), (12, 1, 11, False), *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 13))]
    assert got == Counter(want)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_by_brute_force(vectors):
    """(links, least place reachable) of each of the unit vectors."""
    link = vectors @ vectors.T >= 0.9
    label = np.arange(len(vectors))
    while True:
        low = np.where(link, label, len(vectors)).min(1)
        if (low == label).all():
            return link.sum(1) - 1, label
        label = low


@pytest.mark.parametrize("shape", ["one dense group", "many groups", "pairs at the threshold", "mixed lengths"])
def test_embedding_dedup_against_brute_force(spark, shape):
    r = np.random.default_rng(5)
    draw = lambda n, d=64: unit(r.normal(size=(n, d)))
    noisy = lambda x, cosine: unit(cosine**0.5 * x + (1 - cosine) ** 0.5 * draw(len(x), x.shape[1]))
    if shape == "one dense group":
        parts = [np.concatenate([noisy(np.repeat(draw(1), 4800, 0), 0.93), draw(1200)])]
    elif shape == "many groups":
        parts = [noisy(draw(100)[r.integers(0, 100, 5000)], 0.92)]
    elif shape == "pairs at the threshold":
        x = draw(2500)
        parts = [np.concatenate([x, unit(0.91 * x + (1 - 0.91**2) ** 0.5 * draw(2500))])]
    else:
        parts = [noisy(draw(30, d)[r.integers(0, 30, 400)], 0.92) for d in range(20, 38)] + [noisy(np.repeat(draw(1, 3), 50, 0), 0.99)]
    rows, want = [], {}
    for x in parts:
        links, least = linked_by_brute_force(x)
        ids = [len(rows) + k for k in range(len(x))]
        want.update({i: (int(n), ids[k], ids[k] == i) for i, n, k in zip(ids, links, least, strict=True)})
        rows.extend(zip(ids, x.tolist(), strict=True))
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(want)
    if shape == "pairs at the threshold":  # cosines of 0.9 and a little more in 64 dimensions are the hardest to meet
        found, there = (sum(v[0] for v in x.values()) for x in (got, want))
        assert there > 1000 and there >= found >= 0.998 * there
    else:
        assert got == want


def test_chat_round_trip_and_rewriting(spark):
    texts = ["<|im_end|>", "a\\<|b", None, "\\n\n", "<|im_start|>user\nx<", "\\"]
    rows = [(1, k, "assistant" if k % 2 else "us\ner", t) for k, t in enumerate(texts)] + [(2, k, "assistant", f"t{k}") for k in range(150)] + [(None, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in out.mapInArrow(chat_format.read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean").collect()}
    for conv in (1, 2, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for who, t in own if who == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    forgets = lambda turns: "".join(t if k == len(turns) - 1 else "*" for k, (_, t) in enumerate(turns))
    assert list(chat_format.render(iter([(1, iter([("user", "a"), ("assistant", "b")]))]), forgets, "assistant"))[0]["rewritten"]


@pytest.mark.parametrize("n", [63, 64, 65, 200])
def test_chat_templates_at_and_beyond_a_segment(n):
    turns = [("assistant" if k % 2 else "user", f"t{k} <|im_end|>") for k in range(n)]
    show = lambda turns: "".join(f"[{who}]{t}\n" for who, t in turns)
    for template in (chat_format.chatml, lambda turns: "<s>" + show(turns), lambda turns: "[system]be kind\n" + show(turns)):
        rows = list(chat_format.render(iter([(1, iter(turns))]), template, "assistant"))
        assert not any(r["rewritten"] for r in rows) and "".join(r["formatted"] for r in rows) == template(turns)
        loss = [chat_format.unescape(r["formatted"][x["start"] : x["end"]]) for r in rows for x in r["loss"]]
        assert loss == [t for who, t in turns if who == "assistant"]
    for rewriting in (lambda turns: show(turns[-50:]), lambda turns: "".join(f"[{who}]{t if k > len(turns) - 3 else ''}" for k, (who, t) in enumerate(turns))):
        assert all(r["rewritten"] for r in chat_format.render(iter([(1, iter(turns))]), rewriting, "assistant"))


def test_chat_templates_that_are_not_concatenative():
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(150)]
    show = lambda turns: "".join(f"[{who}]{t}\n" for who, t in turns)
    header = lambda turns: "<bos>" + show(turns)
    rows = list(chat_format.render(iter([(1, iter(turns))]), header, "assistant"))
    assert [len(r["turn_ends"]) for r in rows] == [64, 64, 22] and [r["segment"] for r in rows] == [0, 1, 2]
    assert "".join(r["formatted"] for r in rows) == header(turns) and not any(r["rewritten"] for r in rows)
    assert [r["formatted"][x["start"] : x["end"]] for r in rows for x in r["loss"]] == [t for who, t in turns if who == "assistant"]
    last = lambda turns: show(turns[-100:])
    assert [(r["segment"], r["formatted"], r["rewritten"]) for r in chat_format.render(iter([(1, iter(turns))]), last, "assistant")] == [(0, last(turns), True)]


BASE_RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def test_secrets_base_spans_are_those_of_python(spark, docs, none):
    parts = ["token=", "SECRET: '", "Api_Key\"  = ", "passwd:", "AKIA", "abcdef0123456789" * 2, "ABCDEFGHIJ12", "é😀", " ", "\n", "'", ",", "0" * 31, "g", "x=y", "\ufeff"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)] + ["token=abcdefgh " * 3000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, _ = secrets.scan(df)
    rows = out.select("doc_id", secrets.redact(F.col("text"), F.col("found")).alias("clean"), F.filter("found", lambda x: x["place"] <= 2).alias("base"), "found").collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        want = sorted((m.start(), place, kind, m.end()) for place, (kind, rule, group, least) in enumerate(BASE_RULES) for m in rule.finditer(text) if len(m[group]) >= least)
        assert [tuple(x) for x in r.base] == want
        clean, at = [], 0
        for start, _, _, end in sorted(map(tuple, r.found)):
            if start >= at:
                clean += [text[at:start], "[SECRET]"]
            at = max(at, end)
        assert (r.clean or "") == "".join(clean) + text[at:]
    assert sum(len(r.base) for r in rows) > 3300
    assert secrets.scan(none)[0].count() == 0 and secrets.scan(docs)[0].count() == len(ROWS)


def test_secrets_query_digests_and_named_ledger(spark, tmp_path):
    texts = ["token=token=abcdefgh12 secret: token: abcdefghijk", "é😀 AKIA" + "A" * 12 + " " + "0" * 40 + "g" + "a" * 31, None, "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.conf.set("corpusmill.secrets.ledger", f"file://{tmp_path}/ledger")
    try:
        first, second = ({r.doc_id: r for r in secrets.op3_secret_scan(spark, f"file://{tmp_path}").collect()} for _ in range(2))
    finally:
        spark.conf.unset("corpusmill.secrets.ledger")
    spans = {0: "assign:0:22", 1: "access:3:19,hex:20:60", 2: "", 3: ""}
    counts = {0: (1, 0, 0), 1: (0, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0)}
    for i, r in first.items():
        assert (r.n_assign, r.n_access, r.n_hex) == counts[i] and r.spans == spans[i] and r.base_sha256 == hashlib.sha256(spans[i].encode()).hexdigest()
    assert first == second
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.blobs().count() == 4 * len(secrets.RULES) and ledger.paths().count() == 4


def test_secrets_ledger_scans_only_what_is_new(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    at = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one, two = "token=abcdefgh1", "AKIA" + "B" * 12
    _, ledger = secrets.scan(at([(1, one), (2, one), (3, "plain"), (None, one)]), folder)
    assert ledger.blobs().count() == 2 * len(secrets.RULES)
    assert secrets.scan_unseen(at([(4, one), (5, "plain")]), ledger.blobs()).count() == 0
    out, ledger = secrets.scan(at([(1, two), (2, one), (6, one)]), folder)
    assert {(r.doc_id, r.found[0].kind) for r in out.collect()} == {(1, "access"), (2, "assign"), (6, "assign")}
    assert ledger.blobs().count() == 3 * len(secrets.RULES)
    # both versions of path 1 are told
    assert sorted((r.path or "", r.found[0].kind) for r in secrets.path_findings(ledger).collect()) == [("", "assign"), ("1", "access"), ("1", "assign"), ("2", "assign"), ("6", "assign")]
    newer = (*secrets.RULES[:3], secrets.Rule("pem", 9, 3, "-----BEGIN"))
    assert {(r.rule, r.version) for r in secrets.scan_unseen(at([(1, one)]), ledger.blobs(), newer).collect()} == {("pem", 9)}


def test_secrets_redact_the_whole_private_key(spark):
    head, tail, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join(["MIIEpAIBAAKCAQEA+/" * 3] * 3000) + "=="
    texts = [f"a {head}\nProc-Type: 4,ENCRYPTED\n\n{body}\n{tail} b", f"a {head}\n{body}", f"a {head} is a header", f"{head}\n{body}\n{head}\n{body}\n{tail} c"]
    out, _ = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r.t for r in out.select(secrets.redact(F.col("text"), F.col("found")).alias("t"), "doc_id").orderBy("doc_id").collect()]
    assert got == ["a [SECRET] b", "a [SECRET]", "a [SECRET] is a header", "[SECRET][SECRET] c"]


def test_quality_learns_and_defaults(spark, docs, none):
    rows = [(k, prose(40) if k % 3 else " ".join(w.upper() + "!!" for w in prose(40).split())) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    out = quality.score(df, quality.fit(df, labels.filter("doc_id < 160"))).filter("doc_id >= 160").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in out)
    empty = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5} and quality.score(none, empty).count() == 0


def test_quality_learns_from_what_lies_deep_in_a_text(spark):
    start = prose(2500)
    assert len(start) > 8000
    rows = [(k, f"{start} {prose(1500)}" if k % 3 else start + " " + " ".join(w.upper() + "!!" for w in prose(1500).split())) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    out = quality.score(df, quality.fit(df, labels.filter("doc_id < 60"))).filter("doc_id >= 60").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in out)


def test_quality_word_vectors_are_neighbour_sums_of_the_whole_corpus(spark):
    texts = ["aa Bb aa cc! aa Bb", "cc! aa Bb", None, "Bb aa cc! aa 12", "Bb cc! cc! x"]
    got = quality.random_indexing(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    split = [(t or "").split() for t in texts]
    counts = Counter(w for s in split for w in s)
    known = sorted((w for w in counts if counts[w] >= quality.WORD_LEAST), key=lambda w: (-counts[w], w))
    assert list(got.words) == known
    vector = lambda w: quality.index_vectors(["s" + quality.shape(w)])[0] + (quality.index_vectors(["w" + w])[0] if w in known else 0)
    words, shapes = {w: 0 for w in counts}, {quality.shape(w): 0 for w in counts}
    for s in split:
        for i, w in enumerate(s):
            near = sum((vector(s[j]) for j in range(max(0, i - 2), min(len(s), i + 3)) if j != i), np.zeros(quality.DIM))
            words[w] = words[w] + near
            shapes[quality.shape(w)] = shapes[quality.shape(w)] + near + quality.index_vectors(["s" + quality.shape(w)])[0]
    for want, names, table in ((words, got.words, got.word_table), (shapes, got.shapes, got.shape_table)):
        for name, k in names.items():
            np.testing.assert_allclose(table[k], want[name] / np.linalg.norm(want[name]), atol=1e-6)


def test_quality_pooling_network_and_temperature_against_plain_numpy():
    r = np.random.default_rng(3)
    words, shapes = {"aa": 1, "Bb": 2}, {"a": 1, "Aa": 2, "0": 3}
    v = quality.Vectors(words, shapes, r.normal(size=(3, quality.DIM)).astype(np.float32), r.normal(size=(4, quality.DIM)).astype(np.float32))
    v.word_table[0] = v.shape_table[0] = 0
    texts = ["aa Bb zz 12", "", "?? Cc", "aa " * 5000]
    pooled = v.pool(texts)
    for row, text in zip(pooled, texts, strict=True):
        own = text.split()
        known = [words[w] for w in own if w in words]
        want = np.zeros(2 * quality.DIM + 1)
        if own:
            if known:
                want[: quality.DIM] = v.word_table[known].astype(float).mean(0)
            want[quality.DIM : -1] = v.shape_table[[shapes.get(quality.shape(w), 0) for w in own]].astype(float).mean(0)
            want[-1] = len(known) / len(own)
        np.testing.assert_allclose(row, want, rtol=1e-6, atol=1e-9)
    x = r.normal(size=(400, 5))
    y = (x[:, 0] + 0.7 * r.normal(size=400) > 0).astype(float)
    net = quality.train(x, y)
    hidden = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1)
    logits = hidden @ net.w2 + net.b2
    np.testing.assert_allclose(net.scores(x), 1 / (1 + np.exp(-logits / net.temperature)))
    assert (np.round(net.scores(x)) == y).mean() > 0.75
    held = np.random.default_rng(7).permutation(400)[:80]
    loss = lambda t: -np.mean(np.log(np.where(y[held] == 1, 1 / (1 + np.exp(-logits[held] / t)), 1 / (1 + np.exp(logits[held] / t)))))
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(-1.5, 2.5, 81)))


@pytest.mark.parametrize("shard_words", [60, 2000])
def test_substring_dedup_against_brute_force(spark, none, shard_words):
    window = 12
    shared = prose(30)
    rows = [(k, f"{prose(rng.randrange(0, 30))} {shared if k % 2 else ''} {prose(20)}") for k in range(40)] + [(50, BASE), (51, BASE), (52, BASE), (53, None), (54, LONG), (54, LONG), (55, LONG[5000:9000]), (None, BASE)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string"), window, 4, shard_words).collect() if r.doc_id is not None)
    least = {}
    split = [(i, (t or "").split()) for i, t in rows if i is not None]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    want = []
    for i, w in split:
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want)
    assert substring_dedup.repeated(none).count() == 0


def test_minhash_against_brute_force(spark, docs, none):
    rows = [(k, " ".join(w if rng.random() > 0.03 else "edit%d" % rng.randrange(99) for w in BASE.split())) for k in range(60)] + [(100 + i, t) for i, t in ROWS if i != 8 and i != 11]
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 2).collect()}
    sets = {i: frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w) for i, w in ((i, (t or "").lower().split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert minhash_dedup.near_duplicates(docs).count() == len(ROWS) and minhash_dedup.near_duplicates(none).count() == 0


def components_by_brute_force(texts, size, percent):
    """(shingles, component) of each id."""
    sets = {i: frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if (w := (t or "").lower().split()) else frozenset() for i, t in texts}
    component = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and percent * len(sets[a] | sets[b]) <= 100 * len(sets[a] & sets[b])]
    while any(component[a] != component[b] for a, b in links):
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    return {i: (len(s), component[i]) for i, s in sets.items()}


def test_minhash_groups_below_the_threshold_and_chains(spark, monkeypatch):
    """Groups whose members are all a little less similar than the threshold, chains through them, and exact copies: no link lost, no pairs of all."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "GROUP_ELEMENTS", 3000)
    base = [f"w{k}" for k in range(900)]

    def edit(words, n):
        at = set(rng.sample(range(len(words)), n))
        return [f"x{rng.random()}" if k in at else w for k, w in enumerate(words)]

    rows = [(k, " ".join(edit(base, 45))) for k in range(60)]
    walk = base
    for k in range(100, 130):
        walk = edit(walk, 40)
        rows.append((k, " ".join(walk)))
    rows += [(200 + k, rows[k][1]) for k in range(0, 90, 3)] + [(300 + k, " ".join(edit(rows[7][1].split(), 20 + k))) for k in range(40)]
    emitted = []
    real = minhash_dedup.cross_pairs

    def counted(*given):
        out = real(*given)
        emitted.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "cross_pairs", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 2).collect()}
    assert got == components_by_brute_force(rows, 2, 80)
    assert len(set(c for _, c in got.values())) > 20 and emitted


@pytest.mark.parametrize("n", [30, 60])
def test_minhash_emits_no_pairs_of_long_documents_below_the_threshold(n):
    base = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(n):
        at = set(rng.sample(range(5000), 200))
        texts.append(" ".join(f"x{rng.random()}" if k in at else w for k, w in enumerate(base)).encode())
    sets = minhash_dedup.shingle_sets(texts, 2, minhash_dedup.WordHashes())
    samples = minhash_dedup.odd_sketches(minhash_dedup.signatures(sets)).view(np.int64)
    table = pa.table({"node": list(range(n)), "component": list(range(n)), "n_shingles": [len(s) for s in sets], "sketch": pa.array(list(samples)), "parity": pa.array([minhash_dedup.set_parity(s).view(np.int64) for s in sets])})
    assert len(minhash_dedup.forest(minhash_dedup.Block(table), None, 80, {})[0]) == 0


def test_token_counts_are_the_librarys(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for _, t in ROWS] + ["<|endoftext|>a<|endoftext|>", "ǅ\x1c\x85 ½² ", "it's  \n\n  x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [r.n_tokens for r in token_counts.count_tokens(df, path).orderBy("doc_id").collect()] == want
    assert token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("x")), path).count() == len(ROWS) and token_counts.count_tokens(none, path).count() == 0


def test_token_counts_split_as_the_library_for_every_assigned_character():
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    counter = token_counts.Counts(public_tokenizers.path("byte_bpe_50k.json"), {})
    split = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for at in range(0, len(known), 2000):
        text = "".join(f"a{c}1{c} {c}{c}! {c}'s" for c in known[at : at + 2000])
        assert not counter.odd(text)
        sizes = np.cumsum([0] + [len(t) for t in counter.split(text)])
        assert [x[1] for x in split(text)] == list(zip(sizes.tolist(), sizes[1:].tolist(), strict=False))


def test_packed_ids_are_the_librarys(spark, docs):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["Straße ÉCOLE İstanbul ſ ﬁ", "漢字かな 한국어 😀😀 שלום", "a\u0301e\u0308 ǅ \x1c\x85 ½²", "<|endoftext|> it's", "x" * 500, " ".join(WORDS) * 5]
    rows = [(k, t) for k, t in enumerate([t for _, t in ROWS] + odd)]
    got = packing.cut_pieces(spark.createDataFrame(rows, "doc_id long, text string"), path, 64).collect()
    want = []
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(k, at, min(64, len(ids) - at), zlib.crc32(ids[at : at + 64].tobytes()), len(ids)) for at in range(0, len(ids), 64)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing_is_whole(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut_pieces(docs, path, 64)
    out = packing.pack(pieces, 64, 5).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(r.length for r in pieces.collect())
    for own in by_seq.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 64
    assert packing.pack(packing.cut_pieces(none, path)).count() == 0
    window, _ = packing.best_fit_decreasing(np.array([5, 3, 8, 2, 5, 7]), 10)
    assert window[3] == window[2] and window[1] == window[5] and window[0] == window[4]


def test_katz_is_normalised(spark, docs, none):
    rows = [(k, prose(30)) for k in range(40)] + [(99, "unseen"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = katz.score_documents(df, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))).collect()
    assert len(out) == len(rows) and all(r.score < 0 for r in out if r.doc_id not in (99, 100))
    # the probabilities of one context's followers add up to one: score every one-word text from the start
    train = "a b\na c\na b b"
    known = [*{w for t in train.split("\n") for w in t.split()}, "zzz", ""]
    rows = [(k * 2 + 1, t) for k, t in enumerate(train.split("\n"))] + [(k * 2, f"a {w}") for k, w in enumerate(known)]
    got = {r.doc_id: r.score for r in katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 2 == 0).collect()}
    assert len(got) == len(rows) and all(v < 0 for v in got.values())
    words = katz.Words([0, 2, 1, 0, 0, 0, 0], 4)
    assert 2 * words.probability(np.array([1]))[0] + words.probability(np.array([2]))[0] + words.unknown == pytest.approx(1)
    assert katz.score_documents(docs, F.lit(True)).filter("score <> 0").count() == 0
    assert katz.score_documents(none, F.lit(False)).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_against_brute_force(spark, monkeypatch, order):
    for name, value in (("CHUNK_WORDS", 400), ("BUCKET_KEYS", 30), ("HOT", 30)):
        monkeypatch.setattr(katz, name, value)
    skewed = lambda n: " ".join(WORDS[int(200 * rng.random() ** 4)] for _ in range(n))
    rows = [(k, skewed(rng.randrange(0, 60))) for k in range(150)] + [(200, None), (201, "Unseen " + WORDS[0] + " unseen"), (203, "once ONCE"), (204, ""), (7, skewed(9)), (7, skewed(9))]
    rows += [(300 + k, "only here these words repeat only here these words repeat") for k in range(3)]  # k = 1 is held out
    docs = [(i, [*(t or "").lower().split(), None]) for i, t in rows]  # None: the end
    held = {i: i % 5 == 1 for i, _ in docs}
    grams = [Counter() for _ in range(order)]  # by length - 1; one that begins a document has "<s>" before it
    starts = sum(not held[i] for i, _ in docs)
    for i, w in docs:
        if not held[i]:
            grams[0].update((x,) for x in w)
            line = ["<s>", *w]
            for n in range(2, order + 1):
                grams[n - 1].update(zip(*(line[k:] for k in range(n)), strict=False))
    total, distinct = sum(grams[0].values()), len(grams[0])
    kinds = lambda c: [0, *(sum(v == r for v in c.values()) for r in range(1, katz.TOP + 2))]
    ds = [katz.discounts(kinds(c)) for c in grams]
    disc = lambda d, c: (d[c] if c <= katz.TOP else 1.0) * c
    lost = sum(v - disc(ds[0], v) for v in grams[0].values())
    assert lost > 0
    followers = {}
    for c in grams[1:]:
        for g, v in c.items():
            followers.setdefault(g[:-1], {})[g[-1]] = v

    def probability(context, b):
        if not context:
            return disc(ds[0], grams[0][(b,)]) / total if grams[0][(b,)] else lost / total
        seen, d = followers.get(context, {}), ds[len(context)]
        if not seen:
            return probability(context[1:], b)
        c = starts if context == ("<s>",) else grams[len(context) - 1][context]
        assert c == sum(seen.values())
        off = sum(v - disc(d, v) for v in seen.values())
        scale, left = (1.0, off / c) if off > 0 else (c / (c + 1), 1 / (c + 1))
        return disc(d, seen[b]) / c * scale if b in seen else left / (1 - sum(probability(context[1:], x) for x in seen)) * probability(context[1:], b)

    for context in [*followers][:: 1 if order == 2 else 40]:
        assert sum(probability(context, b) for b in [*(g[0] for g in grams[0]), "never seen"]) == pytest.approx(1)
    want = []
    for i, w in docs:
        base = sum(math.log10((grams[0][(x,)] + 1) / (total + distinct + 1)) for x in w)
        line = ["<s>", *w]
        score = sum(math.log10(probability(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))
        want.append((i, held[i], len(w), sum(grams[0][(x,)] > 0 for x in w), total, base, score))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in katz.score_documents(df, F.col("doc_id") % 5 == 1, order).collect()]
    key = lambda rows: sorted(rows, key=lambda r: (r[0], r[2], round(r[6], 6)))
    assert len(got) == len(want)
    for x, y in zip(key(got), key(want), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_decontamination_blocks_agree(spark, docs, none, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[20:45]).upper()), (2, "One"), (3, None), (None, "one"), (4, "!!"), (5, " ".join(LONG.split()[99:111]))], "item_id long, text string")
    one = decontamination.contamination(docs, items).orderBy("doc_id", "n_words").collect()
    monkeypatch.setattr(decontamination, "PART", 3)
    many = decontamination.contamination(docs, items, block_phrases=5).orderBy("doc_id", "n_words").collect()
    assert [(r.doc_id, r.n_words, r.spans, r["items"]) for r in one] == [(r.doc_id, r.n_words, r.spans, r["items"]) for r in many]
    got = {r.doc_id: (r["items"], [tuple(s) for s in r.spans]) for r in one}
    assert got[1] == ([1], [(20, 45)]) and got[7] == ([2], [(0, 1)]) and got[9][0] == [5] and got[4] == ([], [])
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).filter(F.size("spans") > 0).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: what it drops, keeps and changes."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = ["password=abcdefgh1 and AKIA" + "B" * 12, "é" + "0" * 40 + " api_key: 'ABCDEFGH'", "token=" + "a1" * 20 + " token=short", BASE, " ".join(NEAR), prose(60)]
    docs = docs.union(spark.createDataFrame([(10**6 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)], docs.schema))
    rows = {r.doc_id: r for r in docs.collect()}
    shown = lambda df: {r.doc_id: r for r in df.collect()}
    steps = dict(corpus_pipeline.STAGES)

    score = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), quality.learned(spark, sf)).collect()}
    assert shown(steps["quality"](spark, docs, sf)) == {i: r for i, r in rows.items() if score[i] >= 0.5}

    groups = components_by_brute_force([(i, r.text) for i, r in rows.items()], 5, 80)
    assert shown(steps["near_dedup"](spark, docs, sf)) == {i: r for i, r in rows.items() if groups[i][1] == i}

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := words(r.text))]
    phrases = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9))}
    sizes = {len(p) for p in phrases}
    tainted = {i for i, r in rows.items() for w in [words(r.text)] if any(tuple(w[k : k + n]) in phrases for n in sizes for k in range(len(w) - n + 1))}
    assert tainted and shown(steps["decontamination"](spark, docs, sf)) == {i: r for i, r in rows.items() if i not in tainted}

    clean = shown(steps["secrets"](spark, docs, sf))
    assert clean.keys() == rows.keys()
    changed = 0
    for i, r in rows.items():
        spans = sorted((m.start(), m.end()) for _, rule, group, least in BASE_RULES for m in rule.finditer(r.text) if len(m[group]) >= least)
        out, at = "", 0
        for start, end in spans:
            if start >= at:
                out += r.text[at:start] + "[SECRET]"
            at = max(at, end)
        want = out + r.text[at:]
        if "PRIVATE KEY" not in r.text:
            assert clean[i].text == want and clean[i].n_chars == (len(want) if spans else r.n_chars)
        changed += bool(spans)
    assert changed

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed: dict = {}
    for r in steps["packing"](spark, docs, sf).collect():
        packed.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, r in rows.items():
        n = len(library.encode(r.text, add_special_tokens=False).ids) + 1
        own = sorted(packed[i])
        assert own[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == n


def test_pipeline_runs(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
