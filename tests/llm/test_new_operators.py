"""License scans, click deduplication and whitening: brute force on small fixtures, odd rows, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import click_dedup, licences, whitening

DOC = "doc_id long, text string, score array<string>, places int"


# --- licences --------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(texts):
    """For each text: base starts and labels, all labels, score; every start of every template is tried."""
    docs = [plain_words(t) for t in texts]
    count = Counter(w for d in docs for w in set(d))
    rarity = lambda w: (-math.log((len(docs) + 1) / (count[w] + 1)), w)
    out = []
    for d in docs:
        base, labels, best = [], set(), 0.0
        for label, phrase in licences.BASE:
            p = phrase.split()
            own = [i for i in range(len(d)) if d[i : i + len(p)] == p]
            base += [(i, label) for i in own]
        for label, notice, keys in licences.NOTICES:
            t = notice.split()
            if not all(w in d for k in keys for w in k.split()):
                continue
            looked = [w for w in sorted(set(t), key=rarity) if w in d][: licences.RARE]
            points = {w: {i - o for i, x in enumerate(d) if x == w for o, y in enumerate(t) if y == w} for w in looked}
            at = lambda i, w: any(0 <= j < len(d) and d[j] == w for j in range(i - licences.SLACK, i + licences.SLACK + 1))
            for s in sorted(set().union(*points.values())):
                votes = sum(any(abs(s - x) <= licences.SLACK for x in own) for own in points.values())
                held = all(any(d[i : i + len(k.split())] == k.split() for i in range(max(0, s - licences.SLACK), s + len(t) - len(k.split()) + licences.SLACK + 1)) for k in keys)
                if votes >= max(2, math.ceil(licences.SHARE * len(looked))) and held:
                    labels.add(label)
                    best = max(best, sum(at(s + o, w) for o, w in enumerate(t)) / len(t))
        starts = [i for i, _ in base]
        names = {n for _, n in base}
        out.append((len(d), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)), 1.0 if base else best))
    return out


def license_texts():
    rng = random.Random(3)
    common = [w for _, n, _ in licences.NOTICES for w in n.split()] + ["alpha", "beta", "naïve", "漢字"]
    noise = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [None, "", " \n", "cc by", "CC-BY cc by", "All rights reserved. ALL RIGHTS RESERVED", "general public license" * 3, "rights reserved all", "all  rights\treserved"]
    for _, notice, _ in licences.NOTICES:
        own = notice.split()
        texts.append(f"{noise(30)} {notice.title()}. {noise(30)}")
        changed = list(own)
        changed[rng.randrange(len(own))] = "other"
        changed.insert(rng.randrange(len(own)), "inserted")
        texts.append(f"{noise(5)} {' '.join(changed)}")
    texts += [noise(rng.randrange(1, 400)) for _ in range(60)]
    texts += ["the license " * 20_000 + "released under the MIT License", "all rights reserved " * 3000]
    return texts


def test_license_scan_against_brute_force(spark, tmp_path):
    texts = license_texts()
    rows = [(i, t, ["x"], 1) for i, t in enumerate(texts)] + [(0, texts[9], None, None), (None, "cc by", None, None)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = licences.op11_license_scan(spark, f"file://{tmp_path}").collect()
    want = plain_scan([r[1] for r in rows])
    shown = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got)
    assert shown == Counter((r[0], *w[:-1], round(w[-1], 9)) for r, w in zip(rows, want, strict=True))
    assert {x for r in got for x in r.labels.split(",")} >= {n for n, *_ in licences.NOTICES}
    empty = spark.createDataFrame([], DOC)
    assert licences.find_licences(empty).count() == 0


def test_license_places_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in licences.op11_license_scan(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, w in zip(rows, plain_scan([r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels) == w[:-1] and abs(g.score - w[-1]) < 1e-12


# --- clicks ----------------------------------------------------------------------------------------


def plain_fold(held, rows, width):
    """held: id -> [start, hash, rows, conflicts, crc]; rows (id, hour, hash, crc, n)."""
    closed = []
    for i, hour, h, crc, n in sorted(rows):
        if i in held and hour > held[i][0] + width:
            closed.append((i, *held.pop(i)))
        own = held.setdefault(i, [hour, h, 0, 0, 0])
        own[2] += n
        if h != own[1]:
            own[3] += n
            own[4] += n * crc
    return closed


def test_fold_against_a_walk():
    rng = random.Random(7)
    held, blob, crowd = {}, None, [hashlib.sha256(bytes([k])).digest() for k in range(6)]
    for b in range(6):
        rows = [(rng.randrange(40), 100 * b + rng.randrange(-30, 90), (h := rng.choice(crowd)), h[0] << 24, rng.randrange(0, 4)) for _ in range(300)]
        want = plain_fold(held, rows, 24)
        columns = {c: np.array(x) for c, x in zip(("id", "hour", "hash", "crc", "n"), zip(*rows, strict=True), strict=True)}
        columns |= {"hash": np.frombuffer(b"".join(r[2] for r in rows), "S32"), "spread": np.zeros(len(rows), bool)}
        after, closed = click_dedup.fold(click_dedup.unpack(blob), columns)
        blob = click_dedup.packed(after)
        again = click_dedup.unpack(blob)
        shown = lambda w: [(int(i), int(s), bytes(h).ljust(32, b"\0"), int(n), int(c), int(x)) for i, s, h, n, c, x in zip(*(w[k] for k in ("id", "start", "hash", "rows", "conflicts", "crc")), strict=True)]
        assert sorted(x for part in closed for x in shown(part)) == sorted(want)
        assert shown(again) == sorted((i, *v) for i, v in held.items())


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, shard int, hash array<int>"


def click_rows():
    rng = random.Random(2)
    zero = datetime(2024, 1, 1)
    rows = []
    for k in range(400):
        i = 5 if k % 3 == 0 else rng.randrange(40)  # one id has a third of the rows and more
        at = zero + timedelta(minutes=rng.randrange(60 * 24 * 60))
        rows.append((i, at, at + timedelta(hours=rng.choice([0, 0, 1, 300])), rng.randrange(4), rng.choice(["a", None]), rng.choice([1.25, -0.005, None]), rng.choice(["{}", "x|y" * 500, None])))
    rows += rows[:60] + [rows[3]] * 50
    rows += [(None, zero, zero, 1, "a", 1.0, ""), (7, None, None, None, None, None, None), (8, None, zero, None, None, None, None), (-3, zero, zero, 1, "a", 1.0, ""), (-2, zero, zero, 1, "a", 1.0, "")]
    return [(*r, 1, None) for r in rows]


@pytest.fixture
def two_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot, least_day", [(20, 0), (10**6, 0), (10**6, 40)])
def test_click_dedup_against_sql(spark, two_tasks, tmp_path, hot, least_day):
    """With least_day, batches between the first row and the others are empty."""
    rows = [r for k, r in enumerate(click_rows()) if k < 1 or r[2] is None or r[2] > datetime(2024, 1, 1) + timedelta(days=least_day)]
    spark.createDataFrame(rows, CLICKS).coalesce(2).write.parquet(f"file://{tmp_path}/clicks.parquet")
    got = click_dedup.deduplicate(spark.read.parquet(f"file://{tmp_path}/clicks.parquet"), hot=hot).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW clicks AS SELECT * FROM '{tmp_path}/clicks.parquet/*.parquet'")
    want = con.sql(click_dedup.OP12_SQL).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert len(want) > 50 and want.n_conflicts.sum() > 0 and want.closed_batch.nunique() > (2 if least_day else 4) and rows(got) == rows(want)


def test_click_dedup_without_rows(spark):
    out = click_dedup.deduplicate(spark.createDataFrame([], CLICKS))
    assert out.columns == ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"] and not out.count()


def test_micros_of_stamps_with_a_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.000001' AS a, timestamp'2024-03-10 02:30:00.000001 UTC' AS b")
    assert set(df.select(click_dedup.micros(df, "a"), click_dedup.micros(df, "b")).first()) == {1710037800000001}


# --- whitening -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, n int, whitened string"


def checked(got, vectors):
    """got: rows by id; vectors: id -> list, all of one length; held against a plain eigendecomposition."""
    x = np.floor(1024 * np.array(list(vectors.values()))).astype(np.int64) + 100000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(8, x.shape[1], n)
    for place, i in enumerate(vectors):
        own = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, k + 1)) and {r.n for r in own} == {n}
        assert {r.deviation for r in own} == {int(((n * x[place] - total) ** 2).sum())}
        for r in own:
            if e[r.component - 1] > 1e-6:
                assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
                assert abs(abs(r.whitened) - abs(centred[place] @ axes[:, r.component - 1] / e[r.component - 1] ** 0.5)) < 1e-6
            else:
                assert r.whitened is None and r.explained == 0
    for c in range(1, k + 1):
        if e[c - 1] > 1e-6:  # one sign for all rows of a component
            signs = {np.sign(r.whitened * (centred[place] @ axes[:, c - 1])) for place, i in enumerate(vectors) for r in got[i] if r.component == c and abs(r.whitened) > 1e-6}
            assert len(signs) == 1


def whitened(spark, rows, parts):
    out: dict = {}
    for r in whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(parts)).collect():
        out.setdefault(r.vec_id, []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_against_numpy(spark, parts):
    r = np.random.default_rng(8)
    vectors = {i: v.tolist() for i, v in enumerate(r.normal(size=(300, 20)) @ r.normal(size=(20, 20)) * 0.1)}
    vectors[7] = vectors[3]
    checked(whitened(spark, [(i, v, 1, "x") for i, v in vectors.items()], parts), vectors)


def test_whitening_of_odd_vectors(spark):
    r = np.random.default_rng(9)
    short = {i: r.normal(size=3).tolist() for i in range(20)}
    long = {100 + i: [*r.normal(size=4).tolist(), 0.5] for i in range(9)}  # one dimension without variance
    odd = [(50, None), (51, []), (52, [None, 1.0, 2.0]), (53, [float("nan")] * 3), (54, [float("inf"), 0.0, 0.0]), (55, [1e300, 0.0, 0.0])]
    got = whitened(spark, [(i, v, None, None) for i, v in [*short.items(), *long.items(), *odd, (60, [1.0] * 7)]], 7)
    assert set(got) == {*short, *long, 60} and got[60][0].n == 1 and got[60][0].whitened is None
    checked({i: x for i, x in got.items() if i in short}, short)
    checked({i: x for i, x in got.items() if i in long}, long)
    assert whitened(spark, [(1, None, None, None)], 2) == {} and whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_summaries_keep_all_dimensions():
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 6)) + 1e5
    parts = [whitening.summary(x[a:b]) for a, b in ((0, 2), (2, 3), (3, 30), (30, 50))]
    left = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    whole = x - x.mean(0)
    np.testing.assert_allclose(left.vectors.T @ (left.values[:, None] ** 2 * left.vectors), whole.T @ whole, rtol=1e-8, atol=1e-7)
    big = whitening.Model(10**12, np.array([10**17], np.int64), np.ones(1), np.ones((1, 1)), np.ones(1))
    assert big.deviations(np.array([[100_001], [200_000]])) == [None, None]
    assert whitening.Model(3, np.array([10]), np.ones(1), np.ones((1, 1)), np.ones(1)).deviations(np.array([[5]])) == [25]
