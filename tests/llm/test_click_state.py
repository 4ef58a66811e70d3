"""The state of click deduplication: small blobs, stores of bounded memory that replay no changelogs."""

import datetime

import numpy as np

from corpusmill.llm import click_dedup


def windows(n):
    rng = np.random.default_rng(7)
    numbers = {"id": np.sort(rng.choice(10 * n, n, replace=False)).astype(np.int64), "start": rng.integers(480_000, 480_200, n), "rows": rng.integers(1, 4, n), "conflicts": np.zeros(n, np.int64), "crc": np.zeros(n, np.int64)}
    return {**numbers, "hash": np.frombuffer(rng.bytes(32 * n), "S32"), "spread": np.zeros(n, bool)}


def test_blobs_are_compressed_and_read_back():
    held = windows(20_000)
    blob = click_dedup.packed(held)
    assert len(blob) < 45 * 20_000
    back = click_dedup.unpack(blob)
    assert all(np.array_equal(back[c], held[c]) for c in held)


def test_stores_replay_no_changelogs_and_share_bounded_memory(spark, monkeypatch):
    state, seen, inner = "spark.sql.streaming.stateStore.rocksdb", [], click_dedup.closed_windows
    keys = [f"{state}.changelogCheckpointing.enabled", f"{state}.boundedMemoryUsage", f"{state}.maxMemoryUsageMB"]

    def spy(*args):
        seen.append([spark.conf.get(k) for k in keys])
        return inner(*args)

    monkeypatch.setattr(click_dedup, "closed_windows", spy)
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(1, 5, "a", 1.0, at, "x", at), (1, 5, "b", 1.0, at, "x", at)]
    clicks = spark.createDataFrame(rows, "click_id long, client_id long, kind string, value double, ts timestamp, props string, arrived_at timestamp")
    before = [spark.conf.get(k, None) for k in keys]
    out = click_dedup.deduplicate(clicks).collect()
    assert sum(r.n_repeats + 1 for r in out) == 4
    assert seen and all(x == ["false", "true", str(click_dedup.STORE_MB)] for x in seen)
    assert [spark.conf.get(k, None) for k in keys] == before
