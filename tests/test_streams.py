"""Streams with state: the packer row by row, the exchange buffer, endless passes."""

import random

import pytest

from corpusmill.operators import pack
from corpusmill.plans import jobs
from corpusmill.sources.corpus import CorpusCase
from corpusmill.streaming.packing import pack_stream
from corpusmill.streaming.passes import TicketReader, tickets
from corpusmill.streaming.shuffle import drawn, shuffle_stream
from corpusmill.streaming.state import PROVIDER, needs_rocks_db


@pytest.fixture
def two_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}"


def fed(spark, at, given, schema, made):
    """Write rows, run the stream on its checkpoint, read all that came out so far."""
    spark.createDataFrame(given, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    out = made(spark.readStream.schema(schema).parquet(f"{at}/in"))
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def test_stream_makes_the_examples_of_a_batch(spark, two_tasks, at):
    rng = random.Random(3)
    rows = [(i % 2, [i] * (n := rng.randrange(1, 12)), [i + 1] * n, i) for i in range(90)]
    schema = "rank int, inputs array<int>, labels array<int>, n long"
    made = lambda s: pack_stream(s, "c", 16, 0, 7, order="n")
    for part in (rows[:35], rows[35:36], rows[36:]):
        fed(spark, at, part, schema, made)
    got = fed(spark, at, [(0, None, None, 999), (1, None, None, 999)], schema, made).orderBy("rank", "example_no").collect()
    want = []
    for rank in (0, 1):
        want += list(pack.pack_rows(((rank, a, b) for r, a, b, _ in rows if r == rank), "c", 16, 0, 7))
    assert [tuple(r) for r in got] == [(r, k, *(c.tolist() for c in rest)) for r, k, *rest in want]


def plain_exchange(rows, key, seed, size):
    """The buffer as a list; None ends a pass."""
    slots, out, seen = [], [], 0
    for row in rows:
        if row is None:
            out += [slots[s] for s in sorted(range(len(slots)), key=lambda s: (drawn(seed, key, seen + s, 1 << 62), s))]
            seen, slots = seen + len(slots), []
            continue
        if len(slots) < size:
            slots.append(row)
        else:
            s = drawn(seed, key, seen, size)
            out.append(slots[s])
            slots[s] = row
        seen += 1
    return out


def test_exchange_buffer_against_a_list(spark, two_tasks, at):
    schema = "shard int, n long, text string, vector array<double>, over boolean"
    rows = [(i % 2, i, f"t{i}" if i % 5 else None, [i / 2, None], False) for i in range(120)]
    end = lambda n: [(k, n, None, None, True) for k in (0, 1)]
    made = lambda s: shuffle_stream(s, "shard", 17, 9, "n", "over")
    for part in (rows[:10], rows[10:77], rows[77:100] + end(100)):
        fed(spark, at, part, schema, made)
    got = fed(spark, at, rows[100:] + end(500), schema, made).orderBy("shard", "sent_no").collect()
    want = []
    for k in (0, 1):
        own = [r for r in rows if r[0] == k]
        want += [(*r[:4], n) for n, r in enumerate(plain_exchange([*(r for r in own if r[1] < 100), None, *(r for r in own if r[1] >= 100), None], str(k), 17, 9))]
    assert [(r.shard, r.n, r.text, r.vector, r.sent_no) for r in got] == want
    order = [r.n for r in got if r.shard == 0]
    assert order != sorted(order) and sorted(order) == list(range(0, 120, 2))
    with pytest.raises(ValueError, match="slot"):
        shuffle_stream(spark.range(1), "id", 1, 0)


def test_tickets_go_on_from_their_offset(spark, at):
    reader = TicketReader(3, 2, 1, None)
    offset, seen = reader.initialOffset(), []
    for _ in range(4):
        rows, offset = reader.read(offset)
        seen += list(rows)
    assert seen == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)] and offset == {"pass": 3, "position": 2}
    assert tickets(spark, 3).isStreaming
    rows, offset = TicketReader(3, 9, 0, 2).read({"pass": 1, "position": 1})
    assert list(rows) == [(1, 1), (1, 2)] and offset == {"pass": 2, "position": 0}


def test_endless_passes_resume_and_equal_the_batch(spark, two_tasks, at):
    case = CorpusCase("small", "", "", "", "default", "train", "text")
    docs = spark.createDataFrame([(i, "x " * (i % 7)) for i in range(60)], "id long, text string")

    def words():
        class Words:
            def tokenize(self, text):
                return [20 + len(text)] * text.count(" ")

        return Words()

    go = lambda last: jobs.stream_examples(docs, "id", words(), case, 8, f"{at}/examples", f"{at}/check", 3, 2, 17, 2, 0, last, {"availableNow": True}).awaitTermination()
    for last in (1, 2, 2):  # started anew on one checkpoint; the last start has nothing to do
        go(last)
        go(last)
    got = spark.read.parquet(f"{at}/examples").drop("batch")
    want = jobs.examples(docs, "id", words(), case, 8, 2, 2, 17, 3)
    rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and got.select("pass_index").distinct().count() == 2
    with pytest.raises(ValueError, match="empty"):
        jobs.stream_examples(docs.limit(0), "id", words(), case, 8, at, at, 3)


def test_another_state_store_is_refused(spark):
    before = spark.conf.get(PROVIDER)
    try:
        spark.conf.set(PROVIDER, "a.b.Other")
        with pytest.raises(ValueError, match="RocksDB"):
            needs_rocks_db(spark)
    finally:
        spark.conf.set(PROVIDER, before)
