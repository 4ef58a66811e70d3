"""Expiring deduplication of clicks: a stateful stream keyed by shard, one Arrow blob of open windows a shard.

A shard is a hash range of click ids. Its whole state is one Arrow record batch (struct of arrays, sorted by
id): the open window of each id. A micro-batch's rows of a shard are sorted by (id, hour, hash) and merged
with the blob's ids by binary search; all ids of the shard are folded together, one round for each window
that an id goes through, so there is no Python step a row. Windows whose deadline the watermark has passed
are masked out and the blob is written again. A shard has one event-time timer, that of its earliest
deadline, which closes windows of shards that get no more rows.

The stream's clock is the hour. Its watermark trails by `LATE` hours and a millisecond, so that it stands
just below the last hour that is not late. Each of the `BATCHES` batches is released into the folder that
the query reads, and the query is started anew on one checkpoint, for one micro-batch. What a batch's
watermark closes is closed in the next start, before its rows are looked at, and by timers in shards that
have no rows then; it counts as closed after the batch before. An end mark in the last batch lies beyond
all deadlines; one more start, with a mark alone, closes what is open.

Hot ids: an id with more than `HOT` copies is spread over several shards by hash. Its equal copies are
counted before, and each of its shards also gets the least hash of each of the id's hours, so that all of
them open and close the same windows and count their own rows; the counts are summed afterwards.

Nulls: a row without click_id or arrived_at has no copies; a null or non-finite value or one whose hundredfold
is beyond a long, and any other null, is empty in the hash. A negative click_id has copies j = 0 to click_id % 3 by a remainder that follows the
sign: one if it is 0, none otherwise. Repeated rows are repeats; ties (same hour and hash) are one opener
and its repeats. Texts in props may be of any length: only their hash travels. Other columns are left out.
Empty table: no windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.llm.common import HOT_KEYS, partitions, read, shared_dir

#: Hours in which a repeat belongs to its opener, hours after which a row is late, batches.
WIDTH, LATE, BATCHES = 24, 96, 8
#: Copies of one id, and copies of one shard in one batch, that a task may hold.
HOT, SHARD_ROWS = 100_000, 250_000
HOUR_MS = 3_600_000
FED = "shard int, at timestamp, id long, hour long, hash binary, crc long, n long, spread boolean"
CLOSED = "click_id long, start_hour long, closed_batch long, n_rows long, n_conflicts long, conflict_crc long, hash binary, spread boolean"
RESULT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: MB of the block cache and the write buffers that all state stores of an executor share.
STORE_MB = 64

NUMBERS = ("id", "start", "rows", "conflicts", "crc")
BLOB = pa.schema([*((n, pa.int64()) for n in NUMBERS), ("hash", pa.binary(32)), ("spread", pa.bool_())])
Windows = dict[str, np.ndarray]


# --- the fold of one shard -------------------------------------------------------------------------


def unpack(blob: bytes | None) -> Windows:
    """The open windows of a blob, sorted by id."""
    if blob is None:
        return {**{n: np.zeros(0, np.int64) for n in NUMBERS}, "hash": np.zeros(0, "S32"), "spread": np.zeros(0, bool)}
    batch = pa.ipc.open_stream(blob).read_next_batch()
    hashes = batch.column("hash")
    raw = np.frombuffer(hashes.buffers()[1], np.uint8)[32 * hashes.offset : 32 * (hashes.offset + len(hashes))]
    return {**{n: batch.column(n).to_numpy() for n in NUMBERS}, "hash": raw.view("S32"), "spread": batch.column("spread").to_numpy(zero_copy_only=False)}


def packed(windows: Windows) -> bytes:
    n = len(windows["id"])
    hashes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(windows["hash"].tobytes())])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, BLOB, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([*(pa.array(windows[c], pa.int64()) for c in NUMBERS), hashes, pa.array(windows["spread"], pa.bool_())], schema=BLOB))
    return out.getvalue().to_pybytes()


def picked(windows: Windows, which: np.ndarray) -> Windows:
    return {c: x[which] for c, x in windows.items()}


def joined(parts: list[Windows]) -> Windows:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def fold(held: Windows, rows: Windows, width: int = WIDTH) -> tuple[Windows, list[Windows]]:
    """Open windows after a batch, and those that later rows closed. rows: id, hour, hash, crc, n, spread, in any order."""
    order = np.lexsort((rows["hash"], rows["hour"], rows["id"]))
    rows = {c: x[order] for c, x in rows.items()}
    hour, hashes = rows["hour"], rows["hash"]
    ids, place = np.unique(rows["id"], return_index=True)
    end = np.append(place[1:], len(hour))
    low = hour.min()
    span = int(hour.max() - low) + 2
    line = np.repeat(np.arange(len(ids)), end - place) * span + (hour - low)  # rises with (id, hour)
    at = np.searchsorted(held["id"], ids)
    known = at < len(held["id"])
    known[known] = held["id"][at[known]] == ids[known]

    now = {c: np.zeros(len(ids), x.dtype) for c, x in held.items()}
    now["id"] = ids
    for c in now:
        now[c][known] = held[c][at[known]]
    closed: list[Windows] = []

    def opened(who: np.ndarray) -> None:
        first = place[who]
        for c, x in (("start", hour[first]), ("hash", hashes[first]), ("spread", rows["spread"][first])):
            now[c][who] = x
        for c in ("rows", "conflicts", "crc"):
            now[c][who] = 0

    opened(np.flatnonzero(~known))
    who = np.arange(len(ids))
    while len(who):
        reach = np.clip(now["start"][who] + width - low, -1, span - 1)
        stop = np.clip(np.searchsorted(line, who * span + reach, side="right"), place[who], end[who])
        size = stop - place[who]
        edge = np.concatenate([[0], np.cumsum(size)])
        mine = np.repeat(place[who] - edge[:-1], size) + np.arange(edge[-1])
        differs = hashes[mine] != np.repeat(now["hash"][who], size)
        n = rows["n"][mine]
        for c, x in (("rows", n), ("conflicts", n * differs), ("crc", n * differs * rows["crc"][mine])):
            total = np.concatenate([[0], np.cumsum(x)])
            now[c][who] += total[edge[1:]] - total[edge[:-1]]
        place[who] = stop
        who = who[stop < end[who]]
        if len(who):
            closed.append(picked(now, who))
            opened(who)
    rest = np.ones(len(held["id"]), bool)
    rest[at[known]] = False
    out = joined([picked(held, rest), now])
    return picked(out, np.argsort(out["id"], kind="stable")), closed


# --- the stream ------------------------------------------------------------------------------------


class Expiring(StatefulProcessor):
    """One start of the query: `batch` is its number, `before` that of the last one; hours are counted from `origin` on the stream's clock."""

    def __init__(self, batch: int, before: int, origin: int, width: int = WIDTH) -> None:
        self.batch, self.before, self.origin, self.width = batch, before, origin, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "blob binary, alarm long")

    def deadline(self, start: np.ndarray) -> np.ndarray:
        """The moment on the clock between the last hour of a repeat and the next."""
        return (start + self.width - self.origin + 1) * HOUR_MS + HOUR_MS // 2

    def shown(self, windows: Windows, batch: int) -> pd.DataFrame:
        hashes = windows["hash"].tobytes()
        frame = {"click_id": windows["id"], "start_hour": windows["start"], "closed_batch": np.full(len(windows["id"]), batch), "n_rows": windows["rows"], "n_conflicts": windows["conflicts"], "conflict_crc": windows["crc"]}
        return pd.DataFrame(frame | {"hash": [hashes[i : i + 32] for i in range(0, len(hashes), 32)], "spread": windows["spread"]})

    def expired(self, windows: Windows, watermark: int) -> tuple[Windows, Windows]:
        over = self.deadline(windows["start"]) < watermark
        return picked(windows, over), picked(windows, ~over)

    def keep(self, windows: Windows, alarm: int | None) -> None:
        if not len(windows["id"]):
            self.state.clear()
            return
        first = int(self.deadline(windows["start"].min()))
        if alarm is None or first < alarm:
            self.handle.registerTimer(first)
            alarm = first
        self.state.update((packed(windows), alarm))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        frames = [f[(f["n"] >= 0).to_numpy() & ((f["hour"].to_numpy() - self.origin + 1) * HOUR_MS > watermark)] for f in rows]
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        own = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in ("id", "hour", "crc", "n", "spread")}
        own["hash"] = np.frombuffer(b"".join(h for f in frames for h in f["hash"]), "S32")
        blob, alarm = self.state.get() if self.state.exists() else (None, None)
        gone, held = self.expired(unpack(blob), watermark)
        if len(gone["id"]):
            yield self.shown(gone, self.before)
        held, closed = fold(held, own, self.width)
        for part in closed:
            yield self.shown(part, self.batch)
        self.keep(held, alarm)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.state.exists():
            return
        blob, _ = self.state.get()
        gone, held = self.expired(unpack(blob), timerValues.getCurrentWatermarkInMs())
        if len(gone["id"]):
            yield self.shown(gone, self.before)
        self.keep(held, None)

    def close(self) -> None:
        pass


def closed_windows(stream: DataFrame, batch: int, before: int, origin: int, width: int = WIDTH, late: int = LATE) -> DataFrame:
    """A stream of FED rows: the windows that close (CLOSED), in append mode. `at` is the clock: (hour - origin + 1) hours."""
    clocked = stream.withWatermark("at", f"{late * HOUR_MS + 1} milliseconds")
    return clocked.groupBy("shard").transformWithStateInPandas(Expiring(batch, before, origin, width), CLOSED, "Append", "EventTime")


# --- copies in batches -----------------------------------------------------------------------------


def micros(df: DataFrame, name: str) -> Column:
    """UTC microseconds since 1970 of a timestamp, of one without a zone as if it were UTC."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.unix_micros(F.concat(F.col(name).cast("string"), F.lit("Z")).cast("timestamp"))
    return F.unix_micros(F.col(name).cast("timestamp"))


def copies(clicks: DataFrame) -> DataFrame:
    """(id, hour, line, hash, crc): each row's copies; `line` is where a copy stands among the batches."""
    scaled = F.floor(F.col("value").cast("double") * 100 + 0.5).cast("long")
    number = F.when(~F.isnan("value") & (F.abs("value") < 9e16), scaled)
    parts = [F.col("client_id").cast("string"), F.col("kind"), number.cast("string"), micros(clicks, "ts").cast("string"), F.col("props")]
    rows = clicks.select(F.col("click_id").cast("long").alias("id"), F.floor(micros(clicks, "arrived_at") / F.lit(3_600_000_000).cast("decimal(20,0)")).cast("long").alias("came"), F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).alias("said"))
    rows = rows.filter("came is not null and id is not null and id % 3 >= 0").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))))
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", "id", "j").cast("binary"))).withColumn("hour", F.col("came") + 6 * F.col("j") * (F.col("c") % 10))
    text = F.sha2(F.concat_ws("|", "said", F.col("c") % 3).cast("binary"), 256)
    return rows.select("id", "hour", (F.col("hour") + F.floor(F.col("c") / 10) % 200).alias("line"), text.alias("hash"))


def spread_out(rows: DataFrame, hot: DataFrame, few: bool, shards: int) -> DataFrame:
    """rows (batch, id, hour, hash): with shard, n and spread; hot ids counted, over several shards, with their openers."""
    shard = lambda salt: F.pmod(F.xxhash64("id", salt), F.lit(shards)).cast("int")
    names = ["batch", "id", "hour", "hash", "n", "spread", "shard"]
    marked = rows.join(F.broadcast(hot) if few else hot, "id", "left")
    plain = marked.filter("salts is null").withColumn("n", F.lit(1).cast("long")).withColumn("spread", F.lit(False)).withColumn("shard", shard(F.lit(0)))
    counted = marked.filter("salts is not null").groupBy("batch", "id", "hour", "hash", "salts").agg(F.count("*").alias("n")).withColumn("spread", F.lit(True))
    own = counted.withColumn("shard", shard(F.pmod(F.crc32(F.col("hash").cast("binary")), F.col("salts"))))
    openers = marked.filter("salts is not null").groupBy("batch", "id", "hour", "salts").agg(F.min("hash").alias("hash")).withColumn("n", F.lit(0).cast("long")).withColumn("spread", F.lit(True))
    openers = openers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("shard", shard(F.col("salt")))
    return plain.select(*names).union(own.select(*names)).union(openers.select(*names))


def deduplicate(clicks: DataFrame, batches: int = BATCHES, width: int = WIDTH, late: int = LATE, hot: int = HOT) -> DataFrame:
    """RESULT rows: the windows of all copies, fed in `batches` batches. Its tables lie in a new shared folder."""
    spark = clicks.sparkSession
    folder = f"{shared_dir(spark)}/clicks-{uuid.uuid4().hex}"
    rows = copies(clicks)
    facts = rows.agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), F.min("hour").alias("origin"), F.max("hour").alias("last")).first()
    if not facts.n:
        return spark.createDataFrame([], RESULT)
    rows = rows.withColumn("batch", F.floor((F.col("line") - facts.low) * batches / F.lit(facts.high - facts.low + 1)).cast("int")).drop("line")
    crowds = rows.groupBy("id").count().filter(F.col("count") > hot).select("id", F.ceil(F.col("count") / hot).cast("long").alias("salts"))
    n_hot = crowds.limit(HOT_KEYS + 1).count()
    shards = max(4 * partitions(spark), -(-facts.n // (batches * SHARD_ROWS)))
    if n_hot:
        fed = spread_out(rows, crowds, n_hot <= HOT_KEYS, shards)
    else:
        fed = rows.withColumn("n", F.lit(1).cast("long")).withColumn("spread", F.lit(False)).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(shards)).cast("int"))
    clock = F.timestamp_millis((F.col("hour") - facts.origin + 1) * HOUR_MS)
    fed = fed.select("batch", "shard", clock.alias("at"), "id", "hour", F.unhex("hash").alias("hash"), F.crc32(F.col("hash").cast("binary")).alias("crc"), "n", "spread")
    beyond = facts.last + width + late + 2
    mark = spark.range(batches - 1, batches + 1).select(F.col("id").cast("int").alias("batch"), F.lit(0).alias("shard"), F.timestamp_millis(F.lit((beyond - facts.origin + 1) * HOUR_MS)).alias("at"), F.lit(0).cast("long").alias("id"), F.lit(beyond).cast("long").alias("hour"), F.unhex(F.lit("")).alias("hash"), F.lit(0).cast("long").alias("crc"), F.lit(-1).cast("long").alias("n"), F.lit(False).alias("spread"))
    fed.union(mark).write.option("compression", "zstd").partitionBy("batch").parquet(f"{folder}/cut")
    out = feed(spark, folder, facts.origin, batches, width, late)
    whole = out.filter("not spread").select("click_id", "start_hour", "closed_batch", "n_rows", "n_conflicts", "conflict_crc", "hash")
    if n_hot:
        parts = out.filter("spread").groupBy("click_id", "start_hour", "closed_batch", "hash").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_conflicts", "conflict_crc")])
        whole = whole.unionByName(parts)
    return whole.select("click_id", "start_hour", "closed_batch", (F.col("n_rows") - 1).alias("n_repeats"), "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))


def feed(spark: SparkSession, folder: str, origin: int, batches: int, width: int, late: int) -> DataFrame:
    """Release batch after batch of `folder`/cut, and the end mark, and run the query on each; the closed windows (CLOSED)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
    fs = place("").getFileSystem(conf)
    fs.mkdirs(place("fed"))
    # a start has one micro-batch: a store that stayed open after it would hold its files until maintenance comes, and
    # with changelogs each start would write the blobs of all starts before it into the store's memory once more
    state = "spark.sql.streaming.stateStore.rocksdb"
    settings = {f"{state}.boundedMemoryUsage": "true", f"{state}.maxMemoryUsageMB": str(STORE_MB), "spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false", f"{state}.changelogCheckpointing.enabled": "false", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        last = -1
        for batch in range(batches + 1):
            if not fs.exists(place(f"cut/batch={batch}")):
                continue
            if not fs.rename(place(f"cut/batch={batch}"), place(f"fed/{batch}")):
                raise OSError(f"could not release batch {batch}")
            stream = spark.readStream.schema(FED).option("recursiveFileLookup", "true").parquet(f"{folder}/fed")
            sink = closed_windows(stream, batch, last, origin, width, late).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/closed").option("compression", "zstd")
            sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            last = batch
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for p in ("cut", "fed", "checkpoint"):
        fs.delete(place(p), True)
    return spark.read.schema(CLOSED).parquet(f"{folder}/closed")


def op12_click_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "clicks"))


#: The fold as a walk over each id's rows: opening doesn't depend on timers, as a row that isn't late lies beyond all expired windows.
OP12_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
base AS (SELECT click_id AS id, CAST(floor(epoch_us(arrived_at) / 3600000000) AS BIGINT) AS came,
  coalesce(CAST(client_id AS VARCHAR), '') || '|' || coalesce(kind, '') || '|' || coalesce(CAST(CAST(floor(100 * value + 0.5) AS BIGINT) AS VARCHAR), '') || '|' || coalesce(CAST(epoch_us(ts) AS VARCHAR), '') || '|' || coalesce(props, '') AS said,
  unnest(range(0, click_id % 3 + 1)) AS j FROM clicks WHERE arrived_at IS NOT NULL AND click_id % 3 >= 0),
named AS (SELECT DISTINCT id, j, CAST(id AS VARCHAR) || ':' || CAST(j AS VARCHAR) AS s FROM base),
coded AS (SELECT id, j, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS c FROM named, crc_table),
copy AS (SELECT b.id, came + 6 * b.j * (c % 10) AS hour, came + 6 * b.j * (c % 10) + (c // 10) % 200 AS line, sha256(said || '|' || CAST(c % 3 AS VARCHAR)) AS hash FROM base b JOIN coded USING (id, j)),
ends AS (SELECT min(line) AS low, max(line) AS high FROM copy),
cut AS (SELECT id, hour, hash, CAST((line - low) * {BATCHES} // (high - low + 1) AS BIGINT) AS batch FROM copy, ends),
numbers AS (SELECT CAST(range AS BIGINT) AS batch FROM range({BATCHES + 1})),
tops AS (SELECT n.batch, (SELECT max(hour) FROM cut WHERE cut.batch < n.batch) AS m FROM numbers n),
kept AS (SELECT id, hour, hash, cut.batch, row_number() OVER (PARTITION BY id ORDER BY cut.batch, hour, hash) AS k FROM cut JOIN tops USING (batch) WHERE m IS NULL OR hour >= m - {LATE}),
walk AS (
  SELECT id, k, batch, hour, hash, hour AS start_hour, batch AS opened, hash AS opener FROM kept WHERE k = 1
  UNION ALL
  SELECT n.id, n.k, n.batch, n.hour, n.hash, CASE WHEN n.hour > w.start_hour + {WIDTH} THEN n.hour ELSE w.start_hour END, CASE WHEN n.hour > w.start_hour + {WIDTH} THEN n.batch ELSE w.opened END, CASE WHEN n.hour > w.start_hour + {WIDTH} THEN n.hash ELSE w.opener END
  FROM walk w JOIN kept n ON n.id = w.id AND n.k = w.k + 1),
crcs AS (SELECT hash, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(hash, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT hash FROM walk WHERE hash <> opener), crc_table),
windows AS (SELECT id, start_hour, opened, opener, count(*) - 1 AS n_repeats, count(*) FILTER (walk.hash <> opener) AS n_conflicts, coalesce(sum(crc) FILTER (walk.hash <> opener), 0) AS crc FROM walk LEFT JOIN crcs ON walk.hash = crcs.hash GROUP BY ALL),
nexts AS (SELECT *, lead(opened) OVER (PARTITION BY id ORDER BY start_hour) AS next FROM windows),
timed AS (SELECT id, start_hour, min(tops.batch) - 1 AS timer FROM nexts JOIN tops ON tops.batch > opened AND start_hour + {WIDTH} < m - {LATE} GROUP BY id, start_hour)
SELECT id AS click_id, start_hour, CAST(least(coalesce(timer, {BATCHES - 1}), coalesce(next, {BATCHES - 1}), {BATCHES - 1}) AS BIGINT) AS closed_batch, n_repeats, n_conflicts, CAST(crc AS BIGINT) AS conflict_crc, opener AS hash
FROM nexts LEFT JOIN timed USING (id, start_hour)
"""
