"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every distinct text is a blob, named by its SHA-256. A ledger is a folder with two tables: `blobs`, one row
for each (blob, rule, version) scanned so far with the spans found, partitioned by rule and version, and
`paths`, one row for each historical version (path, blob) of a path. A scan takes only the (blob, rule,
version) rows the ledger lacks: new texts under all rules and old texts under new rule versions. What it
finds is appended, and findings are joined back to every row that holds the blob, or to every path that
ever did. A scan without a named ledger begins an empty one in the shared folder.

A regex match is located with split() and regexp_extract_all(): the pieces between matches and the matches
alternate, so running lengths give each start. Running sums go by blocks, so their cost is in proportion
to the matches. Spans count code points, end exclusive.

Nulls: a null text is the empty blob; null ids are kept, as paths too. Repeated rows each get the blob's
findings and are one path. Spans of one start are ordered by kind. Texts may be of any length. Other columns
are kept, but `found` and `blob_id_` are the operator's own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import exists, hot_limit, look_up, read, shared_dir


@dataclass(frozen=True)
class Rule:
    """A match of `pattern` counts if its `group` has `least` characters. `place` orders spans of one start."""

    kind: str
    version: int
    place: int
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: From the header through the END line, unless another header comes first; else through the base64 run after the header.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?>[\s\S]*?(?=-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----))-----END [A-Z ]*PRIVATE KEY-----|\s*+[A-Za-z0-9+/=\r\n]{16,}+)?"
RULES = (
    Rule("assign", 1, 0, ASSIGN, 2, 8),
    Rule("access", 1, 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, 2, r"[0-9a-f]{32,}", 0, 32),  # a greedy run of 32 or more is a maximal run
    Rule("pem", 3, 3, PEM, 0, 1),
)
FINDING = "struct<start:int,place:int,kind:string,end:int>"
BLOBS = f"blob string, spans array<{FINDING}>, rule string, version int"
PATHS = "path string, blob string"
RUN = 512


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals (all >= 0) of an array<int> under an associative join, in blocks of RUN."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    append = lambda out, x: F.array_append(out, join(last(out), x))
    none = F.array().cast("array<int>")
    starts = F.filter(F.sequence(F.lit(0), F.size(values), F.lit(RUN)), lambda at: at < F.size(values))
    within = F.transform(starts, lambda at: F.aggregate(F.slice(values, at + 1, F.lit(RUN)), none, append))
    before = lambda blocks: F.aggregate(blocks, F.array(F.lit(0)), lambda out, block: append(out, last(block)))
    add = lambda w: F.flatten(F.transform(w["blocks"], lambda block, i: F.transform(block, lambda x: join(F.element_at(w["before"], i + 1), x))))
    return once(once(within, lambda blocks: F.struct(blocks.alias("blocks"), before(blocks).alias("before"))), add)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<FINDING> of the rule's leftmost non-overlapping matches that are long enough."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    gaps = lengths(F.split(text, rule.pattern, -1))
    whole = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    part = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else whole
    matches = F.struct(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))

    def located(m: Column) -> Column:
        ends = running(F.zip_with(F.slice(m["gap"], F.lit(1), F.size(m["whole"])), m["whole"], lambda g, w: g + w), lambda a, b: a + b)
        items = F.filter(F.arrays_zip(ends.alias("end"), m["whole"].alias("whole"), m["part"].alias("part")), lambda x: x["part"] >= rule.least)
        return F.transform(items, lambda x: F.struct((x["end"] - x["whole"]).alias("start"), F.lit(rule.place).alias("place"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(rule.pattern), once(matches, located)).otherwise(F.array().cast(f"array<{FINDING}>"))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """The tables of a ledger's folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def blobs(self) -> DataFrame:
        return self._table("blobs", BLOBS)

    def paths(self) -> DataFrame:
        return self._table("paths", PATHS)

    def add_blobs(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("rule", "version").parquet(f"{self.folder}/blobs")

    def add_paths(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/paths")


def scan_unseen(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, spans, rule, version) for the pairs that `ledger` lacks. Each blob is read once."""
    own = documents.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    todo = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    blobs = own.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("done"))
        blobs = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("done", F.array().cast("array<string>"))))
        blobs = blobs.filter(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", todo)
    scans = [
        F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), F.struct(spans_of(F.col("text"), r).alias("spans"), F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")))
        for r in rules
    ]
    return blobs.select("blob", F.explode(F.filter(F.array(*scans), lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): all spans of the current rule versions, by start, then place; blobs without any are left out."""
    current = reduce(lambda a, b: a | b, [(F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules])
    hits = blobs.filter(current & (F.size("spans") > 0)).dropDuplicates(["blob", "rule", "version"])
    return hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))


def path_findings(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found) of every path whose text holds or ever held a secret."""
    return ledger.paths().distinct().join(findings(ledger.blobs(), rules), "blob").select("path", "blob", "found")


def scan(documents: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, Ledger]:
    """(documents with a column `found` of all spans, the ledger, to which this scan's rows were added)."""
    spark = documents.sparkSession
    ledger = Ledger(spark, folder or f"{shared_dir(spark)}/secret-ledger-{uuid4().hex}")
    known = ledger.blobs() if exists(spark, f"{ledger.folder}/blobs") else None
    ledger.add_blobs(scan_unseen(documents, known, rules))
    own = documents.select(F.col("doc_id").cast("string").alias("path"), blob_of(F.col("text")).alias("blob"))
    seen = ledger.paths()
    ledger.add_paths(own.distinct().join(seen, own["path"].eqNullSafe(seen["path"]) & (own["blob"] == seen["blob"]), "left_anti"))
    found = findings(ledger.blobs(), rules).withColumnRenamed("blob", "blob_id_")
    out = documents.drop("found", "blob_id_").withColumn("blob_id_", blob_of(F.col("text")))
    rows = documents.count()
    counts = out.groupBy("blob_id_").agg(F.count("*").alias("n_")).join(found, "blob_id_", "left")
    out = look_up(out, counts.filter(F.col("found").isNotNull() | (F.col("n_") > hot_limit(rows))), "blob_id_", rows)
    return out.drop("blob_id_").withColumn("found", F.coalesce("found", F.array().cast(f"array<{FINDING}>"))), ledger


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans (ordered by start) replaced by `mark`.

    Pieces are cut from a fixed-width encoding, where a place is found at once; each is decoded behind a
    letter, lest a byte order mark be taken for one.
    """
    reach = lambda spans: running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

    def cut(s: Column) -> Column:
        piece = lambda at, n: F.substring(F.decode(F.concat(F.encode(F.lit("A"), "UTF-32"), F.substring(s["wide"], 4 * at + 1, 4 * n)), "UTF-32"), F.lit(2), n)
        first = F.transform(s["found"], lambda x, i: F.struct(F.when(i > 0, F.element_at(s["ends"], i)).otherwise(0).alias("at"), x["start"].alias("start"), i.alias("i")))
        before = F.transform(F.filter(first, lambda x: (x["start"] >= x["at"])), lambda x: piece(x["at"], x["start"] - x["at"]))
        end = F.element_at(s["ends"], -1)
        return F.concat(F.array_join(F.concat(before, F.array(F.lit(""))), mark), piece(end, s["size"] - end))

    whole = once(F.struct(F.encode(text, "UTF-32").alias("wide"), F.length(text).alias("size"), found.alias("found"), reach(found).alias("ends")), cut)
    return F.when(F.size(found) > 0, whole).otherwise(text)


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is that of the setting `corpusmill.secrets.ledger`; a new one where it is unset."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = scan(documents, spark.conf.get("corpusmill.secrets.ledger", None))
    base = F.filter("found", lambda x: x["place"] <= 2)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))
