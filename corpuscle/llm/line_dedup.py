"""Line dedup by levelled sorted runs of line hashes. DataFrame functions only.

``LineRuns`` keeps runs under one folder: bucketed, sorted Parquet tables of (h, docs, first): a line key's hash, the
documents of the batch that have it, the first of these. A batch is counted and sorted once, and merge-anti-joined with
the runs. What no run has becomes the batch's own run, so each key stands in one run only, that of the batch that met it
first; counts of keys that were met before go to a run of repeats. When a level has ``fanout`` runs, they are merged
into one of the next level, so n batches leave O(fanout * log n) runs and each key is rewritten O(log n) times. All runs
are dealt into the same buckets by h and sorted: anti-joins and merges need neither shuffle nor sort. A list of the runs
is written with each batch, so another session can open the folder and add to it.

Texts are read twice (keys, then result) and shuffled once; counts are made from 8-byte hashes, one for each document
and key, summed before they are shuffled, so a line that a third of all documents have is no hot key. Such lines are
few, for all counts add up to the lines: they are broadcast where their documents are looked up (``C.join_counted``).
Work is linear in a text's lines: the places that go are an array of flags, made before it meets the lines.
Two keys of n are taken for one with a chance of n * n / 2 ** 65.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import common as C

#: Characters that don't count at the ends of a line: \x20 and \x09-\x0D.
BLANK = " \t\n\x0b\x0c\r"
#: Batches that a whole table is dealt into, and runs of a level that are merged into one.
BATCHES, FANOUT = 4, 2


def line_key(line: Column) -> Column:
    return C.ascii_lower(F.btrim(line, F.lit(BLANK)))


def text_lines(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hashes(text: Column) -> Column:
    """For each line the hash of its key; null for an empty key."""
    return F.transform(text_lines(text), lambda line: F.when(line_key(line) != "", F.xxhash64(line_key(line))))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, a bucket of one sorted file counts as sorted, so merge joins don't sort it again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled sorted runs of all batches so far, in ``path`` (a folder of its own where that is None).

    A folder that has runs is opened with all of them; buckets (the shuffle partitions, if none are given) are fixed
    when it is made. ``levels[kind][level]`` names the runs of kind "new" (keys by the batch that met them first; no key
    is in two of them) and "again" (counts of later batches).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = path or C.shared_path(spark, "line-runs")
        self.batches, self.levels, self.schema = 0, {"new": [], "again": []}, None
        self.buckets = buckets or C.shuffle_partitions(spark)
        self.tables: dict[str, str] = {}
        found = [x for x in C.listed(spark, self.path) if x.startswith("batch-")]
        if found:
            state = json.loads(spark.read.text(f"{self.path}/{max(found)}").first()[0])
            self.batches, self.levels, self.buckets, self.schema = (state[k] for k in ("batches", "levels", "buckets", "schema"))

    def _table(self, run: str) -> DataFrame:
        """A run as a table that knows of its buckets."""
        if run not in self.tables:
            self.tables[run] = f"corpuscle_{run.replace('-', '_')}_{uuid.uuid4().hex}"
            how = f"using parquet clustered by (h) sorted by (h) into {self.buckets} buckets location '{self.path}/{run}'"
            self.spark.sql(f"create table {self.tables[run]} ({self.schema}) {how}")
        return self.spark.table(self.tables[run])

    def _write(self, rows: DataFrame, name: str) -> str:
        """Write a run in buckets; rows that come in as many partitions by h aren't shuffled for it."""
        run = f"{name}-{uuid.uuid4().hex[:12]}"
        self.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        self.tables[run] = f"corpuscle_{run.replace('-', '_')}"
        written = rows.write.format("parquet").option("path", f"{self.path}/{run}").bucketBy(self.buckets, "h").sortBy("h")
        with _sorted_scans(self.spark):
            written.saveAsTable(self.tables[run])
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"drop table if exists {self.tables.pop(run, run.replace('-', '_'))}")
        C.deleted(self.spark, f"{self.path}/{run}")

    def runs(self, kind: str = "new") -> list[DataFrame]:
        return [self._table(run) for level in self.levels[kind] for run in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs as one, by merge joins: counts are added, the least first stays."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select("h", F.col("docs").alias("_docs"), F.col("first").alias("_first"))
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
            out = out.join(other.hint("merge"), "h", "full").select("h", docs.alias("docs"), F.least("first", "_first").alias("first"))
        return out

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (with a column h) that are in no run: a merge-anti-join with each of them."""
        for run in self.runs():
            keys = keys.join(run.select("h").hint("merge"), "h", "left_anti")
        return keys

    def _push(self, kind: str, run: str) -> list[str]:
        """Take in a run at the lowest level; merge full levels. Returns the runs that are done with."""
        done, level = [], 0
        while True:
            if level == len(self.levels[kind]):
                self.levels[kind].append([])
            if len(self.levels[kind][level]) + 1 < self.fanout:
                self.levels[kind][level].append(run)
                return done
            full = [*self.levels[kind][level], run]
            run = self._write(self._merged([self._table(r) for r in full]), f"{kind}-{level + 1}")
            done += full
            self.levels[kind][level] = []
            level += 1

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (h, first): one row for each document and distinct key."""
        counted = keys.groupBy("h").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
        if C.shuffle_partitions(self.spark) != self.buckets:
            counted = counted.repartition(self.buckets, "h")
        batch, done = self._write(counted, "batch"), []
        if self.batches:
            new = self._write(self.unseen(self._table(batch)), "new-0")
            again = self._table(batch).join(self._table(new).select("h").hint("merge"), "h", "left_anti")
            done += [batch, *self._push("again", self._write(again, "again-0"))]
        else:
            new = batch
        done += self._push("new", new)
        self.batches += 1
        state = {"batches": self.batches, "levels": self.levels, "buckets": self.buckets, "schema": self.schema}
        one = self.spark.range(1).select(F.lit(json.dumps(state)).alias("value"))
        one.coalesce(1).write.text(f"{self.path}/batch-{self.batches:08d}")
        for run in done:  # only once the list without them is written
            self._drop(run)

    def totals(self) -> DataFrame:
        """(h, docs, first) of all batches, each key once."""
        again = self.runs("again")
        if not again:
            return self.runs()[0]
        again = self._merged(again).select("h", F.col("docs").alias("_docs"), F.col("first").alias("_first"))
        out = None
        for run in self.runs():
            both = run.join(again, "h", "left")
            docs = F.col("docs") + F.coalesce("_docs", F.lit(0))
            some = both.select("h", docs.alias("docs"), F.least("first", "_first").alias("first"))
            out = some if out is None else out.unionByName(some)
        return out

    def close(self, delete: bool = False) -> None:
        """Forget the tables; with delete, the folder goes too."""
        for table in self.tables.values():
            self.spark.sql(f"drop table if exists {table}")
        self.tables = {}
        if delete:
            C.deleted(self.spark, self.path)


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = 10,
    keep_first: bool = False,
    batches: int = BATCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drop, from every document, the lines whose key is in at least min_docs documents.

    A key is the line without blanks at both ends, A-Z lower-cased; empty keys stay. With keep_first, the document with
    the smallest id among those that have a key keeps its lines of that key (all of them); null counts as larger than
    any id, and of equal ids the text of the smallest hash is the first. Ids are of any type that has an order.

    Returns the columns of docs, with text_col replaced, and n_lines (before), n_dropped. Columns of docs with these two
    names are replaced.

    Defined cases: null or empty text is one empty line, and its kept text is empty; equal rows are documents of their
    own (the first one's equals keep the line as well); rows with a null id count as documents too; an empty table gives
    an empty table; other columns are carried.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    # texts of one id (or of none) are told apart by a hash
    rows = rows.withColumn("of", F.xxhash64("text"))
    hashed = rows.select("id", "of", key_hashes(F.col("text")).alias("hs"))
    hashed = C.written(hashed.withColumn("batch", F.pmod(F.xxhash64("id", "of"), F.lit(batches)).cast("int")), "line-hashes", ("batch",))
    this = F.struct(F.col("id").isNull().alias("no_id"), "id", "of") if keep_first else F.col("id")
    runs = LineRuns(spark)
    for batch in range(batches):
        mine = hashed.where(F.col("batch") == batch)
        runs.add(mine.select(this.alias("first"), F.explode(F.array_compact(F.array_distinct("hs"))).alias("h")))
    common = C.written(runs.totals().where(F.col("docs") >= min_docs).select("h", "docs", "first"), "line-common")
    runs.close(delete=True)

    # the places of lines that go, by document
    lines = hashed.select("id", "of", F.posexplode("hs").alias("pos", "h")).where("h is not null")
    count = "docs"
    if common.count() > C.MOST_HEAVY:  # too many to broadcast: a document may have many lines of one key, so lines are counted
        common = C.written(common.join(lines.groupBy("h").agg(F.count("*").alias("lines")), "h"), "line-counts")
        count = "lines"
    gone = C.join_counted(lines, common, "h", count)
    gone = gone.where(this != F.col("first")) if keep_first else gone
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("of").alias("gone_of")).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    gone = gone.select("gone_id", "gone_of", _flags("at").alias("gone"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("of") == F.col("gone_of"))
    cut = rows.join(gone, same, "left").select("text", "row", "gone", text_lines(F.col("text")).alias("lines"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line, i: ~F.coalesce(F.get("gone", i), F.lit(False))))
    cut = cut.withColumn("kept", kept)
    text = F.when(F.col("gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join("kept", "\n"))
    n_lines, n_kept = F.size("lines").cast("long"), F.size("kept").cast("long")
    counts = [n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")]
    return cut.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in names], *counts)


def _flags(places: str) -> Column:
    """Sorted places (from 0) as an array of booleans up to the last of them, in linear time."""
    before = lambda i: F.coalesce(F.get(places, i - 1), F.lit(-1))
    stretch = lambda at, i: F.concat(F.array_repeat(F.lit(False), at - before(i) - 1), F.array(F.lit(True)))
    return F.flatten(F.transform(places, stretch))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_common_lines over the whole of documents: keys in at least 10 documents go everywhere."""
    out = drop_common_lines(C.documents(spark, sf_dir).select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
