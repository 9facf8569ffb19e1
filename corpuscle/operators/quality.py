"""Quality gates as tables of violations, and fingerprints of contents."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def violations(gates: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """gate, n: how many rows of each table break its rule, zeros too. One pass over each table."""
    by_table: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, broken) in gates.items():
        by_table.setdefault(id(df), (df, []))[1].append((name, broken))
    out = []
    for df, rules in by_table.values():
        counted = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules])
        out.append(counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("n")) for n, _ in rules])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, out)


def must_hold(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """df; reading a row that breaks the rule fails."""
    return df.where(F.assert_true(rule, message).isNull())


class GateError(ValueError):
    """A written table broke gates; counts says how often each."""

    def __init__(self, broken: dict[str, int]):
        super().__init__("broken: " + ", ".join(f"{name} by {n} rows" for name, n in sorted(broken.items())))
        self.counts = broken


def write_checked(df: DataFrame, path: str, must: dict[str, Column], told: dict[str, Column] | None = None, least_rows: int = 0) -> dict[str, int]:
    """Write df as Parquet to path if no row breaks a gate of must; returns how many rows there are ("rows"), and how many
    break each gate of must and of told.

    The gates are counted while the rows are written, in the same pass. They are written beside path and moved there
    only once all gates hold, so a reader of path sees a whole table that passed, or none: a gate that breaks leaves
    nothing. least_rows is a gate on the number of rows. path must not exist yet.
    """
    told = told or {}
    spark, observed = df.sparkSession, Observation(f"gates-{uuid.uuid4().hex}")
    target, pending = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path.rstrip('/')}-pending-{uuid.uuid4().hex}"))
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(target):
        raise FileExistsError(path)
    counted = [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in (must | told).items()]
    try:
        df.observe(observed, F.count(F.lit(1)).alias("rows"), *counted).write.parquet(pending.toString())
        counts = observed.get
        broken = {name: counts[name] for name in must if counts[name]}
        if counts["rows"] < least_rows:
            broken["rows"] = least_rows - counts["rows"]
        if broken:
            raise GateError(broken)
        if not files.rename(pending, target):
            raise FileExistsError(path)
        return counts
    finally:
        files.delete(pending, True)


def low_coverage(chapters: DataFrame, floor: float = 0.6, least_words: int = 20) -> Column:
    """Whether a chapter (words, own, joint) aligns nothing, or too little of 20 words or more."""
    covered = F.col("own") + F.col("joint")
    return (F.col("words") > 0) & (covered == 0) | (F.col("words") >= least_words) & (covered < floor * F.col("words"))


def content_hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(path, F.sha2(content, 256).alias("sha256"))


def fingerprint(files: DataFrame, path: str = "path", content: str = "content", digits: int = 2) -> DataFrame:
    """One digest of a tree: of each file's digest of path and content, both framed by their lengths, in order of paths.

    Contents are digested where they lie; only digests meet. They do so in blocks, by the first hexadecimal digits of
    the path's digest, and then the blocks' digests in order: no row holds more than a 16 ** digits-th of the files. It's
    a different value from one digest of all bytes, and from that with another number of digits.
    """
    text = lambda c: F.col(c).cast("binary")
    framed = F.sha2(F.concat(F.octet_length(text(path)).cast("string").cast("binary"), F.lit(":").cast("binary"), text(path), F.octet_length(text(content)).cast("string").cast("binary"), F.lit(":").cast("binary"), text(content)), 256)
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""), 256)
    one = files.select(F.substring(F.sha2(text(path), 256), 1, digits).alias("_b"), F.col(path).alias("_p"), framed.alias("_d"))
    blocks = one.groupBy("_b").agg(joined("_p", "_d").alias("_d"), F.count("*").alias("_n"))
    return blocks.agg(joined("_b", "_d").alias("fingerprint"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_files"))


def expired(buckets: DataFrame, name: str, prefix: str, current: str, legacy: list[str]) -> DataFrame:
    """The cache buckets to delete: those of the prefix but the current one, and the legacy ones."""
    return buckets.where(F.col(name).startswith(prefix) & (F.col(name) != current) | F.col(name).isin(legacy))
