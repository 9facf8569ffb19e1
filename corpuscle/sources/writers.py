"""Writers: nested books, sharded lexica with manifests, index rows, exports, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import quality


def nested_books(verses: DataFrame, fields: list[str]) -> DataFrame:
    """lang, book, chapters (array of ch and verses in order) from flat rows (lang, book, ch, v, fields)."""
    chapters = verses.groupBy("lang", "book", "ch").agg(F.array_sort(F.collect_list(F.struct(F.col("v").alias("n"), *fields))).alias("verses"))
    return chapters.groupBy("lang", "book").agg(F.array_sort(F.collect_list(F.struct(F.col("ch").alias("n"), "verses"))).alias("chapters"))


def write_books(books: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per language and book."""
    books.repartition("lang", "book").write.partitionBy("lang", "book").format(fmt).mode("overwrite").save(path)


def write_shards(rows: DataFrame, path: str) -> DataFrame:
    """Rows (lang, shard, ...) by shard; returns the manifest of what was written: number shards as numbers, others as texts, in order."""
    rows.repartition("lang", "shard").write.partitionBy("lang", "shard").mode("overwrite").parquet(path)
    return rows.select("lang", F.col("shard").cast("string").alias("shard")).distinct().orderBy("lang", F.expr("try_cast(shard as bigint)"), "shard")


def write_index(rows: DataFrame, path: str) -> None:
    """Search rows: one folder per language, in order."""
    rows.repartitionByRange(F.col("lang"), F.col("ordinal")).sortWithinPartitions("lang", "ordinal").write.partitionBy("lang").mode("overwrite").parquet(path)


#: What is told of a source.
DESCRIPTOR = "name string, licence string, url string, revision string"


def write_descriptors(sources: DataFrame, path: str) -> None:
    """A JSON object for each source, of the columns of DESCRIPTOR that it has; those without a value are left out."""
    sources.select(*[F.col(c) for c in ("name", "licence", "url", "revision") if c in sources.columns]).write.json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated files, each with the columns' heads; quotes in values are doubled."""
    rows.write.csv(path, sep="\t", header=True, quote='"', escape='"')


#: Rows of an export's block in the mean.
EXPORT_ROWS = 50_000


def vocabulary_export(states: DataFrame, lookups: DataFrame, exported_at: str, n_blocks: int | None = None) -> DataFrame:
    """One JSON document per block of keys, so no task gathers all: {exportedAt, lexemes, lookups}. There are as many blocks
    as the rows need, if no number is given."""
    n_blocks = n_blocks or 1 + (states.count() + lookups.count()) // EXPORT_ROWS
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block")
    lexemes = states.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(*states.columns))).alias("lexemes"))
    events = lookups.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(*lookups.columns))).alias("lookups"))
    both = lexemes.join(events, "block", "full")
    return both.select("block", F.to_json(F.struct(F.lit(exported_at).alias("exportedAt"), "lexemes", "lookups")).alias("json"))


def canon(verses: DataFrame, books: DataFrame) -> DataFrame:
    """books (id, lang, en, section, idx) with verses, the greatest verse of each chapter."""
    per_chapter = verses.groupBy("book", "ch").agg(F.max("v").alias("n"))
    listed = per_chapter.groupBy(F.col("book").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "n"))), lambda x: x["n"]).alias("verses"))
    return books.join(listed, "id")


def checksum_manifest(files: DataFrame) -> DataFrame:
    """path, sha256, in order of paths."""
    return quality.content_hashes(files).orderBy("path")


def write_diagnostics(tables: dict[str, DataFrame], path: str) -> None:
    """Side tables of a run (statistics, rejected clusters, conflicts), each in a folder of its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
