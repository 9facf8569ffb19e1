"""A training corpus from documents: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
applies them in order; between two stages the rows are written as Parquet to the shared folder and read again, so a
lost executor costs at most its part of one stage.

What each stage decides:

* language_id: learns from the rows that aren't held out; rows that are rejected (no letter, or far from everything
  learned) go.
* line_dedup: a line whose key is in 10 documents or more stays in the first of them only; a document that had text and
  has no line left goes, for all its lines stand elsewhere. n_chars is the kept text's.
* near_duplicates: 5-word shingles, similarity 0.8; of each component one row stays: that of the smallest id, a null id
  being the last.
* decontaminate: documents with a window that is as similar as 0.8 to a benchmark item go.

A document is a row: ids may be null or repeat, so these three tell documents apart by id and text. Rows equal in both
have one fate in all but near_duplicates, which keeps one of them.

* pack: the pieces of the packed sequences, as op7 returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import common as C
from corpuscle.llm.decontaminate import contaminated
from corpuscle.llm.jaccard_join import jaccard_components
from corpuscle.llm.language_id import fit, held_out, identify
from corpuscle.llm.line_dedup import drop_common_lines
from corpuscle.llm.pattern_packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return identify(docs, model, keep=tuple(COLUMNS[:1] + COLUMNS[2:]), keep_text=True).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(docs.select(*COLUMNS), min_docs=10, keep_first=True)
    emptied = (F.col("n_dropped") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~emptied).withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(docs, k=5, percent=80, by_row=True).where("size > 1")
    marked = found.groupBy(F.col("doc_id").alias("_mid"), F.col("of").alias("_mof")).agg(F.first("kept").alias("_kept"), F.count("*").alias("_n"))
    marked = C.written(marked.where("not _kept or _n > 1"), "pipeline-marked")
    out = unlike(docs, marked)
    # rows equal in id and text to the one that stays: one of them, by the other columns
    twice = marked.where("_kept")
    if twice.isEmpty():
        return out
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = docs.join(twice, is_marked(), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
    return out.unionByName(one.select("doc_id", "text", "_rest.*"))


def is_marked() -> Column:
    """Whether id and text are those of a row of (_mid, _mof)."""
    return F.col("doc_id").eqNullSafe(F.col("_mid")) & (F.xxhash64("text") == F.col("_mof"))


def unlike(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs without the rows whose id and text are marked."""
    return docs.join(marked, is_marked(), "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True)
    return unlike(docs, found.select(F.col("doc_id").alias("_mid"), F.col("of").alias("_mof")).distinct())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", packing),
]

#: The first and the last stage can't be said in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
