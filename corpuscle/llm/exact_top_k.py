"""Exact top-k search: tiles of integer inner products, partial selection in each, lists merged by a tree.

The candidates are written once as integers, with a number for each row. Queries, a stated part of the rows, are dealt
into blocks of bounded bytes; for each block one job runs over all candidates where they lie: a task multiplies tiles of
queries and of its shard, selects the best k of each query in a tile by a partition (not a sort), and keeps one list for
each query. Lists of 16 tasks are merged, then those of 16 such branches, and so on; Spark's window limit lets each task
send k rows of a query at most. Nothing else moves: candidates aren't shuffled, and a block's bytes don't grow with the
table. The work is queries times rows, as a search of all against a stated set has to be.

Products are exact: in doubles while every sum stays below 2 ** 53, else in longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm import common as C
from corpuscle.llm import vectors as V

#: Bytes of a block of queries, queries and candidates of a tile, lists that are merged into one.
BLOCK_BYTES, TILE_QUERIES, TILE_ROWS, FAN = 16 << 20, 256, 4096, 16
EXACT = 1 << 53


class Best:
    """The best k candidates of each of n queries so far: score, whether the id is null, id; unused places have no score."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id, self.no_id, self.used = np.zeros((n, k), np.int64), np.zeros((n, k), bool), np.zeros((n, k), bool)

    def take(self, at: slice, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, used: np.ndarray) -> None:
        """Merge lists of the queries in at: greater scores first, then smaller ids, null last."""
        old = (self.score[at], self.id[at], self.no_id[at], self.used[at])
        both = [np.concatenate(pair, 1) for pair in zip(old, (score, ids, no_id, used), strict=True)]
        order = np.lexsort((both[1], both[2], -both[0], ~both[3]), axis=-1)[:, : self.k]
        self.score[at], self.id[at], self.no_id[at], self.used[at] = (np.take_along_axis(x, order, 1) for x in both)


def tile_best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores the columns of its k greatest, lower columns first among equals, and whether they count.

    own: the column that a row may not have, or -1. The order of columns breaks ties, so it is made part of the value.
    """
    n, m = scores.shape
    low, high = int(scores.min()), int(scores.max())
    mine = np.flatnonzero(own >= 0)
    if (high - low + 2) * m < 1 << 62:
        value = (scores.astype(np.int64) - low + 1) * m + (m - 1 - np.arange(m))
        value[mine, own[mine]] = -1
        if m > k:
            columns = np.argpartition(value, m - k, axis=1)[:, m - k :]
        else:
            columns = np.broadcast_to(np.arange(m), (n, m)).copy()
        return columns, np.take_along_axis(value, columns, 1) >= 0
    barred = np.zeros((n, m), bool)  # values too far apart for that: by a sort
    barred[mine, own[mine]] = True
    columns = np.lexsort((np.broadcast_to(np.arange(m), (n, m)), -scores.astype(np.int64), barred), axis=-1)[:, :k]
    return columns, ~np.take_along_axis(barred, columns, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices whose sums fit longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a @ b.T


def _ranked(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k of each group. The rank stands in the condition, so Spark limits groups before it shuffles them."""
    order = [F.desc("score"), F.asc_nulls_last("vec")]
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def merged(lists: DataFrame, k: int, tasks: int) -> DataFrame:
    """Lists (q, query_id, task, vec, score) of up to ``tasks`` tasks as one list of each query, by a tree."""
    while tasks > FAN:
        lists = _ranked(lists.withColumn("task", F.floor(F.col("task") / FAN).cast("int")), ["q", "task"], k).drop("rank")
        tasks = -(-tasks // FAN)
    return _ranked(lists, ["q"], k)


def top_k(
    df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each row where is_query holds, the k rows of df with the greatest integer inner products, but for itself.

    A component x counts as floor(scale * x). Returns query_id, rank (int, from 1), id_col, score; ties go to smaller
    ids, and a query with fewer than k other rows has as many ranks.

    Defined cases: rows whose vector is null or has null or non-finite components take no part; shorter vectors are
    filled up with zeros. Ids are integers; a null id is a candidate that comes last among ties, and a query if is_query
    says so. Equal rows are rows of their own: each is a query, and a candidate of the others. An empty table gives an
    empty table; other columns aren't read (is_query may read any). Integers so large that a score might not fit a long
    raise a ValueError before any search.
    """
    spark = df.sparkSession
    others = {"id": F.col(id_col).cast("long"), "asks": F.coalesce(is_query, F.lit(False)), "row": F.monotonically_increasing_id()}
    table = V.integers(df, vector_col, scale, others, "search-integers")
    width = max(1, table.width)
    if table.largest * table.largest * width >= 1 << 63:
        raise ValueError(f"a component is {table.largest} as an integer: a score might not fit a long")
    asking = table.rows.where("asks")
    n_queries, tasks = asking.count(), max(1, table.rows.rdd.getNumPartitions())
    blocks = max(1, -(-2 * n_queries * (width + 2) * 8 // block_bytes))  # dealt by a hash, so half full in the mean
    path = C.shared_path(spark, "search-lists")
    for block in range(blocks):
        mine = asking.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("id", "row", "x").toArrow().combine_chunks()
        _against(spark, table, mine, k, width, path)
    lists = spark.read.schema("q long, query_id long, task int, vec long, score long").parquet(path)
    out = merged(lists, k, tasks)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")


def _against(spark: SparkSession, table: V.Integers, queries: pa.Table, k: int, width: int, path: str) -> None:
    """One block of queries against all candidates: appends (q, query_id, task, vec, score), k rows of each query and task at most."""
    rows = queries.column("row").to_numpy() if queries.num_rows else np.zeros(0, np.int64)
    ids = queries.column("id").combine_chunks() if queries.num_rows else pa.array([], pa.int64())
    x = V.matrix(queries.column("x").combine_chunks(), width) if queries.num_rows else np.zeros((0, width), np.int64)
    sent = spark.sparkContext.broadcast((rows, ids, x))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, ids, x = sent.value
        best = Best(len(rows), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_ROWS):
                _shard(batch.slice(lo, TILE_ROWS), rows, x, best, width)
        q, place = np.nonzero(best.used)
        vec = pa.array(best.id[q, place], pa.int64(), mask=best.no_id[q, place])
        task = pa.array(np.full(len(q), TaskContext.get().partitionId()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(rows[q], pa.int64()), ids.take(pa.array(q, pa.int64())), task, vec, pa.array(best.score[q, place], pa.int64())], names=["q", "query_id", "task", "vec", "score"])

    found = table.rows.select("id", "row", "x").mapInArrow(search, "q long, query_id long, task int, vec long, score long")
    found.write.mode("append").parquet(path)
    sent.destroy()


def _shard(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray, best: Best, width: int) -> None:
    """One tile of candidates against all queries of the block."""
    no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, no_id))  # columns by id, so lower columns win ties
    ids, no_id, row = ids[order], no_id[order], batch.column(1).to_numpy()[order]
    shard = V.matrix(batch.column(2), width)[order]
    by_row = np.argsort(row)
    for lo in range(0, len(rows), TILE_QUERIES):
        at = slice(lo, lo + TILE_QUERIES)
        found = np.minimum(np.searchsorted(row[by_row], rows[at]), len(row) - 1)
        own = np.where(row[by_row][found] == rows[at], by_row[found], -1)
        scores = products(x[at], shard)
        columns, counts = tile_best(scores, own, best.k)
        best.take(at, np.take_along_axis(scores, columns, 1).astype(np.int64), ids[columns], no_id[columns], counts)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k over the whole of embeddings: queries are the rows whose id is divisible by 100; 10 each, components times 1024."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
