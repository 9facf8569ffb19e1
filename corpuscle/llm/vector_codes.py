"""Vector code compression: product codes of integer vectors, nearest entries found by segment-mean lower bounds.

Each of ``parts`` equal parts of a vector has a codebook. A part's nearest entry is found coarse to fine: with both cut
into 1, 2, 4 .. blocks, the block means' squared differences (times the blocks' lengths) plus the squared difference of
the residuals' norms never exceed the squared distance, for residuals are orthogonal to what is constant by block. The
entry of the least coarse bound is measured exactly; entries whose bound lies above that are out, level by level; what
survives is measured exactly in integers, and ties go to the lower index. Bounds are rounded down, so no nearest entry
is lost (``nearest`` is tested against all distances).

Codebooks are learned by rounds of one Spark job each: tasks assign their parts and add them up by entry, Spark sums
parts * entries * width rows of each task, and the driver sees that many numbers, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C
from corpuscle.llm import vectors as V

#: A bound counts as this much less, and residual norms may differ by this share of the norms: more than rounding does.
SURE, NORM_SLACK = 1 - 2.0**-30, 2.0**-18
#: Rows of a matrix that are looked at together.
TILE = 8192


def segments(width: int) -> list[np.ndarray]:
    """For each level the first places of its blocks: 1, 2, 4 .. blocks, up to half as many as places."""
    out, blocks = [], 1
    while blocks == 1 or 2 * blocks <= width:
        out.append(np.unique(np.arange(blocks) * width // blocks))
        blocks *= 2
    return out


class Means:
    """Block sums (exact), block lengths and residual norms of the rows of an integer matrix, at each level."""

    def __init__(self, x: np.ndarray):
        width = x.shape[1]
        squares = (x.astype(np.float64) ** 2).sum(1)
        self.norms = np.sqrt(squares)
        self.levels = []
        for firsts in segments(width):
            lengths = np.diff(np.append(firsts, width)).astype(np.float64)
            sums = np.add.reduceat(x, firsts, axis=1)
            rest = np.sqrt(np.maximum(0, squares - (sums.astype(np.float64) ** 2 / lengths).sum(1)))
            self.levels.append((lengths, sums, rest))


def lower_bounds(a: Means, b: Means, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At most the squared distance of row i of a and row j of b, by pairs."""
    lengths, sums_a, rest_a = a.levels[level]
    _, sums_b, rest_b = b.levels[level]
    means = ((sums_a[i] - sums_b[j]).astype(np.float64) ** 2 / lengths).sum(-1)
    rest = np.maximum(0, np.abs(rest_a[i] - rest_b[j]) - NORM_SLACK * (a.norms[i] + b.norms[j]))
    return (means + rest**2) * SURE


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of its nearest entry (the lowest of ties) and the squared distance, both exact."""
    a, b, n, k = Means(x), Means(entries), len(x), len(entries)
    every, all_k = np.arange(n), np.arange(k)
    coarse = lower_bounds(a, b, 0, every[:, None], all_k[None, :])
    first = coarse.argmin(1)
    best = ((x - entries[first]) ** 2).sum(1)
    i, j = np.nonzero(coarse <= best[:, None])
    for level in range(1, len(a.levels)):
        near = lower_bounds(a, b, level, i, j) <= best[i]
        i, j = i[near], j[near]
    exact = ((x[i] - entries[j]) ** 2).sum(1)
    starts = np.searchsorted(i, every)  # pairs lie by row, then entry, and each row has one at least
    least = np.minimum.reduceat(exact, starts) if n else exact
    hit = np.flatnonzero(exact == least[i])
    return j[hit[np.searchsorted(i[hit], every)]], least


def _tiles(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            some = batch.slice(at, TILE)
            yield some, V.matrix(some.column(some.schema.get_field_index("x")), width).reshape(some.num_rows, parts, width // parts)


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floors of the means of the parts nearest to them; unused ones stay."""
    parts, k, w = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
        for _, x in _tiles(batches, parts * w, parts):
            for p in range(parts):
                at, _ = nearest(x[:, p], books[p])
                n[p] += np.bincount(at, minlength=k)
                np.add.at(total[p], at, x[:, p])
        p, e = np.nonzero(n)
        columns = [np.repeat(p, w), np.repeat(e, w), np.tile(np.arange(w), len(p)), np.repeat(n[p, e], w), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "n", "total"])

    sums = rows.select("x").mapInArrow(add_up, "part long, entry long, place long, n long, total long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all kept vectors, and the codebooks (parts, entries, width) that they refer to.

    A component x counts as floor(scale * x). Codebooks start as the parts of the ``entries`` smallest ids. Returns per
    kept row id_col, label_col, code (array<int>, an index for each part), error (squared distances, summed over parts)
    and label_error (error summed over equal labels, nulls together).

    Defined cases: rows whose vector is null or has null or non-finite components go. Vectors whose length isn't the
    longest one's, rounded up to a multiple of parts, are filled up with zeros. Equal ids start codebooks in the order of
    their vectors, null ids last; of fewer rows than entries, codebooks have as many entries as rows. Repeated rows count
    as often as they occur. An empty table gives an empty table and empty codebooks. Other columns aren't read. Integers
    so large that an error might not fit a long raise a ValueError before any work.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    spark, id_type, label_type = df.sparkSession, df.schema[id_col].dataType, df.schema[label_col].dataType
    table = V.integers(df, vector_col, scale, {"id": F.col(id_col), "label": F.col(label_col)}, "vector-integers")
    width = max(1, -(-table.width // parts)) * parts
    V.must_fit(table.largest, isqrt((1 << 62) // width) // 2, "an error")
    first = table.rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.zeros((len(first), width), np.int64)
    for k, (x,) in enumerate(first):
        books[k, : len(x)] = x
    books = np.ascontiguousarray(books.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = next_books(table.rows, books)

    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), *T._parse_datatype_string("code array<int>, error long").fields])
    kinds = [to_arrow_type(id_type), to_arrow_type(label_type)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _tiles(batches, width, parts):
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            codes = pa.array(list(np.stack([f[0] for f in found], 1).astype(np.int32)), pa.list_(pa.int32()))
            error = pa.array(sum(f[1] for f in found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), batch.column(1).cast(kinds[1]), codes, error], names=schema.names)

    # a label as a key that isn't null; few labels or many, and one of them may have a third of all rows
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_key")
    coded = C.written(table.rows.select("id", "label", "x").mapInArrow(encode, schema).select("*", key), "vector-codes")
    sums = C.written(coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")), "vector-labels")
    out = C.join_counted(coded, sums, "_key", "_rows")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compressed over the whole of embeddings: 8 parts, 16 entries, 6 rounds, components times 4096."""
    out, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
