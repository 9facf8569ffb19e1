"""Embedding whitening by TSQR: no covariance is formed.

1. Spark adds up each dimension of the integer vectors, exactly; with S and n, rows are centred as (n * x - S) / n.
2. Each task reduces its centred rows to one R factor (QR of the factor so far, stacked on the next rows); the factors
   are written, and merged by a tree: 16 of them are stacked and reduced to one, until one is left.
3. The driver takes the SVD of the last R (dimensions squared, however many rows there are): its right vectors are the
   covariance's eigenvectors, and squares of its singular values over n the eigenvalues. Squaring the data first would
   lose half the digits; this doesn't.
4. A pass over the rows projects them; sums of products of the whitened columns, over all rows, tell how far their
   covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C
from corpuscle.llm import vectors as V

#: Factors that are merged into one, and rows that are reduced together.
FAN, TILE = 16, 4096


@dataclass
class Whitening:
    """What fit() learns: n rows, their sums by dimension (Python integers), components (rows), eigenvalues, their sum."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs, or Python integers where longs don't hold them."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows projected on the components, over the roots of their eigenvalues; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)
        out[:, self.eigenvalues == 0] = np.nan
        return out


def _sums(table: V.Integers) -> list[int]:
    """The sum of each dimension over all rows; short vectors count as filled up with zeros."""
    width, largest = table.width, max(1, table.largest)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = V.matrix(batch.column(0), width)
            step = max(1, min(len(x), (1 << 62) // largest))
            for lo in range(0, len(x), step):  # a step's sums fit a long
                total = [a + int(b) for a, b in zip(total, x[lo : lo + step].sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["place", "total"])

    out = [0] * width
    for r in table.rows.select("x").mapInArrow(add_up, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("s")).collect():
        out[r.place] = int(r.s)
    return out


def _factor(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


def _as_batch(node: int, r: np.ndarray) -> pa.Table:
    return pa.table({"node": pa.array([node], pa.int64()), "r": pa.array([np.ascontiguousarray(r, np.float64).tobytes()], pa.binary())})


def last_factor(table: V.Integers, centre: Whitening, fan: int = FAN) -> np.ndarray:
    """The R factor of all centred rows: one of each task, then a tree."""
    width, spark = table.width, table.rows.sparkSession

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                r = _factor([r, centre.centred(V.matrix(batch.column(0).slice(lo, TILE), width))])
        if len(r):
            yield from _as_batch(TaskContext.get().partitionId(), r).to_batches()

    def merge(key: tuple[pa.Scalar, ...], some: pa.Table) -> pa.Table:
        order = np.argsort(some.column("node").to_numpy())
        blocks = some.column("r").to_pylist()
        return _as_batch(key[0].as_py(), _factor([np.frombuffer(blocks[i], np.float64).reshape(-1, width) for i in order]))

    factors = C.written(table.rows.select("x").mapInArrow(reduce_rows, "node long, r binary"), "whitening-factors")
    nodes = factors.agg(F.max("node")).first()[0] + 1
    while nodes > 1:
        up = F.floor(F.col("node") / fan).cast("long").alias("up")
        factors = factors.groupBy(up).applyInArrow(merge, "node long, r binary")
        nodes = -(-nodes // fan)
    return np.frombuffer(factors.first()["r"], np.float64).reshape(-1, width)


def fit(table: V.Integers, most: int = 8) -> Whitening:
    """The components of the greatest eigenvalues, at most ``most``; eigenvalues that are rounding errors are 0."""
    nothing = Whitening(table.n, [], np.zeros((0, table.width)), np.zeros(0), 0.0)
    if not table.n or not table.width:
        return nothing
    centre = replace(nothing, sums=_sums(table))
    _, s, right = np.linalg.svd(last_factor(table, centre), full_matrices=True)
    s = np.append(s, np.zeros(table.width - len(s)))
    s[s <= s.max(initial=0) * table.width * np.finfo(float).eps] = 0
    e = s * s / table.n
    return Whitening(table.n, centre.sums, right[:most], e[:most], float(e.sum()))


def identity_error(table: V.Integers, model: Whitening) -> float:
    """The largest entry, by size, of the covariance of all whitened rows minus the identity; components without variance are left out."""
    live, width = np.flatnonzero(model.eigenvalues > 0), table.width
    m = len(live)
    if not m:
        return 0.0

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                w = model.whitened(V.matrix(batch.column(0).slice(lo, TILE), width))[:, live]
                total += w.sum(0)
                products += w.T @ w
        values = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["place", "v"])

    sums = table.rows.select("x").mapInArrow(add_up, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(m + m * m)
    for r in sums:
        v[r.place] = r.v
    mean = v[:m] / model.n  # zero but for rounding: rows were centred before they were multiplied
    return float(np.abs(v[m:].reshape(m, m) / model.n - np.outer(mean, mean) - np.eye(m)).max())


def whitened(df: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of all kept vectors on their first ``most`` principal components.

    A component c counts as floor(scale * c) + shift. Returns per row and component id_col, component (int, from 1, by
    falling eigenvalue), n, deviation (decimal: sum over dimensions of (n * x - S) ** 2, exact), whitened, explained (the
    eigenvalue's share of all variance) and identity_error (one value).

    Defined cases: rows whose vector is null or has null or non-finite components go; shorter vectors are filled up with
    zero integers. A component without variance (as where there are fewer different rows than components) has a null
    whitened and explained 0. Null and repeated ids are carried, repeated rows count as often as they occur. Vectors of
    fewer dimensions than ``most`` have as many components. An empty table, or one of empty vectors, gives an empty table.
    Other columns aren't read. Integers beyond 2 ** 62 or so raise a ValueError.
    """
    id_type = df.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    table = V.integers(df, vector_col, scale, {"id": F.col(id_col)}, "whitening-integers", shift)
    V.must_fit(table.largest, 1 << 62, "a component")
    model = fit(table, most)
    error, width, k = identity_error(table, model) if table.n else 0.0, table.width, len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if model.trace else np.zeros(k)
    schema = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double").fields])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if k else 0, TILE):
                some = batch.slice(lo, TILE)
                x = V.matrix(some.column(1), width)
                w, d = model.whitened(x), model.deviations(x)
                if d.dtype != object and isqrt((1 << 62) // width) <= int(np.abs(d).max(initial=0)):
                    d = d.astype(object)
                rows = pa.array(np.repeat(np.arange(len(x)), k))
                sums = (d * d).sum(1)
                deviation = pa.array([Decimal(v) for v in sums.tolist()], pa.decimal128(38, 0))
                columns = [some.column(0).cast(kind).take(rows), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), model.n), pa.int64()), deviation.take(rows)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(explained, len(x)))], names=schema.names)

    return table.rows.select("id", "x").mapInArrow(project, schema).withColumn("identity_error", F.lit(error))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitened over the whole of embeddings: 8 components, entries times 1024 plus 100,000."""
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
