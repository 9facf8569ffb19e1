"""What the operators on vectors share: kept rows as written integers, and batches of them as matrices.

A row is kept if its vector is there and has finite components only. Vectors shorter than the longest one are filled up
with zero integers, so tables of mixed lengths have a defined result; an empty vector is all zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common as C


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite; null for a null vector."""
    return F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift of each component, as longs."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))


@dataclass
class Integers:
    """A written table with a column x (array<long>), and what a reader must know of it."""

    rows: DataFrame
    n: int
    width: int  # of the longest vector
    largest: int  # size of the largest component


def integers(df: DataFrame, vector: str, scale: int, others: dict[str, Column], name: str, shift: int = 0) -> Integers:
    """The kept rows of df: the columns others and x, written to the shared folder once."""
    kept = df.where(finite(F.col(vector))).select(*[c.alias(k) for k, c in others.items()], scaled(F.col(vector), scale, shift).alias("x"))
    rows = C.written(kept, name)
    low, high = F.min(F.array_min("x")), F.max(F.array_max("x"))
    n, width, low, high = rows.agg(F.count("*"), F.max(F.size("x")), low, high).first()
    return Integers(rows, n, width or 0, max(-(low or 0), high or 0, 0))


def must_fit(largest: int, most: int, what: str) -> None:
    if largest > most:
        raise ValueError(f"a component is {largest} as an integer; {what} fits a long up to {most}")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of width numbers; shorter lists are filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
