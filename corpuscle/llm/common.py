"""What the operators of this subpackage share: the shared folder, written tables, and texts as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.session import folder, shared_dir  # noqa: F401  (shared_dir is part of what operators may use)
from corpuscle.session import shared_folder as shared_path

U64 = np.uint64
#: Odd multipliers of 64 bits for mixing; any odd numbers do.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: 2 ** 64 / golden ratio.
GOLDEN = U64(0x9E3779B97F4A7C15)


#: Keys that may be broadcast where each has a great part of all rows.
MOST_HEAVY = 250_000
#: Rows of a part of a table of narrow rows, and the least parts, where its size is known before it is written.
PART_ROWS, LEAST_PARTS = 500_000, 8


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    jpath, files = folder(spark, path)
    return [x.getPath().getName() for x in files.listStatus(jpath)] if files.exists(jpath) else []


def deleted(spark: SparkSession, path: str) -> None:
    jpath, files = folder(spark, path)
    files.delete(jpath, True)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read again: it cuts the lineage and survives lost executors.

    rows: a bound of its rows, if they are narrow; a small table then isn't written in as many parts as a large one.
    The folder goes when the session's JVM ends, or with ``unwritten``.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))
    path = shared_path(spark, name)
    write = df.write.option("compression", codec)
    (write.partitionBy(*partition_by) if partition_by else write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def unwritten(df: DataFrame) -> None:
    """Delete what ``written`` wrote; df can't be read any more."""
    deleted(df.sparkSession, df._written_to)


def join_counted(rows: DataFrame, keys: DataFrame, on: str, count: str, at_most: int | None = None, how: str = "inner") -> DataFrame:
    """The join (inner or left) of rows with keys, where keys (a written table) has each key once, and ``count`` is at
    least the number of its rows.

    No key becomes hot: as counts add up, at most MOST_HEAVY keys have a MOST_HEAVY-th of all counted rows or more, and
    these are broadcast; the others are joined by a shuffle. If there are no more keys than that (at_most, a bound that
    is known, may say so), all are broadcast.
    """
    if at_most is not None and at_most <= MOST_HEAVY:
        return rows.join(F.broadcast(keys.drop(count)), on, how)
    n, total = keys.agg(F.count("*"), F.sum(count)).first()
    if n <= MOST_HEAVY:
        return rows.join(F.broadcast(keys.drop(count)), on, how)
    is_heavy = F.col(count) * F.lit(float(MOST_HEAVY)) >= F.lit(float(total))
    heavy, light = F.broadcast(keys.where(is_heavy).drop(count)), keys.where(~is_heavy).drop(count)
    rest = rows.join(heavy, on, "left_anti") if how == "left" else rows
    return rows.join(heavy, on).unionByName(rest.join(light, on, how))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and n + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: each has at most most_bytes of text, or one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), n, at + most_rows)
            yield batch.slice(at, end - at)
            at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_A
        x = (x ^ (x >> U64(27))) * MIX_B
        return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; a worker keeps the longest row of up to 2 ** 21 that it has made."""
    kept = _powers.get(base, _powers.setdefault(base, np.ones(0, U64)))
    if n <= len(kept):
        return kept[:n]
    out = _made(base, max(n, min(2 * n, 1 << 20)))
    if len(out) <= 1 << 21:
        _powers[base] = out
    return out[:n]


def _made(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    if n:
        out[0] = 1
        with np.errstate(over="ignore"):
            done = 1
            while done < n:
                step = min(done, n - done)
                out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
                done += step
    return out


#: Base of the hash of a word's bytes, and its inverse modulo 2 ** 64.
P_WORD = 0x9E3779B97F4A7C15
P_WORD_INV = pow(P_WORD, -1, 1 << 64)
#: Base of the hash of a window's words, and its inverse.
P_WINDOW = 0xD6E8FEB86659FD93
P_WINDOW_INV = pow(P_WINDOW, -1, 1 << 64)
BYTE_VALUES = mixed((np.arange(256, dtype=U64) + U64(1)) * GOLDEN)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Polynomial hashes modulo 2 ** 64 of values[start:end], by prefix sums, so each costs O(1)."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers(base, len(values)), out=sums[1:])
        back = powers(inverse, len(values) + 1)
        return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64) * GOLDEN)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts in UTF-8: a 64-bit hash of each word, and each text's first word (n + 1 offsets), and the words' (start, end) bytes.

    is_word: for each byte, whether it belongs to words. fold: for each byte, the byte that counts in its place.
    """
    inside = is_word[data]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    starts_here[firsts] = inside[firsts]  # a word doesn't run from one text into the next
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:] | starts_here[1:]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    values = BYTE_VALUES[data if fold is None else fold[data]]
    hashes = range_hashes(values, starts, ends, P_WORD, P_WORD_INV)
    return hashes, np.searchsorted(starts, offsets), np.stack([starts, ends], 1)


def windows(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all k consecutive words of one text; the index of each one's first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for back in range(1, k):  # the last k - 1 words of a text start no window
        ok[np.maximum(firsts[1:] - back, firsts[:-1])[firsts[1:] > firsts[:-1]]] = False
    at = np.flatnonzero(ok)
    return range_hashes(hashes, at, at + k, P_WINDOW, P_WINDOW_INV), at


#: \x20 and \x09-\x0D end a word; all other bytes belong to one.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ascii_lower(column):
    """A-Z to a-z, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
