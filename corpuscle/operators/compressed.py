"""The concordance as compressed blocks: gaps of sorted positions in variable-length bytes, with skip entries.

A block holds up to BLOCK positions of one token, in order: token, n, first_doc, last_doc, data. Positions are dealt by
ranges of (token, doc, place), so a token that stands everywhere is cut over many tasks, and the files lie in order of
token and document: statistics of row groups skip what a look-up doesn't ask for. The skip entries first_doc and
last_doc do so within a token: of the commoner of two words, only blocks are decoded whose documents may hold the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import kept, shared_folder

BLOCK = 128
#: Blocks that are decoded at once: a batch's would be millions of positions.
OPENED = 1024
SCHEMA = "token string, n int, first_doc long, last_doc long, data binary"


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers in groups of seven bits, the low ones first, the top bit set on all but a number's last
    byte; and the offset of each number's first byte (n + 1 offsets)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << (7 * k))
    offsets = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(values)), size)
    place = np.arange(offsets[-1]) - offsets[of]
    out = ((values[of] >> (place * 7).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    return out | np.where(place < size[of] - 1, 128, 0).astype(np.uint8), offsets


def from_bytes(data: np.ndarray) -> np.ndarray:
    """The numbers that to_bytes has written."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def _gaps(doc: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position two numbers: documents since the one before, and places since it (from 0 in another document)."""
    by_doc, by_place = np.diff(doc, prepend=0), np.diff(place, prepend=0)
    by_doc[starts] = 0
    anew = by_doc != 0
    anew[starts] = True
    return np.stack([by_doc, np.where(anew, place, by_place)], 1).ravel()


def _places(gaps: np.ndarray, starts: np.ndarray, first_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _gaps was made from; starts: each block's first position."""
    by_doc, by_place = gaps[0::2].copy(), gaps[1::2]
    anew = by_doc != 0
    anew[starts] = True
    sizes = np.diff(np.append(starts, len(by_doc)))
    run = np.cumsum(by_doc)
    doc = run - np.repeat(run[starts], sizes) + np.repeat(first_docs, sizes)  # the first gap of a block is 0
    heads = np.flatnonzero(anew)
    total = np.cumsum(by_place)
    before = total[heads] - by_place[heads]
    return doc, total - np.repeat(before, np.diff(np.append(heads, len(by_place))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (token, doc, place) as blocks; what is left of a batch waits for the next one."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        yield from _cut(table.slice(0, done := _open_from(table)))
        rest = table.slice(done)
    if rest is not None:
        yield from _cut(rest)


def _runs(table: pa.Table) -> np.ndarray:
    """Where each token's rows begin."""
    token = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.diff(token, prepend=-1)) if len(token) else np.zeros(0, np.int64)


def _open_from(table: pa.Table) -> int:
    """From which row on a block may still grow: the last token's rows beyond its last full block."""
    last = int(_runs(table)[-1])
    return last + (table.num_rows - last) // BLOCK * BLOCK


def _cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    if not n:
        return
    table = table.combine_chunks()
    doc, place = (table.column(k).to_numpy().astype(np.int64) for k in (1, 2))
    runs = _runs(table)
    within = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
    starts = np.flatnonzero(within % BLOCK == 0)
    ends = np.append(starts[1:], n)
    data, offsets = to_bytes(_gaps(doc, place, starts))
    raw, at = data.tobytes(), offsets[np.append(starts, n) * 2]
    columns = [
        table.column(0).combine_chunks().take(pa.array(starts)),
        pa.array((ends - starts).astype(np.int32)),
        pa.array(doc[starts]),
        pa.array(doc[ends - 1]),
        pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["token", "n", "first_doc", "last_doc", "data"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, OPENED) for b in batches for at in range(0, b.num_rows, OPENED)):
        n, first = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        doc, place = _places(from_bytes(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)), starts, first)
        token = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([token, pa.array(doc), pa.array(place.astype(np.int32))], names=["token", "doc", "place"])


def compress(rows: DataFrame, token: str, doc: str, place: str, path: str | None = None) -> DataFrame:
    """Write the positions as blocks, and read them. doc is a long, place an int from 0.

    Rows with a null in one of the three are left out; repeated rows are kept as often as they occur.
    """
    path = path or shared_folder(rows.sparkSession, "postings")
    three = rows.select(F.col(token).alias("token"), F.col(doc).cast("long").alias("doc"), F.col(place).cast("int").alias("place")).dropna()
    by = ["token", "doc", "place"]
    three.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_blocks, SCHEMA).write.parquet(path)
    return rows.sparkSession.read.schema(SCHEMA).parquet(path)


def decompress(blocks: DataFrame) -> DataFrame:
    """token, doc, place of the blocks; of a few tokens, if blocks are filtered before."""
    return blocks.select("token", "n", "first_doc", "data").mapInArrow(_open, "token string, doc long, place int")


def overlapping(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """The blocks (of one token) whose documents may include one of docs (doc, each once).

    Documents and blocks meet in stripes as wide as a block is in the mean: a token's blocks follow each other, so they
    cover no more than twice as many stripes as there are blocks.
    """
    lo, hi, n = blocks.agg(F.min("first_doc"), F.max("last_doc"), F.count("*")).first()
    if not n:
        return blocks
    width = max(1, (hi - lo) // n)
    stripe = lambda c: F.floor((c - F.lit(lo)) / F.lit(width))
    cover = blocks.select("first_doc", "last_doc", F.explode(F.sequence(stripe(F.col("first_doc")), stripe(F.col("last_doc")))).alias("stripe"))
    asked = docs.where(F.col("doc").between(lo, hi)).select("doc", stripe(F.col("doc")).alias("stripe"))
    met = cover.join(asked, "stripe").where("doc between first_doc and last_doc").select("first_doc", "last_doc").distinct()
    return blocks.join(met, ["first_doc", "last_doc"], "left_semi")


def conjunction(blocks: DataFrame, one: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Positions (doc, place) of one, and of other, in documents that may have both: all of the rarer word's, and of the
    commoner's those in blocks that overlap with the rarer's documents."""
    counts = {r.token: r.n for r in blocks.where(F.col("token").isin(one, other)).groupBy("token").agg(F.sum("n").alias("n")).collect()}
    rare, common = sorted((one, other), key=lambda w: (counts.get(w, 0), w))
    few = kept(decompress(blocks.where(F.col("token") == rare)).select("doc", "place"), "rarer")
    many = decompress(overlapping(blocks.where(F.col("token") == common), few.select("doc").distinct())).select("doc", "place")
    return (few, many) if rare == one else (many, few)


def documents_with(blocks: DataFrame, one: str, other: str) -> DataFrame:
    """doc, n_one, n_other: of the documents that have both words."""
    count = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    a, b = conjunction(blocks, one, other)
    return count(a, "n_one").join(count(b, "n_other"), "doc")


def phrase(blocks: DataFrame, one: str, other: str, apart: int | Column = 1) -> DataFrame:
    """doc, place: where one stands with other so many places behind it."""
    a, b = conjunction(blocks, one, other)
    return a.join(b.select("doc", (F.col("place") - F.lit(apart)).alias("place")), ["doc", "place"])
