"""Packed token matrices: best-fit-decreasing packing with a segment tree over capacities, documents split losslessly.

Each task packs what it reads, in buffers of a fixed number of tokens, so nothing is shuffled or sent to the driver, a
lost executor costs its own tasks only, and memory is bounded by the buffer. A buffer leaves at most about one
sequence's room unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C
from corpuscle.llm.tokens import word_tokens

#: The id that ends a document, the id that fills a row, and the tokens that a task holds at once.
END, FILL, BUFFER = 1, 0, 4 << 20


class CapacityTree:
    """A segment tree over the capacities 0 .. n: which of them some open sequence has; finds the least that suffices."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) with the least room of at least length."""
        some, at = self.some, length + self.leaves
        while not some[at]:  # the least subtree to the right that has something
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if some[2 * at] else 2 * at + 1
        room = at - self.leaves
        found = self.open[room].pop()
        if not self.open[room]:
            while at and not (at < self.leaves and (some[2 * at] or some[2 * at + 1])):
                some[at] = 0
                at >>= 1
        return room, found


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indices into lengths, each of at most capacity; ties by index."""
    tree, sequences = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            room, sequence = capacity, len(sequences)
            sequences.append([])
        else:
            room, sequence = found
        sequences[sequence].append(i)
        tree.add(room - lengths[i], sequence)
    return sequences


def pack_tokens(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", buffer: int = BUFFER) -> DataFrame:
    """Rows of packed token matrices, one per sequence.

    Returns shard (long: the task and its buffer), row (int: the sequence's row in its shard's matrix), n_tokens (int),
    input_ids (binary: capacity little-endian unsigned 32-bit ids, FILL after n_tokens), cu_seqlens (array<int>: 0 and
    each segment's end, cumulated), position_resets (array<int>: the places where positions start from 0 again), segments
    (array<struct<id, piece int, start long>>: whose ids these are, in the order of cu_seqlens; start: the document's
    ids before it).

    A document is its ids, then END; only longer ones are cut, into pieces of capacity. ``unpack`` gives back all ids.

    Defined cases: null or empty text is the one id END; equal rows are packed each for itself; a null id is carried
    through; an empty table gives an empty table; other columns aren't read.
    """
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    segment = T.StructType([T.StructField("id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType())])
    schema = T.StructType([*T._parse_datatype_string("shard long, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>").fields, T.StructField("segments", T.ArrayType(segment))])
    arrow_segments = pa.list_(pa.struct([("id", arrow_id), ("piece", pa.int32()), ("start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_tokens(tokenizer).encode, np.array([END], "<u4").tobytes()
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in C.slices(batches, text_col, 1 << 20):
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                held += [(key, k, ids[lo : lo + 4 * capacity]) for k, lo in enumerate(range(0, len(ids), 4 * capacity))]
                size += len(ids) // 4
            if size >= buffer:
                yield from matrix(shard, held)
                shard, held, size = shard + 1, [], 0
        if held:
            yield from matrix(shard, held)

    def matrix(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        sequences = best_fit_decreasing([len(x[2]) // 4 for x in held], capacity)
        for lo in range(0, len(sequences), 256):
            rows = [[held[i] for i in s] for s in sequences[lo : lo + 256]]
            ends = [np.cumsum([0, *(len(x[2]) // 4 for x in row)]).tolist() for row in rows]
            fill = np.array([FILL], "<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(rows), pa.int64()), pa.array(range(lo, lo + len(rows)), pa.int32()), pa.array([e[-1] for e in ends], pa.int32()), pa.array([b"".join(x[2] for x in row) + fill * (capacity - e[-1]) for row, e in zip(rows, ends, strict=True)], pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array([e[:-1] for e in ends], pa.list_(pa.int32())), pa.array([[{"id": x[0], "piece": x[1], "start": x[1] * capacity} for x in row] for row in rows], arrow_segments)],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write pack_tokens' rows as Parquet, by Spark, so any store that Spark writes to will do; a shard's rows in order."""
    packed.sortWithinPartitions("shard", "row").write.option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces again: id_col, piece, start, ids (array of long), from the matrices alone."""
    fields = packed.schema["segments"].dataType.elementType.fields
    schema = T.StructType([T.StructField(id_col, fields[0].dataType), fields[1], fields[2], T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, segments = (batch.column(c)[i].as_py() for c in range(3))
                ids = np.frombuffer(ids, "<u4").astype(np.int64)[: ends[-1]]
                keys = [pa.array([s[f.name] for s in segments], to_arrow_type(f.dataType)) for f in fields]
                yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=schema.names)

    return packed.select("input_ids", "cu_seqlens", "segments").mapInArrow(run, schema)


def op8_token_shards(spark, sf_dir: str) -> DataFrame:
    """pack_tokens over the whole of documents, rows of 4096 ids."""
    return pack_tokens(C.documents(spark, sf_dir), capacity=4096)
