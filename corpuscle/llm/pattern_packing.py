"""Best-fit packing by patterns: non-negative least squares fit few-document length patterns to the histogram of lengths.

Pieces never reach the driver; it sees the histogram (at most ``capacity`` counts) and plans with runs of equal
sequences, so its work doesn't grow with the input:

1. Texts are tokenized where they lie; only (id, piece, length, crc) rows are written, to the shared folder.
2. ``plan_patterns``: lengths, rounded up to bins of capacity / 128, are packed by patterns of up to three bins that
   fill a sequence; repeat counts come from non-negative least squares, rounded down; a pattern's last place takes the
   longest true length that fits; what remains goes best-fit
   decreasing, by true lengths, into the space left in patterns, then into new sequences.
3. Pieces of one length are numbered within salted groups (tasks deal pieces out to salts in turn, so no group holds more
   than its share of a common length, be it of one id or of none), and a binary search in the plan, which is small, gives each number its sequence and place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C
from corpuscle.llm.tokens import word_tokens

#: Bins of the least squares, and ids that end a document.
BINS, END = 128, 1


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with a small ||a x - b||, by accelerated projected gradients from zero."""
    gram, target = a.T @ a, a.T @ b
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * (gram @ y - target))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = z, z + (last - 1) / t * (z - x)
    return x


def patterns(bins: int = BINS) -> list[tuple[int, ...]]:
    """All descending tuples of one to three bins that add up to all bins."""
    two = [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    three = [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 1 <= bins - a - b <= b]
    return [(bins,), *two, *three]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Sequences as runs (repeats, lengths in order of place), which use up the histogram of lengths 1 .. capacity."""
    unit = -(-capacity // BINS)
    bins = capacity // unit
    left = {n: k for n, k in histogram.items() if k}
    by_bin: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        by_bin.setdefault(-(-n // unit), []).append(n)
    counts = np.array([sum(left[n] for n in by_bin.get(b, ())) for b in range(1, bins + 1)], float)
    shapes = [p for p in patterns(bins) if all(b in by_bin for b in p)]
    runs: list[tuple[int, list[int]]] = []
    if shapes:
        a = np.zeros((bins, len(shapes)))
        for j, p in enumerate(shapes):
            for b in p:
                a[b - 1, j] += 1
        weight = 1 / np.sqrt(np.maximum(counts, 1))  # so that a rare bin counts beside a common one
        fitted = nonnegative_least_squares(a * weight[:, None], counts * weight)
        free = counts.astype(np.int64)
        for j in np.argsort(-fitted, kind="stable"):
            need = Counter(shapes[j])
            repeats = min(int(fitted[j] + 1e-6), *(int(free[b - 1]) // k for b, k in need.items()))
            for b, k in need.items():
                free[b - 1] -= repeats * k
            while repeats > 0:  # a run has one true length at each place
                lengths, times, use = [], repeats, Counter()
                for k, b in enumerate(shapes[j]):
                    some = by_bin[b]
                    if 0 < k == len(shapes[j]) - 1:  # the last place takes the longest that still fits, to lose no room to rounding
                        some = [n for c in (b + 2, b + 1, b) for n in by_bin.get(c, ()) if n <= capacity - sum(lengths)]
                    n = next((n for n in some if left[n] > use[n]), None)
                    if n is None:
                        break
                    use[n] += 1
                    lengths.append(n)
                if n is None:  # its lengths have gone to other patterns
                    break
                times = min(times, *(left[n] // k for n, k in use.items()))
                if times == 0:  # one length is wanted twice, and one is left
                    times = 1
                for n, k in use.items():
                    left[n] -= times * k
                runs.append((times, lengths))
                repeats -= times
    # best fit decreasing over runs: those that have room, by the room that they have
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for times, lengths in runs:
        room.setdefault(capacity - sum(lengths), []).append((times, lengths))
    rooms = sorted(room)
    done: list[tuple[int, list[int]]] = []

    def put(times: int, lengths: list[int]) -> None:
        r = capacity - sum(lengths)
        if r == 0:
            done.append((times, lengths))
            return
        if not room.get(r):
            insort(rooms, r)
        room.setdefault(r, []).append((times, lengths))

    for n in sorted(left, reverse=True):
        while left[n]:
            i = bisect_left(rooms, n)
            if i == len(rooms):  # a new sequence takes as many of this length as fit
                each = min(capacity // n, left[n])
                times = left[n] // each
                left[n] -= times * each
                put(times, [n] * each)
                continue
            r = rooms[i]
            times, lengths = room[r].pop()
            if not room[r]:
                del rooms[i]
            each = min(r // n, left[n])
            take = min(times, left[n] // each)
            left[n] -= take * each
            if take < times:
                put(times - take, lengths)
            put(take, [*lengths, *[n] * each])
    return done + [x for xs in room.values() for x in xs]


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", salts: int = 1) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, _salt) of at most capacity tokens: a text's ids, then END.

    A task deals its pieces out to salts in turn, whatever their ids and texts are.
    """
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    schema = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, _salt int").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_tokens(tokenizer).encode, np.array([END], "<u4").tobytes()
        dealt = TaskContext.get().partitionId()
        for batch in C.slices(batches, text_col, 1 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[lo : lo + 4 * capacity]
                    row.append(i), piece.append(k), start.append(lo // 4), length.append(len(some) // 4), crc.append(zlib.crc32(some))
            salt = pa.array(((dealt + np.arange(len(row))) % salts).astype(np.int32))
            dealt += len(row)
            numbers = [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            ids = batch.column(0).cast(arrow_id).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *numbers, salt], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents' tokens into few sequences of at most capacity; only longer documents are cut.

    Returns per piece: id_col, piece (from 0), start (the document's ids before it), length, ids_crc32 (of the ids as
    unsigned little-endian 32-bit), sequence_id, offset (places are gapless from 0).

    Defined cases: null or empty text is the one id END; equal rows are packed each for itself; a null id is carried
    through; an empty table gives an empty table; other columns aren't read.
    """
    spark = docs.sparkSession
    salts = max(64, C.shuffle_partitions(spark))
    pieces = C.written(token_pieces(docs, capacity, tokenizer, id_col, text_col, salts), "packing-pieces")
    per_group = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in per_group.groupBy("length").agg(F.sum("_n")).collect()}  # at most capacity rows
    plan = plan_patterns(histogram, capacity)

    # the plan as arrays, by (length, number of the piece among those of its length)
    lengths, repeats, offsets, bases, used, base = [], [], [], [], Counter(), 0
    starts = []
    for times, run in plan:
        place = 0
        for n in run:
            lengths.append(n), starts.append(used[n]), repeats.append(times), offsets.append(place), bases.append(base)
            used[n] += times
            place += n
        base += times
    order = np.lexsort((starts, lengths)) if lengths else np.zeros(0, np.int64)
    lengths, starts, offsets, bases = (np.array(x, np.int64)[order] for x in (lengths, starts, offsets, bases))
    first_of = np.searchsorted(lengths, np.arange(capacity + 2))

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = per_group.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ties = [F.col(id_col), F.col("piece"), F.col("ids_crc32")]
    numbered = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*ties)))
    numbered = numbered.join(groups, ["length", "_salt"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank") - 1).alias("_number"))
    schema = T.StructType([*numbered.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                a, b = first_of[x], first_of[x + 1]
                mine = n == x
                at[mine] = a + np.searchsorted(starts[a:b], number[mine], "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bases[at] + number - starts[at], pa.int64()), pa.array(offsets[at], pa.int64())], names=schema.names)

    return numbered.mapInArrow(place_all, schema)


def op7_pattern_packing(spark, sf_dir: str) -> DataFrame:
    """pack the whole of documents into sequences of 4096 tokens."""
    return pack(C.documents(spark, sf_dir), capacity=4096)
