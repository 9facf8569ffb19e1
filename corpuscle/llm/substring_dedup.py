"""Substring dedup: hashes of every fixed-length word window, counted in Spark; repeated windows merge into removal intervals.

How it runs at any size:

1. ``chunks``: whole documents, packed and compressed into rows of about 4 MB, written once to the shared folder.
2. Each chunk's rolling Rabin-Karp hashes (64 bits) are made distinct within the chunk and dealt to buckets by their
   upper bits, as sorted, delta-coded rows: about 6 bytes a window are shuffled. A window that a million documents
   share arrives once per chunk, so no key is hot.
3. Each bucket counts its hashes and answers each row with one bit per hash: repeated or not.
4. The bits return to their chunk by a join on the chunk's number; there, intervals and kept words are made.

Two different windows of n are taken for equal with a chance of n * n / 2 ** 65 (about 1e-3 in 1.5e8 windows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C

#: Bytes of text in a chunk, and bytes of text for each bucket of hashes.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 24 << 20


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Whole documents as rows (chunk, ids, lens, body): body has their UTF-8 texts, one after the other, compressed."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lens", T.ArrayType(T.LongType())), T.StructField("n_bytes", T.LongType()), T.StructField("body", T.BinaryType())])
    arrow_id = to_arrow_type(id_type)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, size, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held]).cast(arrow_id)
            data, lens = zip(*((d.tobytes(), np.diff(o)) for d, o in (C.utf8(b.column(1)) for b in held)), strict=True)
            n = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([where + made]), pa.ListArray.from_arrays(n, ids), pa.ListArray.from_arrays(n, pa.array(np.concatenate(lens), pa.int64())), pa.array([size], pa.int64()), pa.array([zstandard.compress(b"".join(data), 3)], pa.binary())], names=[f.name for f in schema])

        for batch in C.slices(batches, text_col, chunk_bytes // 4):
            held.append(batch)
            size += int(C.utf8(batch.column(1))[1][-1])
            if size >= chunk_bytes:
                yield out()
                held, size, made = [], 0, made + 1
        if held:
            yield out()

    return docs.select(id_col, text_col).mapInArrow(pack, schema)


def _windows(body: bytes, lens: np.ndarray, window: int):
    """A chunk's texts, offsets, first words, distinct hashes in order, and for each window its hash's place and its first word."""
    data = np.frombuffer(zstandard.decompress(body), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    hashes, firsts, at_word = [], [0], 0
    lo = 0
    while lo < len(lens):  # a megabyte at a time, for the bytes' arrays are eight times the text
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
        h, f, _ = C.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], C.NOT_SPACE)
        hashes.append(h)
        firsts += [int(x) + at_word for x in f[1:]]
        at_word += len(h)
        lo = hi
    firsts = np.array(firsts)
    rolled, at = C.windows(np.concatenate([*hashes, np.zeros(0, C.U64)]), firsts, window)
    return data, offsets, firsts, *np.unique(rolled, return_inverse=True, return_counts=True), at


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """0 .. n - 1, ascending as the hashes."""
    return ((hashes >> C.U64(32)) * C.U64(n) >> C.U64(32)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as compressed planes of the differences' bytes; planes of chance bytes stay as they are."""
    deltas = np.diff(values, prepend=C.U64(0))
    return zstandard.compress(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(C.U64).ravel(), dtype=C.U64)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that is covered by a window whose word sequence also starts elsewhere.

    Returns per row of docs: id_col, n_words, n_removed, intervals (maximal runs of removed words as (start, end), end
    exclusive, words from 0), kept_text (the kept words, joined by one space). Words are ``[^\\x20\\x09-\\x0D]+``.

    Defined cases: null or empty text has no words and an empty kept_text; texts of fewer words than a window stay
    whole; equal rows are documents of their own, so their windows repeat; a null or repeated id is carried through;
    an empty table gives an empty table; other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    table = C.written(chunks(docs, id_col, text_col), "substring-chunks", codec="uncompressed")
    n_bytes = table.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(C.shuffle_partitions(spark), math.ceil(n_bytes / BUCKET_BYTES))
    id_type = docs.schema[id_col].dataType

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                *_, distinct, _, counts, _ = _windows(row["body"], np.array(row["lens"]), window)
                edges = np.searchsorted(_bucket(distinct, n_buckets), np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                for some in np.array_split(full, max(1, len(full) // 512)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([_packed(distinct[edges[b] : edges[b + 1]]) for b in some], pa.binary()), pa.array([np.packbits(counts[edges[b] : edges[b + 1]] > 1).tobytes() for b in some], pa.binary())],
                        names=["chunk", "bucket", "hashes", "twice"],
                    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([*batches] or [], schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("twice", pa.binary())]))
        if not held.num_rows:
            return
        values = [_unpacked(x) for x in held["hashes"].to_pylist()]
        sizes = np.array([len(x) for x in values])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(held["twice"].to_pylist(), sizes, strict=True)])
        values = np.concatenate(values)
        order = np.argsort(values, kind="stable")
        values = values[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])
        groups = np.flatnonzero(new)
        more = np.diff(np.append(groups, len(values))) > 1
        repeated = np.empty(len(values), bool)
        repeated[order] = (more | (np.maximum.reduceat(twice[order], groups) > 0))[np.cumsum(new) - 1]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        some = [i for i in range(len(sizes)) if repeated[edges[i] : edges[i + 1]].any()]
        yield pa.RecordBatch.from_arrays([held["chunk"].combine_chunks().take(pa.array(some, pa.int64())), held["bucket"].combine_chunks().take(pa.array(some, pa.int64())), pa.array([np.packbits(repeated[edges[i] : edges[i + 1]]).tobytes() for i in some], pa.binary())], names=["chunk", "bucket", "bits"])

    dealt = table.select("chunk", "lens", "body").mapInArrow(deal, "chunk long, bucket int, hashes binary, twice binary")
    bits = dealt.repartitionById(n_buckets, F.col("bucket")).mapInArrow(count, "chunk long, bucket int, bits binary")
    bits = bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, lens = row.column(1).flatten(), row.column(2).flatten().to_numpy()
                data, offsets, firsts, distinct, place, _, at = _windows(row.column(3)[0].as_py(), lens, window)
                edges = np.searchsorted(_bucket(distinct, n_buckets), np.arange(n_buckets + 1))
                repeated = np.zeros(len(distinct), bool)
                for x in row.column(4)[0].as_py() or ():
                    a, b = edges[x["bucket"]], edges[x["bucket"] + 1]
                    repeated[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
                hit = at[repeated[place]]
                steps = np.zeros(firsts[-1] + 1, np.int64)
                np.add.at(steps, hit, 1)
                np.add.at(steps, hit + window, -1)
                gone = np.cumsum(steps)[:-1] > 0
                yield from _results(ids, data.tobytes(), offsets, firsts, gone)

    def _results(ids, data, offsets, firsts, gone) -> Iterator[pa.RecordBatch]:
        n_removed, spans, kept = [], [], []
        for d in range(len(ids)):
            mine = gone[firsts[d] : firsts[d + 1]]
            text = data[offsets[d] : offsets[d + 1]].split()
            n = int(mine.sum())
            n_removed.append(n)
            kept.append(b" ".join(compress(text, ~mine) if n else text))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))) if n else np.zeros(0, np.int64)
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(firsts), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "intervals", "kept_text"])

    out = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string").fields])
    return table.join(bits, "chunk", "left").select("chunk", "ids", "lens", "body", "bits").mapInArrow(finish, out)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """remove_repeats with windows of 35 words over the whole of documents."""
    return remove_repeats(C.documents(spark, sf_dir), window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
