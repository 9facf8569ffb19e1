"""Document fingerprints by a randomised edit embedding.

All texts walk with the same random bits: at step j on character c a walk either stays or goes on, by a bit that only
depends on (j, c). What is seen at each step is the embedding; texts at a small edit distance fall into step again
after an edit, so their embeddings are at a small Hamming distance. The embedding has three steps per character; a
fingerprint samples it at fixed steps, the same for all texts: all of the first 64, then 64 in each further octave, so
any two texts share their samples, whatever their lengths, at a size that grows with the length's logarithm. Each
sample keeps four bits (a hash of the three characters before that place); ``likeness`` weighs samples by the steps
that they stand for.

Near duplicates are found by bit-sampled banding and verification: a band takes ``WIDTH`` samples, drawn in proportion
to their weight from all octaves that texts of about one length have, so it agrees with the chance that two
fingerprints agree to the power of ``WIDTH``, wherever in the texts they differ. Texts that agree in one of ``BANDS``
bands are verified by ``likeness``. At a likeness of 0.8 samples agree by 0.8125, so a pair is missed with a chance of
(1 - 0.8125 ** 10) ** 24 = 4 %; with likenesses above that, of less (0.85: 0.3 %).

A walk goes over whole texts. It is run by character, not by step: a table has, for each step (modulo ``PERIOD``) and
character class, after how many steps the walk goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C
from corpuscle.llm.graphs import components_by_key

#: Steps of the embedding per character; steps after which the bits recur; classes that characters are hashed to.
STRETCH, PERIOD, CLASSES = 3, 4096, 64
#: Samples per octave of steps; octaves: texts of up to 2 ** OCTAVES / 3 characters.
EACH, OCTAVES = 64, 40
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Samples of a band, bands, and the factor between the lengths (as weights) of two families of texts.
WIDTH, BANDS, FAMILY = 10, 24, 1.5
#: What a sample may be, as numbers of five bits: a hexadecimal digit, or a dash. So WIDTH is at most 12.
SYMBOLS = np.full(256, 16, np.uint64)
SYMBOLS[DIGITS] = np.arange(16)
#: Ranges that documents are dealt into at most: larger tables have larger ranges, and as many bounds.
MOST_PARTS = 1 << 16
#: A walk has this many texts at once at least; fewer are walked one by one.
MANY = 48


@cache
def _tables() -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """go[c, j]: steps until the walk leaves a character of class c that it came to at step j; the sampled steps."""
    rng = np.random.default_rng(20240607)
    bits = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    go = np.empty((CLASSES, PERIOD), np.int64)
    nxt = np.full(CLASSES, PERIOD)
    for j in range(PERIOD - 1, -1, -1):
        nxt = np.where(bits[:, j] == 1, j, nxt)
        go[:, j] = nxt - j + 1
    steps = [np.arange(EACH)]
    for o in range(6, OCTAVES):
        width = 1 << o
        stratum = width // EACH
        steps.append(width + np.arange(EACH) * stratum + rng.integers(0, stratum, EACH))
    return go, go.tolist(), np.concatenate(steps).astype(np.int64)


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int64)


def walk(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each character of codes within a range start:end, the step at which its walk, begun at step begin, comes to it.

    Characters outside all ranges get 0. One more place per range isn't kept: where it ends follows from its last.
    """
    go, go_list, _ = _tables()
    classes = _classes(codes)
    at = np.zeros(len(codes) + 1, np.int64)
    order = np.argsort(starts - ends, kind="stable")  # longest first
    order = order[ends[order] > starts[order]]
    lens, first, step = (ends - starts)[order], starts[order], begin[order].astype(np.int64)
    done = 0
    flat = go.ravel()
    while len(order) and len(lens) >= MANY:
        active = int(np.searchsorted(-lens, -done, "left"))  # those longer than done
        if active < MANY:
            break
        until = int(lens[active - 1])
        lens_a, first_a, step_a = lens[:active], first[:active], step[:active]
        for t in range(done, until):
            place = first_a + t
            at[place] = step_a
            step_a = step_a + flat[classes[place] * PERIOD + (step_a & (PERIOD - 1))]
        step[:active] = step_a
        done = until
    for i in range(len(order)):
        if lens[i] <= done:
            break
        j, seen = int(step[i]), []
        lo, hi = int(first[i]) + done, int(first[i] + lens[i])
        for c in classes[lo:hi].tolist():
            seen.append(j)
            j += go_list[c][j & (PERIOD - 1)]
        at[lo:hi] = seen
    return at[:-1]


def _nibbles(codes: np.ndarray) -> np.ndarray:
    """For each character a hash of it and of the two before it, four bits."""
    with np.errstate(over="ignore"):
        c = codes.astype(np.uint32) + np.uint32(1)
        h = c * np.uint32(0x85EBCA6B)
        h[1:] ^= c[:-1] * np.uint32(0xC2B2AE35)
        h[2:] ^= c[:-2] * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        return ((h * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)


def n_samples(n_chars: int) -> int:
    """Samples of a fingerprint of a text of so many characters: those at steps below three per character."""
    return int(np.searchsorted(_tables()[2], STRETCH * n_chars))


def fingerprint_one(nibbles: np.ndarray, at: np.ndarray) -> str:
    """The fingerprint of a walk: at each sampled step the four bits of the character there, '-' after the end."""
    steps = _tables()[2][: n_samples(len(at))]
    if not len(steps):
        return ""
    place = np.searchsorted(at, steps, "right") - 1
    last = int(at[-1]) + 4 * STRETCH  # after its last character a walk has ended, some steps on
    out = DIGITS[nibbles[place]]
    out[steps > last] = ord("-")
    return out.tobytes().decode()


@cache
def _weights(n: int) -> np.ndarray:
    o = np.maximum(0, np.arange(n) // EACH - 1)
    return np.where(np.arange(n) < EACH, 1.0, np.exp2(o))


def likeness(a: str, b: str) -> float:
    """0 to 1: the weighted part of samples that agree, without what chance agrees on; samples after both ends don't count."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, "-").encode(), np.uint8) for s in (a, b))
    live = (x != 45) | (y != 45)
    w = _weights(n) * live
    same = float((w * (x == y)).sum() / max(w.sum(), 1e-12))
    return float(min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16))))


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprints of texts."""
    lens = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(lens)
    at = walk(codes, ends - lens, ends, np.zeros(len(texts), np.int64))
    return [fingerprint_one(_nibbles(codes[e - n : e]), at[e - n : e]) for e, n in zip(ends, lens, strict=True)]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars (code points), fingerprint of whole texts; no shuffle.

    Defined cases: null and empty texts have the empty fingerprint; equal texts equal ones; a null or repeated id is
    carried through; an empty table gives an empty table; other columns aren't read.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("n_chars long, fingerprint string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, text_col, 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(id_type)), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints(texts), pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def least_agreement(least: float) -> float:
    """The weighted part of samples that agree at a likeness."""
    return least * 15 / 16 + 1 / 16


@cache
def _total_weights() -> np.ndarray:
    """The weight of the first 0, 1, 2 .. samples."""
    return np.concatenate([[0.0], np.cumsum(_weights(len(_tables()[2])))])


@cache
def _picks(family: int) -> np.ndarray:
    """The samples of each band (BANDS x WIDTH) for texts whose live samples weigh less than FAMILY ** (family + 1)."""
    n = max(1, int(np.searchsorted(_total_weights(), FAMILY ** (family + 1), "right")) - 1)
    w = _weights(n) / _weights(n).sum()
    rng = np.random.default_rng([7, family])
    return np.array([np.sort(rng.choice(n, WIDTH, replace=n < WIDTH, p=w)) for _ in range(BANDS)])


def band_keys(prints: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of fingerprints, and whose each is.

    Samples after the shorter of two texts' ends all differ, so texts of a likeness of ``least`` or more have live
    samples whose weights differ by no more than that; a text has the bands of all families that such a text may be in.
    """
    lens = np.array([len(p.rstrip("-")) for p in prints], np.int64)
    weight = _total_weights()[lens]
    with np.errstate(divide="ignore"):
        lo = np.floor(np.log(weight) / np.log(FAMILY))
        hi = np.floor(np.log(weight / least_agreement(least)) / np.log(FAMILY))
    keys, owners = [np.zeros(0, C.U64)], [np.zeros(0, np.int64)]
    live = lens > 0
    for family in range(int(lo[live].min()), int(hi[live].max()) + 1) if live.any() else ():
        some = np.flatnonzero(live & (lo <= family) & (family <= hi))
        if not len(some):
            continue
        picks = _picks(family)
        n = int(picks.max()) + 1
        samples = np.frombuffer("".join(prints[i][:n].ljust(n, "-") for i in some).encode(), np.uint8).reshape(len(some), n)
        bands = SYMBOLS[samples[:, picks]] @ (C.U64(1) << (C.U64(5) * np.arange(WIDTH, dtype=C.U64)))
        with np.errstate(over="ignore"):
            salts = C.mixed((np.arange(BANDS, dtype=C.U64) + C.U64((family + 64) * BANDS)) * C.GOLDEN)
            keys.append(C.mixed(bands ^ salts).ravel())
        owners.append(np.repeat(some, BANDS))
    return np.concatenate(keys), np.concatenate(owners)


def _banded(classes: DataFrame, least: float) -> DataFrame:
    """(key, node) of all bands of (class, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "fingerprint", 1 << 20):
            keys, owners = band_keys(batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(owners))], names=["key", "node"])

    return classes.select("class", "fingerprint").mapInArrow(run, "key long, node long")


def _verified(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of classes those that are as like as ``least``."""
    both = pairs.join(prints.toDF("a", "print_a"), "a").join(prints.toDF("b", "print_b"), "b").select("a", "b", "print_a", "print_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [likeness(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array(np.flatnonzero(like))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _compared(least: float):
    """Which members (flags, fingerprint) of a key are as like as ``least``: ``likeness``, of one with many."""

    def compare(rows: list[tuple]):
        n = max(len(r[1]) for r in rows)
        samples = np.frombuffer("".join(r[1].ljust(n, "-") for r in rows).encode(), np.uint8).reshape(len(rows), n)
        live, weights = samples != ord("-"), _weights(n)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            same = (samples[others] == samples[i]) & live[i]
            total = (live[others] | live[i]) @ weights
            return same @ weights >= (least_agreement(least) - 1e-12) * np.maximum(total, 1e-12)

        return near

    return compare


def near_classes(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """Near duplicates by banding and verification, of rows (id_col, fingerprint).

    Returns (class, near_class, n) for classes of equal fingerprints that have several rows or a link: class is
    ``xxhash64(fingerprint)``, near_class the least id that verified links reach, n the rows of the class.

    Every pair that meets in a band and isn't connected otherwise is verified, not only pairs with a band's leader
    (``components_by_key``); copies are folded into their class first.

    Defined cases: rows without a sample (empty texts) are one class and linked with no other; null ids count as larger
    than any, and near_class is null where there is no other; an empty table gives an empty table.
    """
    prints = prints.select(F.col(id_col).alias("id"), "fingerprint", F.xxhash64("fingerprint").alias("class"))
    n = prints.count()
    classes = prints.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = C.written(classes, "edit-classes", rows=n)
    banded = _banded(prints, least)
    keys = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    keys = C.written(keys.select("key", "n"), "edit-keys", rows=2 * BANDS * n)
    members = C.join_counted(banded, keys, "key", "n").distinct().withColumn("flags", F.lit(0))
    members = C.written(members, "edit-members", rows=2 * BANDS * n)
    met = members.select(F.col("node").alias("class")).distinct()
    # copies are folded before they are shuffled, so the join meets each class once
    asked = prints.groupBy("class").agg(F.first("fingerprint").alias("fingerprint")).join(met, "class", "left_semi")
    asked = C.written(asked, "edit-asked", rows=8 * n)
    linked = components_by_key(members, asked.withColumnRenamed("class", "node"), lambda pairs: _verified(pairs, asked, least), _compared(least))
    linked = C.written(linked.withColumnRenamed("node", "class"), "edit-components", rows=n)
    named = classes.join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = C.written(named.where("n > 1").unionByName(linked.join(classes, "class").where("n = 1")), "edit-named", rows=n)
    firsts = named.groupBy("component").agg(F.min("first").alias("near_class"), F.count("*").alias("classes"))
    firsts = C.written(firsts, "edit-firsts", rows=n)
    return C.join_counted(named, firsts, "component", "classes", at_most=n).select("class", "near_class", "n")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20) -> DataFrame:
    """Each whole text and its edited text, whose last floor(n / 2) code points give way to the next document's first.

    The next document is the one with the next id, equal ids by a hash of the text; after the last comes the first.
    Documents are dealt by ranges of (id, hash), compressed, so many rows of one id (or of none) are spread as well. Each
    range is worked through alone, all but its last document, which waits for the first of the next range: the first and
    last documents of ranges, two for each, are put together in a second step.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined cases: null text is empty; an only document is its own next; null ids come first; ids of any type that has
    an order will do; an empty table gives an empty table; other columns aren't read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    id_field = T.StructField("_id", id_type)
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = min(max(C.shuffle_partitions(spark), -(-size // part_bytes)), MOST_PARTS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "_text", 1 << 20):
            bodies = pa.array([zstandard.compress(t.encode(), 3) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bodies], names=["_id", "_hash", "body"])

    dealt = keyed.mapInArrow(packed, T.StructType([id_field, *T._parse_datatype_string("_hash long, body binary").fields]))
    dealt = dealt.repartitionByRange(parts, F.asc("_id"), F.asc("_hash")).sortWithinPartitions("_id", "_hash")
    results = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    # what a range gives: results, and its first and its last document
    given = T.StructType([*results.fields, *T._parse_datatype_string("range int, body binary, what string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held: list[tuple] = []  # (id, text), a document that waits for its next one comes last
        size, first, last = 0, None, None
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = zstandard.decompress(body).decode()
                first, last = first or (key, body), (key, body)
                held.append((key, text))
                size += len(text)
                if size >= 1 << 21 and len(held) > 1:
                    yield from whole(made(held))
                    held, size = held[-1:], len(text)
        if len(held) > 1:
            yield from whole(made(held))
        if first:
            keys, bodies = zip(first, last, strict=True)
            none = [pa.nulls(2, to_arrow_type(f.dataType)) for f in results.fields[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_id), *none, pa.array([here] * 2, pa.int32()), pa.array(bodies, pa.binary()), pa.array(["first", "last"])], names=given.names)

    def whole(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(["result"] * n)], names=given.names)

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Results for all but the last document."""
        texts = [t for _, t in held]
        n = np.array([len(t) for t in texts], np.int64)
        kept = n[:-1] - n[:-1] // 2
        taken = np.minimum(n[:-1] // 2, n[1:])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(n)
        starts = ends - n
        at = walk(codes, starts, ends, np.zeros(len(n), np.int64))
        # an edited walk is the text's own for its first half; from there it goes on over the next text's beginning
        edited = np.concatenate([codes[starts[i] : starts[i] + kept[i]] if part == 0 else codes[starts[i + 1] : starts[i + 1] + taken[i]] for i in range(len(kept)) for part in (0, 1)] + [np.zeros(0, "<u4")])
        e_lens = kept + taken
        e_ends = np.cumsum(e_lens)
        e_starts = e_ends - e_lens
        go = _tables()[0]
        classes = _classes(codes)
        turn = np.zeros(len(kept), np.int64)
        some = np.flatnonzero(kept > 0)
        last = starts[:-1][some] + kept[some] - 1
        turn[some] = at[last] + go[classes[last], at[last] & (PERIOD - 1)]
        e_at = walk(edited, e_starts + kept, e_ends, turn)
        for i in some:
            e_at[e_starts[i] : e_starts[i] + kept[i]] = at[starts[i] : starts[i] + kept[i]]
        prints = [fingerprint_one(_nibbles(codes[a:b]), at[a:b]) for a, b in zip(starts, ends, strict=True)]
        e_prints = [fingerprint_one(_nibbles(edited[a:b]), e_at[a:b]) for a, b in zip(e_starts, e_ends, strict=True)]
        shas = [hashlib.sha256(edited[a:b].tobytes().decode("utf-32-le").encode()).hexdigest() for a, b in zip(e_starts, e_ends, strict=True)]
        near = [likeness(a, b) for a, b in zip(prints, e_prints, strict=False)]
        nexts = [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held[:-1]], arrow_id), pa.array(n[:-1]), pa.array(shas, pa.string()), pa.array(prints[:-1], pa.string()), pa.array(e_prints, pa.string()), pa.array(near, pa.float64()), pa.array(nexts, pa.float64())], names=results.names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, *bodies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, after = (zstandard.decompress(x).decode() for x in bodies)
                yield from made([(key, text), (None, after)])

    table = C.written(dealt.mapInArrow(run, given), "edit-ranges", ("what",), codec="zstd")
    ends = table.where(F.col("what") != "result").select(F.col(id_col).alias("_id"), "range", "body", "what")
    ranges = sorted(r[0] for r in ends.where("what = 'first'").select("range").collect())  # at most MOST_PARTS numbers
    after = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range int, next int")
    lasts = ends.where("what = 'last'").select("_id", "range", "body").join(F.broadcast(after), "range")
    firsts = ends.where("what = 'first'").select(F.col("range").alias("next"), F.col("body").alias("next_body"))
    met = lasts.join(firsts, "next").select("_id", "body", "next_body").mapInArrow(meet, results)
    return table.where(F.col("what") == "result").select(*results.names).unionByName(met)


def op3_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_fingerprints over the whole of documents, and near_class: the least doc_id among near duplicates."""
    return with_near_class(edited_fingerprints(C.documents(spark, sf_dir)))


def with_near_class(rows: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """rows (id_col, fingerprint and more) with near_class, the least id among the row's near duplicates (its own, if it
    has none). A fingerprint that a great part of all rows share isn't gathered in one task."""
    near = C.written(near_classes(rows.select(id_col, "fingerprint"), least, id_col).withColumnsRenamed({"class": "_class", "n": "_n"}), "edit-near")
    out = C.join_counted(rows.withColumn("_class", F.xxhash64("fingerprint")), near, "_class", "_n", how="left")
    return out.withColumn("near_class", F.coalesce("near_class", id_col)).drop("_class")
