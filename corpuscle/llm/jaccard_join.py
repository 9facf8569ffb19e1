"""Exact similarity join of word n-gram sets by Jaccard: universe partition and pigeonhole.

Sets of sizes r <= s link when 100 * |R & S| >= percent * |R | S|, so they differ in at most
H = (1 - t) / (1 + t) * (r + s) elements. Sizes are dealt into bands so narrow that linked sets lie in one band or in
neighbours. In a band's universe (its own sets, and the larger ones of the next band) elements are hashed into H + 1
segments: of two linked sets at least one segment is equal. Segments that say little (of no element or one) are left out
of a set's probe; for each of them one of the band's few chosen segments, the fullest first, is probed with its
one-deletion neighbourhood as well, which pays for it: a probe's allowances always add up to H + 1. One that would have
fewer than two elements more than what it pays for doesn't pay, for a neighbour that is empty itself is what a great part
of a band has. Only if the payers aren't enough is such a segment probed. Every set is indexed under all its segments, so
nothing is lost.

1. One pass over the texts writes, per document, its set's size, a hash (its class: documents with equal sets), a parity
   sketch, and its segment keys. Texts and sets aren't shuffled.
2. Keys are dealt to buckets as sorted, delta-coded rows; each bucket keeps those that two documents share.
3. Sketches (differing parity bits never exceed differing elements) discard pairs of a shared key that can't link. The
   components of what is left are families: every link is within one. Each member of a key is held against the key's
   least one first, then only what that leaves apart against the rest (``components_by_key``).
4. Families' sets are read again from the texts, and verified exactly, each family in one task if it is of bounded size.
   In a family beyond the bound, blocks of members are held against the family's least one; only what isn't linked with
   that is then held against all blocks.

Classes are told apart by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import common as C
from corpuscle.llm.graphs import Forest, components, components_by_key, groups
from corpuscle.llm.substring_dedup import _bucket, _packed, _unpacked

#: Flags of a key: the set probes with it; it is a deletion neighbour; the set belongs to the universe's own band; the set
#: probes its segment with one difference allowed, so that a segment and a deletion neighbour may meet.
PROBE, DELETION, OWN, WIDE = 1, 2, 4, 8
#: Segments of a universe in which payers for segments of one element are counted in: short sets have few to choose from.
SHORT = 100
#: Keys that a task holds at once; keys for each bucket; members and bytes of sets that are verified in one task; ids (and
#: families beyond these bounds) that may be broadcast.
FLUSH, PER_BUCKET, MOST_MEMBERS, MOST_BYTES, MOST_BROADCAST = 1 << 20, 1_500_000, 3000, 48 << 20, 2_000_000


@cache
def bands(percent: int, up_to: int) -> tuple[list[int], list[int]]:
    """Bounds: a band has sizes lo .. hi with hi = floor(lo / t)."""
    lows, highs = [], []
    lo = 1
    while lo <= up_to:
        lows.append(lo)
        highs.append(100 * lo // percent)
        lo = highs[-1] + 1
    return lows, highs


def segments(percent: int, high: int) -> tuple[int, int]:
    """Segments of the universe of a band up to high, and how many of them have deletion neighbours."""
    most = high + 100 * high // percent  # r + s
    m = (100 - percent) * most // (100 + percent) + 1
    per_segment = max(1.0, high * percent / 100 / m)
    idle = m * math.exp(-per_segment) * (1 + per_segment if m <= SHORT else 1)
    return m, min(m, math.ceil(idle + 4 * math.sqrt(idle) + 1))


def set_keys(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's keys and their flags, in the universes of its own band and of the band below."""
    lows, highs = bands(percent, 2 * len(tokens) + 2)
    own = int(np.searchsorted(lows, len(tokens), "right")) - 1
    keys, flags = [], []
    for band in (own, own - 1):
        if band < 0 or band < own and 100 * highs[band] < percent * len(tokens):
            continue
        m, chosen = segments(percent, highs[band])
        mine = OWN if band == own else 0
        with np.errstate(over="ignore"):
            spread = C.mixed(tokens ^ (C.U64(band + 1) * C.GOLDEN))
            at = ((spread >> C.U64(32)) * C.U64(m) >> C.U64(32)).astype(np.int64)
            sums = np.zeros(m, C.U64)
            np.add.at(sums, at, spread)
            place = C.U64(band << 32) + np.arange(m, dtype=C.U64) + C.U64(1)
            salted = C.mixed(place * C.GOLDEN)
            size = np.bincount(at, minlength=m)
            idle, pay = np.argsort(size, kind="stable")[:chosen], np.argsort(-size[:chosen], kind="stable")
            paid = (size[idle] <= 1) & (size[pay] >= size[idle] + 2)
            probed = np.full(m, PROBE)
            probed[idle[paid]] = 0
            probed[pay[paid]] = PROBE | WIDE
            keys.append(C.mixed(sums ^ salted))
            flags.append(probed | mine)
            near = np.flatnonzero(at < chosen)
            if len(near):
                keys.append(C.mixed((sums[at[near]] - spread[near]) ^ salted[at[near]]))
                flags.append(np.where(probed[at[near]] & WIDE, PROBE | WIDE, 0) | DELETION | mine)
    return np.concatenate(keys) >> C.U64(20), np.concatenate(flags).astype(np.uint8)


def sketch_bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def parity_sketch(tokens: np.ndarray) -> bytes:
    """One bit per hash value: whether an odd number of elements have it. As many bits as twice the size, or a few more."""
    bits = sketch_bits(len(tokens))
    return np.packbits(np.bincount((tokens >> C.U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).tobytes()


def _rows_folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one size as rows of 64-bit words, folded to so many."""
    x = np.frombuffer(b"".join(sketches), C.U64).reshape(len(sketches), -1)
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest."""
    short = min(map(len, sketches)) // 8
    return np.concatenate([_rows_folded([s], short) for s in sketches])


def _most_apart(n: np.ndarray, k, percent: int) -> np.ndarray:
    """Elements in which sets of sizes n and k may differ and still link; -1 if their sizes forbid it."""
    h = (100 - percent) * (n + k) // (100 + percent)
    return np.where(100 * np.minimum(n, k) >= percent * np.maximum(n, k), h, -1)


def _tokens(batch_text: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer than k words the whole sequence is the one shingle."""
    data, offsets = C.utf8(batch_text)
    hashes, firsts, _ = C.words(data, offsets, C.NOT_SPACE, C.LOWER)
    rolled, at = C.windows(hashes, firsts, k)
    cut = np.searchsorted(at, firsts)
    short = (np.diff(firsts) > 0) & (np.diff(firsts) < k)
    whole = C.range_hashes(hashes, firsts[:-1], firsts[1:], C.P_WINDOW, C.P_WINDOW_INV)
    return [whole[i : i + 1] if short[i] else np.unique(rolled[cut[i] : cut[i + 1]]) for i in range(len(short))]


def _set_hash(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(C.mixed(np.array([C.mixed(tokens ^ C.GOLDEN).sum(dtype=C.U64) + C.U64(len(tokens))]))[0].astype(np.int64))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """Documents whose sets of k-word shingles are linked: 100 * |intersection| >= percent * |union|.

    Returns per row of docs: id_col (as long), n_shingles, class (hash of the set, null if empty), component_id (the
    smallest id reachable by links, itself included). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer
    than k words are one shingle. With by_row also of (the text's hash: id and of tell rows apart, but for equal ones),
    size (the component's rows; null for an empty set) and kept: whether the row has the component's least id (null
    counts as larger than any), and of these the least hash.

    Defined cases: null or empty text, or text without words, has an empty set: linked with nothing, its own component;
    equal rows link; rows with a null id keep a null id and count as larger than any id; texts with one id are
    documents of their own; an empty table gives an empty table; other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    hashed = docs.select("*", F.xxhash64(text_col).alias("of")) if by_row else docs
    scanned = C.written(hashed.mapInArrow(_scan(k, percent), f"row long, {id_col} long, n_shingles long, class long, sketch binary, keys binary, flags binary{', of long' * by_row}"), "jaccard-documents", codec="zstd")
    this = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("of") if by_row else F.lit(None).cast("long").alias("of"))
    classes = scanned.where("class is not null").groupBy("class").agg(F.min(id_col).alias("first"), F.count("*").alias("_n"), *[F.min(this).alias("_row")] * by_row)
    classes = C.written(classes, "jaccard-counts")

    total = scanned.agg(F.sum(F.octet_length("flags"))).first()[0] or 0
    n_buckets = max(C.shuffle_partitions(spark), -(-total // PER_BUCKET))
    dealt = scanned.where("class is not null").select("row", "class", "keys", "flags").mapInArrow(_deal(n_buckets), "bucket int, keys binary, rows binary, flags binary")
    shared = dealt.repartitionById(n_buckets, F.col("bucket")).mapInArrow(_shared, "key long, row long, flags int")
    shared = C.written(shared, "jaccard-shared")
    kinds = shared.join(scanned.select("row", F.col("class").alias("node")), "row").groupBy("key", "node")
    kinds = kinds.agg(F.bit_or(F.col("flags").bitwiseAND(PROBE | WIDE)).alias("probe"), F.min(F.col("flags").bitwiseAND(DELETION)).alias("deletion"))
    kinds = C.written(kinds.select("key", "node", (F.col("probe") + F.col("deletion")).alias("flags")), "jaccard-kinds")
    C.unwritten(shared)
    # copies are folded before they are shuffled, so the join meets each class once
    sketches = scanned.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sketches = sketches.join(kinds.select(F.col("node").alias("class")).distinct(), "class", "left_semi")
    sketches = C.written(sketches, "jaccard-sketches")
    families = components_by_key(kinds, sketches.withColumnRenamed("class", "node"), lambda pairs: _may_link(pairs, sketches, percent), _compared(percent), PROBE)
    families = C.written(families.withColumnRenamed("node", "class").withColumnRenamed("component", "family"), "jaccard-families")

    # one document of each class brings the set; equal ids with different texts are told apart by the class
    members = families.join(classes.select("class", "first"), "class").select("class", "family", "first")
    n_members = members.count()
    ids = members.select(F.col("first").alias("_id")).distinct()
    some = docs.join(F.broadcast(ids) if n_members <= MOST_BROADCAST else ids, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    sets = some.mapInArrow(_sets(k), "class long, n_bytes long, tokens binary").dropDuplicates(["class"])
    sets = C.written(members.select("class", "family").join(sets, "class"), "jaccard-sets", codec="uncompressed")
    links = _verified(sets, percent, n_buckets)
    found = components(C.written(links, "jaccard-links")).select(F.col("node").alias("class"), "component")
    found = C.written(found, "jaccard-found")
    linked = classes.join(found, "class")
    more = [F.sum("_n").alias("size"), F.min("_row").alias("_least")] * by_row
    least = C.written(linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_classes"), *more), "jaccard-components")
    named = C.join_counted(linked, least, "component", "_classes")
    alone = classes.join(found, "class", "left_anti").withColumns({"component_id": F.col("first"), **({"size": F.col("_n"), "_least": F.col("_row")} if by_row else {})})
    columns = ["class", "_n", "component_id", *["size", "_least"] * by_row]
    by_class = named.select(*columns).unionByName(alone.select(*columns))
    rows = scanned.select(id_col, "n_shingles", "class", *["of"] * by_row)
    rows = C.join_counted(rows, C.written(by_class, "jaccard-classes"), "class", "_n").unionByName(rows.where("class is null"), allowMissingColumns=True)
    more = ["of", "size", F.coalesce(this == F.col("_least"), F.lit(True)).alias("kept")] if by_row else []
    return rows.select(id_col, "n_shingles", "class", F.coalesce("component_id", id_col).alias("component_id"), *more)


def _compared(percent: int):
    """Which members (flags, n, sketch) of a key sketches don't rule out: one of two probes, with a difference allowed if
    one is a deletion neighbour, and not both are."""

    def compare(rows: list[tuple]):
        flags, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        sketches = _folded([r[2] for r in rows])

        def near(i: int, others: np.ndarray) -> np.ndarray:
            either, both = flags[i] | flags[others], flags[i] & flags[others]
            may = (np.where(either & DELETION, either & WIDE, either & PROBE) > 0) & (both & DELETION == 0)
            apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(1, dtype=np.int64)
            return may & (apart <= _most_apart(n[others], n[i], percent))

        return near

    return compare


def _may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that sketches don't rule out."""
    one, other = (sketches.toDF(c, f"n_{c}", f"sketch_{c}") for c in "ab")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            s_a, s_b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            by_size: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(s_a, s_b, strict=True)):
                by_size.setdefault((len(x), len(y)), []).append(i)
            apart = np.empty(len(n_a), np.int64)
            for (size_a, size_b), some in by_size.items():
                to = min(size_a, size_b) // 8
                x, y = (_rows_folded([s[i] for i in some], to) for s in (s_a, s_b))
                apart[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            keep = pa.array(np.flatnonzero(apart <= _most_apart(n_a, n_b, percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(near, "a long, b long")


def _verified(sets: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """Verified links (a, b) that connect, within each family, what its exact links connect. sets: class, family, n_bytes, tokens."""
    sizes = sets.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_bytes").alias("n_bytes"), F.min("class").alias("lead"))
    n_blocks = F.ceil(F.greatest(F.col("members") / MOST_MEMBERS, F.col("n_bytes") / MOST_BYTES)).cast("int")
    large = C.written(sizes.select("family", "lead", n_blocks.alias("n_blocks")).where("n_blocks > 1"), "jaccard-large")
    n_large = large.count()
    links = sets.select("family", F.lit(0).alias("i"), F.lit(0).alias("j"), "class", F.lit(True).alias("asked"), F.lit(True).alias("held"), "tokens")
    if not n_large:
        return _by_blocks(links, percent, n_buckets)
    some = F.broadcast(large) if n_large <= MOST_BROADCAST else large
    links = _by_blocks(links.join(some, "family", "left_anti"), percent, n_buckets)

    # blocks against the least member
    rows = sets.join(some, "family").withColumn("j", F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int"))
    leads = large.join(sets.select(F.col("class").alias("lead"), F.col("tokens").alias("lead_tokens")), "lead")
    leads = leads.select("family", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("j"), "lead_tokens")
    told = rows.join(leads, ["family", "j"]).select("family", "n_blocks", "j", "class", "lead", "tokens", "lead_tokens")
    told = C.written(told.mapInArrow(_near_lead(percent), "family long, n_blocks int, j int, class long, lead long, near boolean"), "jaccard-told")
    links = links.unionByName(told.where("near and class <> lead").select(F.col("class").alias("a"), F.col("lead").alias("b")))
    strays = told.where("not near").groupBy("family").agg(F.ceil(F.count("*") / MOST_MEMBERS).cast("int").alias("stray_blocks"))
    strays = C.written(strays, "jaccard-strays")
    n_strays = strays.count()
    if not n_strays:
        return links
    told = told.join(F.broadcast(strays) if n_strays <= MOST_BROADCAST else strays, "family")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = told.withColumn("i", F.explode(upto("stray_blocks"))).withColumns({"asked": F.lit(False), "held": F.lit(True)})
    asked = told.where("not near").withColumn("i", F.pmod(F.xxhash64("class", F.lit(1)), F.col("stray_blocks")).cast("int"))
    asked = asked.withColumn("j", F.explode(upto("n_blocks"))).withColumns({"asked": F.lit(True), "held": F.lit(False)})
    columns = ["family", "i", "j", "class", "asked", "held"]
    laid = held.select(*columns).unionByName(asked.select(*columns)).join(sets.select("class", "tokens"), "class")
    return links.unionByName(_by_blocks(laid.select(*columns, "tokens"), percent, n_buckets))


def _by_blocks(laid: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """Links between the asked and the held sets of each (family, i, j)."""
    placed = laid.repartition(n_buckets, "family", "i", "j").sortWithinPartitions("family", "i", "j", "class")
    return placed.mapInArrow(_verify(percent), "a long, b long")


def _near_lead(percent: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)
            linked = [_linked(np.frombuffer(x, C.U64), np.frombuffer(y, C.U64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(linked, pa.bool_())], names=["family", "n_blocks", "j", "class", "lead", "near"])

    return near


def _scan(k: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in _text_slices(batches):
            tokens = _tokens(batch.column(1), k)
            keys = [set_keys(t, percent) if len(t) else None for t in tokens]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), pa.array([len(t) for t in tokens], pa.int64()), pa.array([_set_hash(t) if len(t) else None for t in tokens], pa.int64()), pa.array([parity_sketch(t) if len(t) else None for t in tokens], pa.binary()), pa.array([x and x[0].tobytes() for x in keys], pa.binary()), pa.array([x and x[1].tobytes() for x in keys], pa.binary()), *batch.columns[2:]],
                names=["row", batch.schema.names[0], "n_shingles", "class", "sketch", "keys", "flags", *batch.schema.names[2:]],
            )
            row += n

    return scan


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from C.slices(iter([batch]), batch.schema.names[1], 1 << 20)


def _deal(n_buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, flags, size, seen = [], [], [], 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            key, row, flag = np.concatenate(keys), np.concatenate(rows), np.concatenate(flags)
            order = np.argsort(key, kind="stable")
            key, row, flag = key[order], row[order], flag[order]
            edges = np.searchsorted(_bucket(key << C.U64(20), n_buckets), np.arange(n_buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            low = row.min()
            for some in np.array_split(full, max(1, len(full) // 512)):
                parts = [(int(b), slice(edges[b], edges[b + 1])) for b in some]
                near = [np.concatenate([[low], row[s] - low]).astype(np.int64) for _, s in parts]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([_packed(key[s]) for _, s in parts], pa.binary()), pa.array([_plain(x) for x in near], pa.binary()), pa.array([flag[s].tobytes() for _, s in parts], pa.binary())], names=["bucket", "keys", "rows", "flags"])

        for batch in batches:
            for row, kind, key, flag in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind in seen:  # a copy of a set that this task has dealt
                    continue
                seen.add(kind)
                keys.append(np.frombuffer(key, C.U64))
                flags.append(np.frombuffer(flag, np.uint8))
                rows.append(np.full(len(flag), row, np.int64))
                size += len(flag)
                if size >= FLUSH:
                    yield from out()
                    keys, rows, flags, size = [], [], [], 0
        if size:
            yield from out()

    return deal


def _plain(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplain(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.int64).ravel()
    return x[1:] + x[0]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's keys those with an own set and two rows that a probe lets meet, without neighbours that nothing may meet."""
    blobs = [b for batch in batches for b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
    if not blobs:
        return
    key = np.concatenate([_unpacked(a) for a, _, _ in blobs])
    row = np.concatenate([_unplain(b) for _, b, _ in blobs])
    flag = np.concatenate([np.frombuffer(c, np.uint8) for _, _, c in blobs])
    del blobs
    order = np.argsort(key, kind="stable")
    key, row, flag = key[order], row[order], flag[order]
    del order
    groups = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    reach = lambda f, x: f.reduceat(x, groups)
    is_near = flag & DELETION > 0
    whole, near = (reach(np.bitwise_or, np.where(x, flag, 0)) for x in (~is_near, is_near))
    wholes, all_ = reach(np.add, (~is_near).astype(np.int32)), reach(np.bitwise_or, flag)
    meet = (wholes > 1) & (whole & PROBE > 0) | (wholes > 0) & (near > 0) & (all_ & WIDE > 0)
    use = meet & (all_ & OWN > 0) & (reach(np.minimum, row) < reach(np.maximum, row))
    of = np.repeat(np.arange(len(groups), dtype=np.int32), np.diff(np.append(groups, len(key))))
    hit = use[of] & (~is_near | (flag & WIDE > 0) | (whole & WIDE > 0)[of])
    key, row, flag = key[hit].astype(np.int64), row[hit], flag[hit].astype(np.int32)
    for lo in range(0, len(key), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(row[s]), pa.array(flag[s])], names=["key", "row", "flags"])


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_slices(batches):
            tokens = [t for t in _tokens(batch.column(1), k) if len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_hash(t) for t in tokens], pa.int64()), pa.array([8 * len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["class", "n_bytes", "tokens"])

    return sets


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def link_sets(tokens: list[np.ndarray], percent: int, asked: np.ndarray | None = None, held: np.ndarray | None = None) -> Forest:
    """Exact components of sorted sets, by verified links between the asked and the held ones (all, if not given).
    Sketches order and discard; sets decide."""
    forest = Forest()
    n = np.array([len(t) for t in tokens])
    s = _folded([parity_sketch(t) for t in tokens])
    every = np.arange(len(tokens))
    held = every if held is None else np.flatnonzero(held)
    for i in every if asked is None else np.flatnonzero(asked):
        others = held[:i] if asked is None else held[held != i]
        apart = np.bitwise_count(s[others] ^ s[i]).sum(1, dtype=np.int64)
        may = np.flatnonzero(apart <= _most_apart(n[others], n[i], percent))
        for j in others[may[np.argsort(apart[may], kind="stable")]]:
            if forest.root(i) != forest.root(j) and _linked(tokens[i], tokens[j], percent):
                forest.join(int(i), int(j))
    return forest


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 3):
            kinds, tokens = [x[0] for x in rows], [np.frombuffer(x[3], C.U64) for x in rows]
            asked, held = (np.array([x[k] for x in rows], bool) for k in (1, 2))
            forest = link_sets(tokens, percent) if asked.all() and held.all() else link_sets(tokens, percent, asked, held)
            roots = [forest.root(i) for i in range(len(rows))]
            tied = [i for i, r in enumerate(roots) if r != i]
            yield pa.RecordBatch.from_arrays([pa.array([kinds[i] for i in tied], pa.int64()), pa.array([kinds[roots[i]] for i in tied], pa.int64())], names=["a", "b"])

    return verify


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components over the whole of documents: 3-word shingles, 90 of 100."""
    return jaccard_components(C.documents(spark, sf_dir), k=3, percent=90).select("doc_id", "n_shingles", "component_id")
