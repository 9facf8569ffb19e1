"""Connected components of an edge table, and of rows that share keys. Nothing is sent to the driver but counts.

Nodes and keys of any degree: least neighbours are found by aggregates that combine before they shuffle, and reach their
rows by ``C.join_counted``, which broadcasts the few of great degree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common as C

#: Strays, and members, of a key that are compared in one task; rows that are Python objects at once.
BLOCK, SLICE = 512, 256


def _with_least(rows: DataFrame, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (u, v), at most n, with m, the least v of their u; and what was written for it, to be deleted later."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if n <= C.MOST_HEAVY:
        return C.join_counted(rows, least, "u", "n", at_most=n), []
    least = C.written(least, "least", rows=n)
    return C.join_counted(rows, least, "u", "n"), [least]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an undirected edge table; component is the smallest node that it reaches.

    Alternating large and small stars. Every round writes its edges to the shared folder and deletes the last one's.
    Rounds grow with the logarithm of the longest path; a star (all copies tied to one) is done in two.

    Defined cases: an edge of a node with itself says nothing; repeated edges count once; no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = C.written(now, "edges")
    n, seen = now.count(), None
    while n:
        both, least = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        large = C.written(large.distinct(), "edges", rows=n)
        for table in (now, *least):
            C.unwritten(table)
        small, least = _with_least(large, n)
        turned = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = small.select(F.inline(turned)).where("u <> v").distinct()
        now = C.written(small, "edges", rows=2 * n)
        for table in (large, *least):
            C.unwritten(table)
        n, mixed = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mixed) == seen:
            break
        seen = (n, mixed)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows that come in order of their first n_keys columns, without these, by these."""
    now, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                if row[:n_keys] != now:
                    if held:
                        yield held
                    now, held = row[:n_keys], []
                held.append(row[n_keys:])
    if held:
        yield held


class Forest:
    """Union-find over any values that have an order; the root is the least."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    def join(self, x, y) -> bool:
        """Whether that tied together what wasn't."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


#: Given the rows (flags, payload ...) of some members: which of others are linked with the member i.
Compare = Callable[[list[tuple]], Callable[[int, np.ndarray], np.ndarray]]


def components_by_key(members: DataFrame, payloads: DataFrame, judge: Callable[[DataFrame], DataFrame], compare: Compare, probe: int = 0) -> DataFrame:
    """(node, component) of the graph of all pairs that share a key and are linked; nodes without a link have no row.

    members: a written table (key, node, flags) in which each key has a node once. payloads: a written table (node, ...)
    of what tells whether two are linked. judge keeps, of pairs (a, b) whatever their flags, those that are linked;
    compare says the same of members held in memory, and may let flags forbid a pair in its key. probe: bits of flags of
    which each pair that compare lets pass has one at a member at least; 0 if flags don't say so.

    First each member is judged against its key's least node: a pair for each member, whatever the key's size. What that
    connects needs no further look. Then, in keys whose members are in more than one component, each member outside the
    key's largest component is compared with all members of others, or, if these are fewer, each member that probes: so
    every pair that could join two components is looked at, and a key of many copies costs its size times its strays or
    probes. That is done in memory, a block of those that ask with a block of members at a time, so no pairs are made
    and a key of any size is spread; a key of one block takes each of its members once.

    Defined cases: keys of one member say nothing; with no members, or no linked pair, there are no rows.
    """
    n = members.count()
    keys = members.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    keys = C.written(keys, "keys", rows=n)
    star = C.join_counted(members.select("key", "node"), keys, "key", "n", at_most=n).where("node <> lead")
    star = C.written(star.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "pairs", rows=n)
    first = C.written(components(judge(star)), "components", rows=n)

    # keys whose members aren't all connected by now
    rows = C.join_counted(members, keys.drop("lead"), "key", "n", at_most=n).join(first, "node", "left")
    rows = C.written(rows.withColumn("component", F.coalesce("component", "node")), "members", rows=n)
    probes = F.col("flags").bitwiseAND(probe) != 0 if probe else F.lit(True)
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.count_if(probes).alias("probes")).groupBy("key")
    mixed = parts.agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("largest"), F.sum("probes").alias("probes"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    strays = F.col("n") - F.col("largest")
    mixed = mixed.where("parts > 1 and probes > 0").select("key", "main", "n", (F.col("probes") < strays).alias("by_probe"), blocks(F.col("n")).alias("n_blocks"), blocks(F.least("probes", strays)).alias("asked_blocks"))
    mixed = C.written(mixed, "mixed-keys", rows=n)
    rows = C.join_counted(rows, mixed, "key", "n", at_most=n)
    asks = F.when(F.col("by_probe"), probes).otherwise(F.col("component") != F.col("main"))
    place = lambda salt, c: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    at = lambda i, j, asked, held: F.struct(i.alias("i"), j.alias("j"), asked.alias("asked"), held.alias("held"))
    yes, no = F.lit(True), F.lit(False)
    held = F.transform(upto("asked_blocks"), lambda i: at(i, place(1, "n_blocks"), no, yes))
    asked = F.transform(upto("n_blocks"), lambda j: at(place(2, "asked_blocks"), j, yes, no))
    laid = F.when(F.col("n_blocks") == 1, F.array(at(F.lit(0), F.lit(0), asks, yes))).when(asks, F.concat(held, asked)).otherwise(held)
    payload = [c for c in payloads.columns if c != "node"]
    laid = rows.withColumn("laid", laid).join(payloads, "node").select("key", "component", "flags", *payload, F.inline("laid"))
    laid = laid.select("key", "i", "j", "asked", "held", "component", "flags", *payload)
    laid = laid.repartition(C.shuffle_partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        a, b = [], []
        for some in groups(batches, 3):
            asked, others = (np.flatnonzero([r[k] for r in some]) for k in (0, 1))
            if not len(asked) or not len(others):
                continue
            near = compare([r[3:] for r in some])
            for i in asked:
                apart = np.array([forest.root(some[j][2]) != forest.root(some[i][2]) for j in others], bool)
                for j in others[apart][near(i, others[apart])] if apart.any() else ():
                    if forest.join(some[i][2], some[j][2]):
                        a.append(some[i][2])
                        b.append(some[j][2])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    linked = C.written(laid.mapInArrow(run, "a long, b long").distinct(), "edges")
    for table in (star, keys, mixed):
        C.unwritten(table)
    if linked.isEmpty():
        return first
    # components of components; a component's name is its least node
    again = C.written(components(linked), "components", rows=2 * linked.count())
    joined = first.join(again.toDF("component", "_to"), "component", "left")
    joined = joined.select("node", F.coalesce("_to", "component").alias("component"))
    return joined.unionByName(again.join(first.select("node"), "node", "left_anti"))
