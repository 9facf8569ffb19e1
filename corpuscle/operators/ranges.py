"""Range rules, interval islands, forward fill and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import kept


#: Rules that may be broadcast; levels of dyadic blocks.
MOST_RULES, LEVELS = 100_000, 63


def first_rule(rows: DataFrame, rules: DataFrame, equal: list[str], place: str, key: str) -> DataFrame:
    """rows with the columns of the first rule that matches, null where none does.

    rules: equal columns, rule_no, lo, hi, and others; a rule matches where the equal columns are equal and place is in
    lo .. hi. Up to MOST_RULES rules are broadcast: the equal columns make it a hash join, and the range is a filter on
    it. More rules go by dyadic blocks (``first_rule_by_blocks``), which needs no broadcast and compares no pairs.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        return first_rule_by_blocks(rows, rules, equal, place)
    rest = [c for c in rules.columns if c not in equal]
    hits = rows.select(key, place, *equal).join(F.broadcast(rules.select(*equal, *rest)), equal).where(F.col(place).between(F.col("lo"), F.col("hi")))
    best = hits.groupBy(key).agg(F.min_by(F.struct(*rest), "rule_no").alias("_r"))
    return rows.join(best, key, "left").select(*rows.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _shift(c: Column, bits: Column) -> Column:
    """floor(c / 2 ** bits) of a long, negative ones too."""
    return F.call_function("shiftright", c, bits)


def _top_level(lo: Column, end: Column) -> Column:
    """A block isn't longer than its range: no level beyond the length's logarithm (and one, as that is rounded) has any."""
    return F.least(F.floor(F.log2((end - lo).cast("double"))).cast("int") + 1, F.lit(LEVELS - 1))


def _blocks_at(lo: Column, end: Column, k: Column) -> Column:
    """array<long>: the blocks of level k, null for none; the first and the last that aren't part of one of the next level."""
    first, behind = -_shift(-lo, k), _shift(end, k)  # of the blocks of this level that lie within the range
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
    # blocks whose pair isn't within the range as a whole; all others are part of a block of the next level
    left = F.when((first < behind) & odd(first), first)
    right = F.when((F.when(odd(first), first + 1).otherwise(first) < behind) & odd(behind), behind - 1)
    return F.array(left, right)


def dyadic_blocks(lo: Column, hi: Column) -> Column:
    """array<struct<level,block>>: a range of integers as blocks of 2 ** level numbers that don't overlap, two a level at most."""
    lo, end = lo.cast("long"), hi.cast("long") + 1
    at = lambda k: F.transform(F.array_compact(_blocks_at(lo, end, k)), lambda b: F.struct(k.alias("level"), b.alias("block")))
    return F.when(end > lo, F.flatten(F.transform(F.sequence(F.lit(0), _top_level(lo, end)), at))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def with_blocks(rules: DataFrame, keep: list[str]) -> DataFrame:
    """keep, _level, _block: a row for each of the dyadic blocks of lo .. hi, as dyadic_blocks has them, by plain columns."""
    ends = rules.where("lo <= hi").select(*keep, F.col("lo").cast("long").alias("_lo"), (F.col("hi").cast("long") + 1).alias("_end"))
    levels = ends.select("*", F.explode(F.sequence(F.lit(0), _top_level(F.col("_lo"), F.col("_end")))).alias("_level"))
    return levels.select(*keep, "_level", F.explode(_blocks_at(F.col("_lo"), F.col("_end"), F.col("_level"))).alias("_block")).where("_block is not null")


def first_rule_by_blocks(rows: DataFrame, rules: DataFrame, equal: list[str], place: str) -> DataFrame:
    """first_rule for rule tables of any size. A range is a few dyadic blocks, of rules that share a block only the first
    counts, and a place lies in one block of each level: so it's a join by equality with one rule a block at most.

    Only different places are looked up, on as many levels as the rules have; till a place's first rule is known, rules
    are their numbers. Neither side of a join is broadcast, as Spark guesses sizes from before rows are exploded. Ranges
    end below 2 ** 62.
    """
    rest = [c for c in rules.columns if c not in equal]
    tree = kept(with_blocks(rules, [*equal, "rule_no"]).groupBy(*equal, "_level", "_block").agg(F.min("rule_no").alias("_no")), "rule-blocks")
    levels = sorted(r[0] for r in tree.select("_level").distinct().collect())  # 63 at most
    p = F.col(place).cast("long")
    places = rows.select(*equal, p.alias("_p")).dropna().distinct()
    if not levels:
        return rows.select("*", *[F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in rest])
    asked = places.select("*", F.explode(F.array(*map(F.lit, levels))).alias("_level")).withColumn("_block", _shift(F.col("_p"), F.col("_level")))
    hits = asked.hint("merge").join(tree.hint("merge"), [*equal, "_level", "_block"])
    first = hits.groupBy(*equal, "_p").agg(F.min("_no").alias("rule_no"))
    # numbers may repeat: of the first one's rules, one that matches
    told = first.hint("merge").join(rules.hint("merge"), [*equal, "rule_no"]).where(F.col("_p").between(F.col("lo"), F.col("hi")))
    best = told.groupBy(*equal, "_p").agg(F.min(F.struct(*rest)).alias("_r"))
    found = rows.withColumn("_p", p).hint("merge").join(best.hint("merge"), [*equal, "_p"], "left")
    return found.select(*rows.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def shifted(place: Column, lo: Column, to: Column) -> Column:
    """Where a run of rules puts a place: to is where lo goes; without a rule it stays."""
    return F.coalesce(to + (place - lo), place)


def titled(place: Column, offset: Column) -> Column:
    """A verse number where the other side counts offset verses of a title as its first verse."""
    return F.when(offset <= 0, place).when(place <= offset, F.lit(1)).otherwise(place - offset)


def islands(df: DataFrame, by: list[str], start: str, end: str, order: list[str] | None = None, out: str = "island") -> DataFrame:
    """df with the number (from 1) of the run of overlapping intervals that each row is in, per group, by start.

    An interval that begins at or before the greatest end so far belongs to the run.
    """
    order = order or [start, end]
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with the latest value so far that isn't null, per group."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def segments_after(df: DataFrame, by: list[str], order: list[str], ends: Column, out: str = "segment") -> DataFrame:
    """df with the number (from 0) of its segment: a new one begins after each row that ends one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(ends.cast("int")).over(w), F.lit(0)))


def running_offset(df: DataFrame, by: list[str], order: list[str], size: Column, out: str = "offset") -> DataFrame:
    """df with the sum of the sizes before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))


def walk_chain(links: DataFrame, starts: DataFrame, node: str, next_node: str, stop: DataFrame | None = None) -> DataFrame:
    """start, node, step: who comes after whom from each start, until a stop, a link that leads nowhere, or a seen node.

    By doubling: round k knows every walk's first 2 ** k nodes and where each node is 2 ** k steps on, so a chain of any
    length takes as many rounds as its length has bits. Each round's tables are written. Of several links of one node
    the least counts. No nodes or no starts give no rows.
    """
    jump = links.where(F.col(next_node).isNotNull()).groupBy(F.col(node).alias("_a")).agg(F.min(next_node).alias("_b"))
    jump = jump.join(links.select(F.col(node).alias("_b")).distinct(), "_b", "left_semi").select("_a", "_b")
    if stop is not None:
        jump = jump.join(stop.select(F.col(node).alias("_b")), "_b", "left_anti").select("_a", "_b")
    jump = kept(jump, "chain-jumps")
    known = starts.select(F.col(node).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("step"))
    known = kept(known, "chain-walks")
    size, further, n = 1, True, known.count()
    while further:
        ahead = known.join(jump, F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node"), (F.col("step") + size).alias("step"))
        # a walk that comes round again meets nodes that it has: their first step stays
        known = kept(known.unionByName(ahead).groupBy("start", "node").agg(F.min("step").alias("step")), "chain-walks")
        on = jump.select(F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        jump = kept(jump.join(on, "_b").select("_a", F.col("_c").alias("_b")), "chain-jumps")
        before, n = n, known.count()
        further, size = n > before, 2 * size
    return known


def range_scan(spans: DataFrame, rows: DataFrame, by: list[str], lo: str, hi: str, place: str, width: int = 16) -> DataFrame:
    """Each span (by, lo, hi, and others) with the rows of its group (by, place, and others) whose place lies in it.

    Spans are cut at multiples of width and joined with rows of their stretch, so a group of many spans and rows doesn't
    pair them all: a span meets at most width rows for each stretch beside those that it holds.
    """
    cut = spans.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    met = cut.join(rows.withColumn("_stretch", F.floor(F.col(place) / width)), [*by, "_stretch"])
    return met.where(F.col(place).between(F.col(lo), F.col(hi))).drop("_stretch")
