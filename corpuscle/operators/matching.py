"""Entity matching: first of several, ranked, scored, cascading, reconciling. Ties go by an ordinal, so runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import broadcast_if_few


def first_of(df: DataFrame, by: list[str], order: list, keep: str = "_rank") -> DataFrame:
    """The first row of each group by the order given."""
    return df.withColumn(keep, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(keep) == 1).drop(keep)


def first_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key, that of the smallest ordinal; as an aggregate, so it combines before it shuffles."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), ordinal).alias("_r")).select(key, "_r.*")


def arg_max(df: DataFrame, by: str, value: str, ordinal: str) -> DataFrame:
    """by, value, n: the value that is most frequent in each group; of equal ones the first seen."""
    counted = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("_first"))
    best = counted.groupBy(by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("_b"))
    return best.select(by, f"_b.{value}", "_b.n")


def pick(wanted: DataFrame, pool: DataFrame, *, by: list[tuple[str, str]], prefer: list[Column], ordinal: str, out: list[str]) -> DataFrame:
    """For each row of wanted one of pool: the first join (column of wanted, column of pool) that finds any, then preference, then order.

    wanted has a column _w that names its rows. Columns of both sides must have different names.
    """
    tries = [wanted.join(pool, wanted[a] == pool[b]).withColumn("_pool", F.lit(i)) for i, (a, b) in enumerate(by)]
    found = tries[0]
    for t in tries[1:]:
        found = found.unionByName(t)
    ranked = found.select("_w", "_pool", *[(~p).cast("int").alias(f"_p{i}") for i, p in enumerate(prefer)], ordinal, *[c for c in out if c != ordinal])
    best = ranked.groupBy("_w").agg(F.min_by(F.struct(*out), F.struct("_pool", *[f"_p{i}" for i in range(len(prefer))], ordinal)).alias("_b"))
    return wanted.join(best, "_w", "left").select(*wanted.columns, *[F.col(f"_b.{c}").alias(c) for c in out])


def cascade(wanted: DataFrame, forms: Column, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """wanted with value and at (place of the form that matched): the first form that the dictionary has. wanted has _w."""
    tried = wanted.select("_w", F.posexplode(forms).alias("at", key)).join(dictionary.select(key, value), key)
    best = tried.groupBy("_w").agg(F.min_by(F.struct(value, "at"), "at").alias("_b"))
    return wanted.join(best, "_w", "left").select(*wanted.columns, F.col(f"_b.{value}").alias(value), F.col("_b.at").alias("at"))


def scored(candidates: DataFrame, by: str, score: Column, ordinal: str) -> DataFrame:
    """The best candidate per group by score (then order), with it; whether it is accepted is judged after, on it alone."""
    return first_of(candidates.withColumn("score", score), [by], [F.desc("score"), F.asc(ordinal)])


def reconcile(lemmas: DataFrame, targets: DataFrame, lemma: str, target: str, ordinal: str, forms, fold, blocked: DataFrame | None = None) -> DataFrame:
    """lemma, target (null: none): an equal target, else by each form an equal one or the first with an equal fold.

    A pair that is blocked (columns lemma, target) is dropped; it doesn't fall to the next form.
    """
    asked = lemmas.select(lemma).distinct()
    exact = targets.select(F.col(target).alias("_k"), F.col(target).alias("_t"), F.lit(0).alias("_how"))
    folded = first_wins(targets.select(fold(F.col(target)).alias("_k"), F.col(target).alias("_t"), ordinal), "_k", ordinal).select("_k", "_t", F.lit(1).alias("_how"))
    tried = asked.select(lemma, F.posexplode(forms(F.col(lemma))).alias("_at", "_form"))
    keys = tried.select(lemma, "_at", F.explode(F.array(F.struct(F.lit(0).alias("_how"), F.col("_form").alias("_k")), F.struct(F.lit(1).alias("_how"), fold(F.col("_form")).alias("_k")))).alias("_x")).select(lemma, "_at", "_x.*")
    hits = keys.join(exact.unionByName(folded), ["_how", "_k"]).groupBy(lemma).agg(F.min_by("_t", F.struct("_at", "_how")).alias(target))
    if blocked is not None:
        hits = hits.join(broadcast_if_few(blocked), [lemma, target], "left_anti")
    return asked.join(hits, lemma, "left")


def fallback_lookup(df: DataFrame, table: DataFrame, key: Column, bare: Column, table_key: str, value: str) -> DataFrame:
    """df with value: by the key, else by the bare key."""
    one = table.select(F.col(table_key).alias("_k1"), F.col(value).alias("_v1"))
    two = table.select(F.col(table_key).alias("_k2"), F.col(value).alias("_v2"))
    return df.join(one, key == F.col("_k1"), "left").join(two, bare == F.col("_k2"), "left").withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def family(members: DataFrame, group: str, member: str, order: str, occurring: DataFrame) -> DataFrame:
    """member, family (array in order): the group's other members that occur.

    The occurring members of a group are gathered once, and each member takes itself out, so no pairs are made.
    """
    alive = members.join(occurring.select(member).distinct(), member, "left_semi")
    lists = alive.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, member))), lambda x: x[member]).alias("_all"))
    return members.join(lists, group, "left").select(group, member, F.filter(F.coalesce("_all", F.array()), lambda x: x != F.col(member)).alias("family"))


def allowlist_differences(found: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """key, kind: what is found and not allowed, and what is allowed and not found any more."""
    return found.join(allowed, key, "left_anti").select(key, F.lit("new").alias("kind")).unionByName(allowed.join(found, key, "left_anti").select(key, F.lit("gone").alias("kind")))


def family_sizes(members: DataFrame, group: str, member: str, occurring: DataFrame) -> DataFrame:
    """group, member, n_family, least, greatest: of the group's other members that occur, how many and between what.

    Nothing is listed, so a group may hold a great part of all rows: only the two least and greatest of each go round.
    """
    alive = members.join(occurring.select(member).distinct(), member, "left_semi").select(group, member)
    two = alive.groupBy(group).agg(F.count("*").alias("_n"), F.min(member).alias("_lo"), F.max(member).alias("_hi"))
    inner = alive.join(two.select(group, "_lo", "_hi"), group)
    second = inner.groupBy(group).agg(F.min(F.when(F.col(member) > F.col("_lo"), F.col(member))).alias("_lo2"), F.max(F.when(F.col(member) < F.col("_hi"), F.col(member))).alias("_hi2"))
    told = members.select(group, member).join(alive.select(F.col(member).alias("_alive")), F.col(member) == F.col("_alive"), "left").join(two.join(second, group), group, "left")
    own = F.col("_alive").isNotNull().cast("int")
    other = lambda end, next_one: F.when(F.col(end) == F.col(member), F.col(next_one)).otherwise(F.col(end))
    return told.select(group, member, (F.coalesce("_n", F.lit(0)) - own).alias("n_family"), other("_lo", "_lo2").alias("least"), other("_hi", "_hi2").alias("greatest"))


def overrides_not_applied(found: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """key, wanted, value: curated values that the result doesn't have; null is a value like any other."""
    wanted = overrides.select(key, F.col(value).alias("wanted"))
    return wanted.join(found.select(key, value), key, "left").where(~F.col("wanted").eqNullSafe(F.col(value)))
