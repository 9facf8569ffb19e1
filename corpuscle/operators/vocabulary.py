"""A reader's vocabulary: one state per word key, changed by events in order.

Kinds of events: lookup, encounter (once per key and visit), status (set it), known (the rest of a chapter is known).
fold_event() is the one transition; the streaming form (corpuscle.streaming.vocabulary) applies it to stored state. The
batch form says the same as maps of statuses that Spark composes, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import kept

#: Statuses by rank.
STATUSES = ["new", "recognized", "familiar", "known", "automatic"]
MOST_FORMS = 40
STATE = "key string, status string, lookups long, encounters long, forms array<string>, chapters array<string>, first_lookup_at long, last_lookup_at long, created_at long, updated_at long, status_changed_at long, gloss string, promoted long"


@dataclass(frozen=True)
class Settings:
    """After how many encounters a word counts as known (0: never); whether a lookup makes a word recognized."""

    auto_known_after: int = 4
    lookup_marks_recognized: bool = True


def fresh(key: str, at: int, gloss: str | None) -> dict:
    return {"key": key, "status": "new", "lookups": 0, "encounters": 0, "forms": [], "chapters": [], "first_lookup_at": None, "last_lookup_at": None, "created_at": at, "updated_at": at, "status_changed_at": at, "gloss": gloss or "", "promoted": 0}


def _set_status(state: dict, status: str, at: int) -> None:
    state["status"], state["status_changed_at"] = status, at


def fold_event(state: dict | None, event: dict, settings: Settings) -> dict | None:
    """The state after an event (kind, key, at, form, chapter, status, gloss); None while the key is unknown."""
    kind, at = event["kind"], event["at"]
    is_new = state is None
    if is_new:
        # an unknown key isn't made by setting its status, nor by an encounter while automatic promotion is off
        if kind == "status" or kind == "encounter" and not settings.auto_known_after:
            return None
        state = fresh(event["key"], at, event.get("gloss"))
    if kind == "status" and event["status"] not in STATUSES:
        return state
    if kind == "lookup":
        state["lookups"] += 1
        state["last_lookup_at"] = at
        form, chapter = event.get("form"), event.get("chapter")
        if form and form not in state["forms"] and len(state["forms"]) < MOST_FORMS:
            state["forms"] = [*state["forms"], form]
        if chapter and chapter not in state["chapters"]:
            state["chapters"] = [*state["chapters"], chapter]
        if state["first_lookup_at"] is None:
            state["first_lookup_at"] = at
        state["gloss"] = state["gloss"] or event.get("gloss") or ""
        if settings.lookup_marks_recognized and state["status"] in ("new", "automatic"):
            _set_status(state, "recognized", at)
    elif kind == "encounter":
        state["encounters"] += 1
        # a key that an encounter made waits for its next one
        if not is_new and settings.auto_known_after and state["status"] == "new" and not state["lookups"] and state["encounters"] >= settings.auto_known_after:
            _set_status(state, "automatic", at)
            state["promoted"] += 1
    elif kind == "status":
        _set_status(state, event["status"], at)
    elif kind == "known":
        if is_new:
            state["encounters"] = 1
        elif state["status"] != "new" or state["lookups"]:
            return state
        _set_status(state, "automatic", at)
    state["updated_at"] = at
    return state


#: Events of a key that are folded in one row, and maps of blocks that are.
BLOCK = 1024


def fold_vocabulary(events: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One state row per key from events (key, kind, at long, seq long, form, chapter, status, gloss), in order of (at, seq).

    It is what fold_event makes of each key's events, without folding them one by one. Events are dealt by ranges of (key, at,
    seq) and numbered, so a key with very many events lies in many blocks of BLOCK events. What an event does to the
    status is a map of the five statuses, once it is known how many lookups and encounters came before: sums over blocks
    tell. Maps compose, so each block becomes one map, blocks of blocks become one, and a key's last map, from its first
    event on, tells its status. All else are counts, firsts and lasts, which combine before they are shuffled.

    Events whose key, kind or time is null, and statuses that aren't among STATUSES, do nothing.
    """
    settings = settings or Settings()
    columns = {"key": "string", "kind": "string", "at": "long", "seq": "long", "form": "string", "chapter": "string", "status": "string", "gloss": "string"}
    have = [(F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
    told = events.select(*have).where("key is not null and at is not null").where(F.col("kind").isin("lookup", "encounter", "known") | F.col("status").isin(STATUSES) & (F.col("kind") == "status"))
    order = ["key", "at", "seq"]
    rows = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    rows = kept(rows.withColumn("block", F.floor(F.col("n") / BLOCK)), "vocabulary-events")
    live = _since_made(rows, settings)
    made = F.col("n") == F.col("made")
    lookup, encounter = F.col("kind") == "lookup", F.col("kind") == "encounter"

    counted = live.groupBy("key").agg(
        F.count_if(lookup).alias("lookups"), F.count_if(encounter | (made & (F.col("kind") == "known"))).alias("encounters"),
        F.min_by(F.when(lookup, F.col("at")), F.when(lookup, F.col("n"))).alias("first_lookup_at"), F.max_by(F.when(lookup, F.col("at")), F.when(lookup, F.col("n"))).alias("last_lookup_at"),
        F.min_by("at", "n").alias("created_at"), F.min_by("gloss", F.when((made | lookup) & (F.col("gloss") != ""), F.col("n"))).alias("gloss"),
    )
    last = _composed(live, settings).select("key", F.col("map")[0].alias("m"))
    out = counted.join(last, "key").join(_distinct_in_order(live, "form", "forms", MOST_FORMS), "key", "left").join(_distinct_in_order(live, "chapter", "chapters"), "key", "left")
    empty = F.array().cast("array<string>")
    fields = {
        "status": F.get(F.array(*map(F.lit, STATUSES)), F.col("m.to")), "forms": F.coalesce("forms", empty), "chapters": F.coalesce("chapters", empty), "updated_at": F.col("m.updated"),
        "status_changed_at": F.col("m.changed"), "gloss": F.coalesce("gloss", F.lit("")), "promoted": F.col("m.promoted"),
    }
    names = [part.split()[0] for part in STATE.split(", ")]
    return out.select(*[fields.get(c, F.col(c)).alias(c) for c in names])


def _since_made(rows: DataFrame, settings: Settings) -> DataFrame:
    """The events from each key's first one on that makes it (n = made), with the lookups and encounters before their block.

    A key's blocks are far fewer than its events: only they meet by key.
    """
    makes = F.col("kind").isin(["lookup", "known", *(["encounter"] if settings.auto_known_after else [])])
    blocks = rows.groupBy("key", "block").agg(F.min(F.when(makes, F.col("n"))).alias("made"), F.count_if(F.col("kind") == "lookup").alias("lookups"), F.count_if(F.col("kind") == "encounter").alias("encounters"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = blocks.select("key", "block", F.min("made").over(whole).alias("made"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lookups", "encounters")])
    return kept(rows.join(told, ["key", "block"]).where("n >= made"), "vocabulary-live")


def _composed(live: DataFrame, settings: Settings) -> DataFrame:
    """key, map: what all of a key's events do to each status (the first event makes it, whatever was before)."""
    here = Window.partitionBy("key", "block").orderBy("n")
    earlier = F.sum((F.col("kind") == "lookup").cast("int")).over(here.rowsBetween(Window.unboundedPreceding, -1))
    met = F.sum((F.col("kind") == "encounter").cast("int")).over(here)
    fresh_yet = F.col("lookups_before") + F.coalesce(earlier, F.lit(0)) == 0  # never looked up
    due = F.lit(settings.auto_known_after > 0) & (F.col("encounters_before") + met >= settings.auto_known_after)
    new, recognized, automatic = (STATUSES.index(x) for x in ("new", "recognized", "automatic"))
    # an event as: from which statuses it leads (a bit each) and where to, whether it counts although nothing changes, whether it promotes
    only_new, any_status, looked_at = 1 << new, (1 << len(STATUSES)) - 1, 1 << new | 1 << automatic
    kind, made, marks = F.col("kind"), F.col("n") == F.col("made"), settings.lookup_marks_recognized
    given = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int") - 1
    made_as = F.when(kind == "known", automatic).when((kind == "lookup") & F.lit(marks), recognized).otherwise(new)
    leads = F.when(made | (kind == "status"), any_status).when(kind == "lookup", looked_at if marks else 0).when((kind == "encounter") & fresh_yet & due, only_new).when((kind == "known") & fresh_yet, only_new).otherwise(0)
    to = F.when(made, made_as).when(kind == "status", given).when(kind == "lookup", recognized).otherwise(automatic)
    event = F.struct("n", F.col("at"), leads.alias("leads"), to.cast("int").alias("to"), (made | (kind != "known")).alias("counts"), (~made & (kind == "encounter")).alias("promotes"))
    each = live.select("key", "block", event.alias("e"))

    nothing = F.lit(None).cast("long")
    stay = F.array(*[_step(F.lit(i), nothing, nothing, F.lit(0)) for i in range(len(STATUSES))])
    after = lambda one: lambda done, e: F.transform(done, lambda d: one(d, e))

    def by_event(d, e):
        moves = F.call_function("shiftright", e["leads"], d["to"]).bitwiseAND(F.lit(1)) == 1
        return _step(F.when(moves, e["to"]).otherwise(d["to"]), F.when(moves, e["at"]).otherwise(d["changed"]), F.when(moves | e["counts"], e["at"]).otherwise(d["updated"]), d["promoted"] + (moves & e["promotes"]).cast("int"))

    def by_map(d, e):
        m = F.get(e["map"], d["to"])
        return _step(m["to"], F.coalesce(m["changed"], d["changed"]), F.coalesce(m["updated"], d["updated"]), d["promoted"] + m["promoted"])

    maps = each.groupBy("key", "block").agg(F.array_sort(F.collect_list("e")).alias("es")).select("key", "block", F.aggregate("es", stay, after(by_event)).alias("map"))
    maps = kept(maps, "vocabulary-maps")
    while maps.groupBy("key").count().where("count > 1").limit(1).count():
        groups = maps.groupBy("key", F.floor(F.col("block") / BLOCK).alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("es"))
        maps = kept(groups.select("key", F.col("up").alias("block"), F.aggregate("es", stay, after(by_map)).alias("map")), "vocabulary-maps")
    return maps


def _step(to: Column, changed: Column, updated: Column, promoted: Column) -> Column:
    """What becomes of a status: where it leads, when it last changed and was last touched (null: not here), promotions."""
    return F.struct(to.cast("int").alias("to"), changed.cast("long").alias("changed"), updated.cast("long").alias("updated"), promoted.cast("long").alias("promoted"))


def _distinct_in_order(live: DataFrame, value: str, out: str, most: int | None = None) -> DataFrame:
    """key, out: a lookup's different values that aren't empty, in order of their first events; the first ``most`` of them."""
    firsts = live.where((F.col("kind") == "lookup") & (F.coalesce(value, F.lit("")) != "")).groupBy("key", value).agg(F.min("n").alias("n"))
    if most is not None:
        firsts = firsts.withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy("n"))).where(F.col("_rank") <= most)
    return firsts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", value))), lambda x: x[value]).alias(out))


def _frame(states: list[dict]) -> pd.DataFrame:
    names = [part.split()[0] for part in STATE.split(", ")]
    out = pd.DataFrame(states, columns=names)
    for c in ("first_lookup_at", "last_lookup_at"):
        out[c] = out[c].astype("Int64")
    return out


def counters(events: DataFrame) -> DataFrame:
    """Lookups and encounters per key, by aggregation alone: they don't depend on the order."""
    return events.groupBy("key").agg(F.count_if(F.col("kind") == "lookup").alias("lookups"), F.count_if(F.col("kind") == "encounter").alias("encounters"), F.max("at").alias("last_at"))


def encounters(words: DataFrame) -> DataFrame:
    """One encounter event per key and visit from the words read (visit, key, at): a chapter's repeated words count once."""
    return words.groupBy("visit", "key").agg(F.min("at").alias("at")).withColumn("kind", F.lit("encounter"))


def chapter_progress(visits: DataFrame) -> DataFrame:
    """Per book and ch: done (ever), visits (those that didn't end it), last_at. Doesn't depend on the order."""
    return visits.groupBy("book", "ch").agg(F.bool_or("done").alias("done"), F.count_if(~F.col("done")).alias("visits"), F.max("at").alias("last_at"))


def last_positions(positions: DataFrame) -> DataFrame:
    """The latest position per book; of equal times the greatest (ch, v)."""
    return positions.groupBy("book").agg(F.max_by(F.struct("ch", "v", "at"), F.struct("at", "ch", "v")).alias("p")).select("book", "p.*")


def status_of(keys: DataFrame, states: DataFrame) -> DataFrame:
    """keys with status; a key without a state is new."""
    return keys.join(states.select("key", "status"), "key", "left").withColumn("status", F.coalesce("status", F.lit("new")))


def status_counts(states: DataFrame, lang_col: str | None = None) -> DataFrame:
    """How many keys have each status, zeros too; by language and in all if lang_col is given (null: all)."""
    spark = states.sparkSession
    dim = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "status string, rank int"))
    if lang_col is None:
        return dim.join(states.groupBy("status").count(), "status", "left").select("status", "rank", F.coalesce("count", F.lit(0)).alias("n"))
    counted = states.cube(lang_col, "status").agg(F.count("*").alias("n"), F.grouping("status").alias("g")).where("g = 0").drop("g")
    langs = states.select(lang_col).distinct().unionByName(spark.createDataFrame([(None,)], f"{lang_col} string"))
    all_rows = langs.crossJoin(dim)  # languages x five statuses
    return all_rows.join(counted, all_rows[lang_col].eqNullSafe(counted[lang_col]) & (all_rows["status"] == counted["status"]), "left").select(all_rows[lang_col], all_rows["status"], "rank", F.coalesce("n", F.lit(0)).alias("n"))


def visible_since(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first event of each group: what happens once per visit."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")
