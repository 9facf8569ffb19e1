"""Registered queries of entries and words as a reader sees them: word info, Greek entries, many keys, side tables, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import morphology
from corpuscle.operators import lexicon, postings, quality, vocabulary
from corpuscle.plans.applied import ACCENT, MAQAF, SOF, gr, gr_sql, he, he_sql
from corpuscle.plans.catalogue import _events
from corpuscle.plans.registry import ORACLES, query
from corpuscle.session import shared_folder
from corpuscle.sources import readers, writers
from corpuscle.streaming.vocabulary import stream_vocabulary, write_then_notify

WORDS_SQL = "list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '')"


def _words(c: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z ]", ""), " "), lambda w: w != "")


# ---- words


@query(f"""with w as (select conv_id, turn, {WORDS_SQL} as w from conversations), r as (select conv_id, turn, w, unnest([0, 2, 5]) as i from w), p as (select conv_id, turn, i, w[i + 1] as x from r where len(w) > i),
    h as (select conv_id as book, turn as v, i, 'he' as lang, {he_sql('x')} as printed, replace({he_sql('x')}, '{ACCENT}', '') as form, case when i = 5 then null when i = 2 then null else (conv_id % 90)::varchar end as lex_id,
      case when i = 5 then null when i = 2 then 'preposition' else 'noun' end as pos, case when i = 5 then null when i = 2 then '' else 'masculine singular · absolute' end as features, i = 2 as prefix_only from p where conv_id % 2 = 0),
    g as (select conv_id as book, turn as v, i, 'gr' as lang, {gr_sql('x')} as printed, {gr_sql('x')} as form, {gr_sql('x')} as lex_id, 'noun' as pos, 'genitive plural feminine' as features, false as prefix_only from p where conv_id % 2 = 1)
    select *, lang || ':' || lex_id as key from (select * from h union all select * from g)""")
def word_info(t):
    """Q-W: a lemma's word, a prefix alone and one that isn't aligned, in Hebrew and in Greek; places without a word go."""
    rows = t.conversations.select(F.col("conv_id").alias("book"), F.lit(1).alias("ch"), F.col("turn").alias("v"), _words("text").alias("w"))
    token = lambda lemma, code: F.struct(lemma.alias("lemma"), F.lit(code).alias("code"))
    number = (F.col("book") % 90).cast("string")
    tokens = F.transform("w", lambda w, i: F.when(i == 5, None).when(i == 2, token(F.lit("b"), "HR")).otherwise(token(number, "HNcmsa")))
    hebrew_verses = rows.where("book % 2 = 0").select("book", "ch", "v", he(F.array_join("w", " ")).alias("text"), tokens.alias("tokens"))
    greek_token = lambda w: F.struct(F.concat(F.lit("("), gr(w), F.lit(",")).alias("printed"), gr(w).alias("lemma"), F.lit("N-").alias("pos"), F.lit("----GPF-").alias("parse"))
    greek_verses = rows.where("book % 2 = 1").select("book", "ch", "v", F.transform("w", greek_token).alias("tokens"))
    refs = rows.select("book", "ch", "v", F.explode(F.array(*map(F.lit, (0, 2, 5)))).alias("i"))
    return lexicon.word_info(refs, hebrew_verses, greek_verses).drop("ch")


NOUNS, GENDERS, NUMBERS, STATES = "cpg", "mfbc", "spd", "acd"
VERBS, STEMS, PERSONS = "pqiwhjvrsac", "qNphHt", "123"


def _letter(letters: str, of: Column) -> Column:
    return F.substring(F.lit(letters), (of % len(letters) + 1).cast("int"), F.lit(1))


def _letter_sql(letters: str, of: str) -> str:
    return f"substr('{letters}', ({of}) % {len(letters)} + 1, 1)"


def _named_sql(table: dict[str, str], letter: str) -> str:
    return f"case {letter} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


@query(f"""with f as (select l_orderkey as a, l_partkey as b, l_suppkey as c, l_linenumber as d from lineitem),
    l as (select {_letter_sql(NOUNS, 'a')} as n, {_letter_sql(GENDERS, 'b')} as g, {_letter_sql(NUMBERS, 'c')} as m, {_letter_sql(STATES, 'd')} as s, {_letter_sql(STEMS, 'a')} as st, {_letter_sql(VERBS, 'b')} as v, {_letter_sql(PERSONS, 'c')} as p from f),
    x as (select *, {_named_sql(morphology.GENDER, 'g')} as gn, {_named_sql(morphology.NUMBER, 'm')} as mn, {_named_sql(morphology.STATE, 's')} as sn, {_named_sql(morphology.STEM, 'st')} as stn, {_named_sql(morphology.VERB_TYPE, 'v')} as vn, {_named_sql(morphology.NOUN_TYPE, 'n')} as nn from l),
    c as (select 'HN' || n || g || m || s as code, nn as pos, gn || ' ' || mn || ' · ' || sn as features from x
      union all select 'HV' || st || v || case when v in ('r', 's') then g || m || s when v in ('a', 'c') then '' else p || g || m end, 'verb', stn || ' · ' || vn || case when v in ('r', 's') then ' · ' || gn || ' ' || mn || ' · ' || sn when v in ('a', 'c') then '' else ' · ' || p || g || m end from x)
    select code, pos, features, count(*)::bigint as n from c group by all""")
def morphology_from_data(t):
    """Nouns and verbs of all stems, types, persons, genders, numbers and states, as the order lines have them."""
    a, b, c, d = (F.col(f"l_{x}") for x in ("orderkey", "partkey", "suppkey", "linenumber"))
    g, m, s, v = _letter(GENDERS, b), _letter(NUMBERS, c), _letter(STATES, d), _letter(VERBS, b)
    tail = F.when(v.isin("r", "s"), F.concat(g, m, s)).when(v.isin("a", "c"), "").otherwise(F.concat(_letter(PERSONS, c), g, m))
    codes = F.array(F.concat(F.lit("HN"), _letter(NOUNS, a), g, m, s), F.concat(F.lit("HV"), _letter(STEMS, a), v, tail))
    counted = t.lineitem.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    decoded = counted.withColumn("d", morphology.decode_hebrew(F.lit("1"), F.col("code")))
    return decoded.select("code", F.col("d.pos").alias("pos"), F.col("d.features").alias("features"), "n")


@query(f"""with h as (select conv_id, turn, {WORDS_SQL} as w from conversations), m as (select conv_id, turn, w, unnest(range(len(w))) as i from h)
    select conv_id, turn, i::int as i, {he_sql('w[i + 1]')} as core, i % 3 = 0 and i < len(w) - 1 as maqaf, i = len(w) - 1 as sof from m""")
def maqaf_pieces(t):
    """Q-T, Q2: each third word is joined to the next by a maqaf, the last one ends the verse; as many pieces as words."""
    w = _words("text")
    joined = F.array_join(F.transform(w, lambda x, i: F.concat(he(x), F.when(i == F.size(w) - 1, SOF).when(i % 3 == 0, MAQAF).otherwise(" "))), "")
    return t.conversations.select("conv_id", "turn", F.posexplode(lexicon.verse_pieces(joined)).alias("i", "p")).select("conv_id", "turn", "i", "p.*")


# ---- entries


@query(f"""with l as (select p_partkey as k, p_size, p_name, p_type, p_brand, {gr_sql("replace(p_name, ' ', '') || 'a'")} as lemma from part where p_partkey % 2 = 0),
    f as (select *, case when k % 7 = 0 then 'curated ' || k when k % 3 = 0 then 'descendant ' || k when k % 5 = 0 then p_brand when k % 11 > 0 then '{{a}} ' || p_brand else '' end as gloss from l)
    select k::varchar as num, gloss, case when k % 7 = 0 then 'curated' when k % 3 = 0 then 'short' when k % 5 = 0 then 'scholarly' when k % 11 > 0 then 'numbers' end as gloss_source, case when k % 3 = 0 and k % 7 = 0 then 'descendant ' || k end as long,
      case when k % 11 > 0 then 'a ' || p_brand end as definition, case when k % 11 > 0 and k % 4 = 0 then 'x' || k end as translit_taken, p_size as n, case when k % 5 = 0 then k end as septuagint_n from f""")
def greek_entries(t):
    """J20, G8, G14 and Q-P: entries of Greek lemmas from six sources, each with some of them."""
    k = F.col("p_partkey")
    lemma = F.concat(gr(F.replace("p_name", F.lit(" "), F.lit(""))), gr(F.translate(k.cast("string"), "0123456789", "abcdefghij")), F.lit("α")).alias("lemma")
    rows, num = t.part.where("p_partkey % 2 = 0"), k.cast("string").alias("num")
    typo = F.concat(F.lit("descendent "), k.cast("string"))
    told = F.when(k % 4 == 0, lemma).otherwise(F.lit("ἄλλο"))
    numbers = rows.where("p_partkey % 11 > 0").select(num, told.alias("n_lemma"), F.concat(F.lit("x"), k.cast("string")).alias("translit"), F.concat(F.lit(" {a}  "), "p_brand").alias("strongs_def"), F.col("p_type").alias("kjv_def"), F.lit(" ").alias("derivation"))
    short = rows.where("p_partkey % 3 = 0").select(num, typo.alias("brief"), typo.alias("long"))
    scholarly = rows.where("p_partkey % 5 = 0").select(lemma, F.array("p_brand").alias("glosses"), F.lit("<b>x</b>").alias("html"), F.array().cast("array<string>").alias("hebrew"))
    curated = rows.where("p_partkey % 7 = 0").select(lemma, F.concat(F.lit("curated "), k.cast("string")).alias("g"))
    septuagint = rows.where("p_partkey % 5 = 0").select(lemma, k.alias("n"))
    made = lexicon.assembled_greek(rows.select(lemma, num, F.col("p_size").alias("n")), numbers, short, scholarly, curated, septuagint)
    return made.select("num", "gloss", "gloss_source", "long", "definition", F.when(F.col("translit").startswith("x"), F.col("translit")).alias("translit_taken"), "n", "septuagint_n")


@query(f"""with c as (select l_partkey as k, count(*)::bigint as n from lineitem group by 1) select k as id, {he_sql('p_name')} as lemma, coalesce(case when k % 3 > 0 then p_brand end, case when k % 2 = 0 then 'x' || k end) as xlit,
      case when k % 2 = 0 then 'pron ' || k end as pron, case when k % 2 = 0 then p_type end as derivation, case when k % 5 = 0 then '<b>' || k || '</b>' end as html, n from c join part on p_partkey = k""")
def inherited_entries(t):
    """What a number's dictionary says is taken where it tells of the same consonants."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    lemmas = t.part.select(k.alias("id"), k.alias("num"))
    index = t.part.select(k.alias("id"), he(F.col("p_name")).alias("w"), F.when(k % 3 > 0, F.col("p_brand")).alias("xlit"), F.lit("noun").alias("pos"), F.when(k % 5 == 0, text).alias("bdb"))
    other = F.when(k % 2 == 0, he(F.translate("p_name", "aeiou", "eeeee"))).otherwise("אב")  # other vowels, the same consonants
    numbers = t.part.select(k.alias("num"), other.alias("n_lemma"), F.concat(F.lit("x"), text).alias("n_xlit"), F.concat(F.lit("pron "), text).alias("pron"), F.col("p_type").alias("derivation"))
    outline = t.part.select(text.alias("bdb"), F.concat(F.lit("<b>"), text, F.lit("</b>")).alias("html"))
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    return lexicon.assembled(lemmas, index, numbers, outline, counts).select("id", "lemma", "xlit", "pron", "derivation", "html", "n")


@query("select 'he' as lang, (k // 300)::varchar as shard, k::varchar as id, p_name as told from (select unnest([x * 3, x * 3 + 100000000]) as k from (select distinct l_suppkey as x from lineitem)) left join part on p_partkey = k")
def many_entries(t):
    """Entries of many keys, those that aren't there too."""
    rows = t.part.select(F.lit("he").alias("lang"), postings.number_shard(F.col("p_partkey")).alias("shard"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("told"))
    path = shared_folder(t.spark, "entries")
    writers.write_shards(rows, path)
    k = F.col("l_suppkey") * 3
    keys = t.lineitem.select(F.explode(F.array(k, k + 100000000)).alias("k")).distinct()
    wanted = keys.select(F.lit("he").alias("lang"), postings.number_shard(F.col("k")).alias("shard"), F.col("k").cast("string").alias("id"))
    return readers.dictionary_entries(t.spark, path, wanted).select("lang", F.col("shard").cast("string").alias("shard"), "id", "told")


@query("""select 'b' || (p_partkey % 5) as section, 'e' || p_partkey as entry, p_partkey < 5 as is_root, p_name as w, p_type as def from part""")
def read_outline(t):
    """Sections with entries, in one file; the first entry of a section that is a root is its root."""
    k = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_partkey") < 6, F.lit(' type="root"')).otherwise("")
    entry = F.concat(F.lit('<entry id="e'), k, F.lit('"'), kind, F.lit("><w>"), "p_name", F.lit("</w><def>"), "p_type", F.lit("</def></entry>"))
    sections = t.part.groupBy((F.col("p_partkey") % 5).alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("x")))), lambda e: e["x"]), "").alias("body"))
    path = shared_folder(t.spark, "outline")
    sections.select(F.concat(F.lit('<section id="b'), F.col("s").cast("string"), F.lit('">'), "body", F.lit("</section>")).alias("value")).write.text(path)
    return readers.outline(t.spark, path).select("section", "entry", "is_root", "w", F.get("defs", 0).alias("def"))


# ---- context, side tables, counts


@query("""select user_id as book, case event_id % 3 when 1 then '' when 2 then event_type end as context, count(*)::bigint as n from events group by all""")
def context_of_words(t):
    """Renderings that are loaded beside the words; a word may have none, or be rendered with another."""
    at = [F.col("user_id").alias("book"), F.col("event_id").alias("ch"), F.lit(1).alias("v"), F.lit(0).alias("i")]
    path = shared_folder(t.spark, "context")
    shown = F.when(F.col("event_id") % 3 == 1, "").otherwise(F.col("event_type"))
    t.events.where("event_id % 3 > 0").select(*at, shown.alias("context")).write.parquet(path)
    loaded = readers.with_context(t.events.select(*at), t.spark.read.parquet(path))
    return loaded.groupBy("book", "context").agg(F.count("*").alias("n"))


@query("""with s as (select unnest(['new', 'recognized', 'familiar', 'known', 'automatic']) as status), r as (select lang, case when n_chars % 3 = 0 then 'new' when n_chars % 3 = 1 then 'known' else 'familiar' end as status from documents),
    l as (select distinct lang from r union all select null) select l.lang, s.status, (select count(*) from r where (l.lang is null or r.lang = l.lang) and r.status = s.status)::bigint as n from l, s""")
def status_cube(t):
    """A10, by language and in all, zeros too."""
    status = F.when(F.col("n_chars") % 3 == 0, "new").when(F.col("n_chars") % 3 == 1, "known").otherwise("familiar")
    return vocabulary.status_counts(t.documents.select(F.coalesce("lang", F.lit("")).alias("lang"), status.alias("status")), "lang").select("lang", "status", "n")


@query("""select 'statistics' as "table", l_returnflag as key, count(*)::bigint as n from lineitem group by l_returnflag union all select 'conflicts', l_linestatus, count(*) from lineitem where l_discount > 0.05 group by l_linestatus""")
def diagnostics(t):
    """K6: a run's side tables, each in a folder of its name."""
    path = shared_folder(t.spark, "diagnostics")
    counts = lambda df, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    writers.write_diagnostics({"statistics": counts(t.lineitem, "l_returnflag"), "conflicts": counts(t.lineitem.where("l_discount > 0.05"), "l_linestatus")}, path)
    read = lambda name: t.spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("table"), "key", "n")
    return read("statistics").unionByName(read("conflicts"))


@query("""with w as (select doc_id, lang, len(list_filter(string_split(text, ' '), lambda x: x <> '')) as n from documents) select 'missing' as gate, count(*) filter (where n % 10 = 7)::bigint as n from w union all select 'too many', count(*) filter (where n % 10 = 3)::bigint from w""")
def slot_counts(t):
    """Q2: one slot for each word; a verse with fewer or more breaks a gate."""
    n = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    rows = t.documents.select(n.alias("words"), (n - F.when(n % 10 == 7, 1).when(n % 10 == 3, -1).otherwise(0)).alias("slots"))
    return quality.violations({"missing": (rows, F.col("slots") < F.col("words")), "too many": (rows, F.col("slots") > F.col("words"))})


# ---- the state machine on a stream


@query(ORACLES["vocab_fold"])
def streamed_vocabulary(t):
    """V1-V3, V6, V9: the events as a stream in parts, in their order; states are written, and only then told of.
    A part's files are all there before its stream begins, so they are one micro-batch, in which events are put in order."""
    source, sink, told = shared_folder(t.spark, "vocabulary-in"), shared_folder(t.spark, "vocabulary-out"), []
    events = _events(t)
    half = events.agg(F.percentile_approx("at", 0.5)).first()[0]
    for part, rows in enumerate((events.where(F.col("at") <= half), events.where(F.col("at") > half))):
        rows.write.parquet(f"{source}/part={part}")
        stream = stream_vocabulary(t.spark.readStream.schema(events.schema).parquet(f"{source}/*"))
        run = write_then_notify(stream, lambda batch, p=part: batch.withColumn("part", F.lit(p)).write.mode("append").parquet(sink), told.append, f"{sink}-checkpoint")
        run.processAllAvailable()
        run.stop()
    if not told:
        raise RuntimeError("no batch was told of")
    return _last_states(t.spark.read.parquet(sink))


def _last_states(states: DataFrame) -> DataFrame:
    rest = [c for c in states.columns if c != "key"]
    last = states.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("part", "updated_at", "lookups", "encounters")).alias("s")).select("key", "s.*")
    return last.select("key", "status", "lookups", "encounters", F.size("forms").cast("long").alias("n_forms"), F.size("chapters").cast("long").alias("n_chapters"), "promoted")
