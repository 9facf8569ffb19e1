"""The registered queries over the driver's tables, each an application of this package's operators, and the same in
DuckDB's SQL where SQL can say it. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import greek, hebrew, markup, morphology, references
from corpuscle.operators import alignment, lexicon, matching, postings, quality, ranges, sanitize, search, spelling, vocabulary
from corpuscle.plans.registry import ORACLES, QUERIES, TOKENS, query  # noqa: F401

# ---- text


@query("select doc_id, len(w)::bigint as n_words, len(t)::bigint as n_tokens from (select doc_id, list_filter(regexp_split_to_array(text, '[ -]+'), lambda x: x <> '') as w, list_filter(string_split(text, ' '), lambda x: x <> '') as t from documents)")
def content_words(t):
    words = hebrew.content_words(F.translate("text", "-", hebrew.MAQAF))
    return t.documents.select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(hebrew.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("select lang, count(distinct w)::bigint as n_folded, count(*)::bigint as n from (select lang, unnest(regexp_split_to_array(strip_accents(lower(text)), '[ \\n]+')) as w from documents) where w <> '' group by lang")
def fold_base(t):
    words = t.documents.select("lang", F.explode(F.split(greek.fold(F.col("text")), "[ \n]+")).alias("w")).where("w <> ''")
    return words.groupBy("lang").agg(F.countDistinct("w").alias("n_folded"), F.count("*").alias("n"))


@query("select lang, count(distinct w)::bigint as n_folded, count(distinct o)::bigint as n_words from (select lang, unnest(regexp_split_to_array(text, '[ \\n]+')) as o, strip_accents(o) as w from documents) where o <> '' group by lang")
def fold_case_sensitive(t):
    words = t.documents.select("lang", F.explode(F.split("text", "[ \n]+")).alias("o")).where("o <> ''")
    return words.groupBy("lang").agg(F.countDistinct(greek.fold_case_sensitive(F.col("o"))).alias("n_folded"), F.countDistinct("o").alias("n_words"))


@query(r"""select lead, trail, count(*)::bigint as n, count(distinct word)::bigint as n_words from (
    select regexp_extract(w, '^([(\[«‹“‘⟦]*)', 1) as lead, regexp_extract(w, '([⟧)\]»›”’.,;·:!?—–-]*)$', 1) as trail,
      substr(w, length(lead) + 1, greatest(length(w) - length(lead) - length(trail), 0)) as word
    from (select unnest(string_split(text, ' ')) as w from documents) where w <> '') group by all""")
def split_printed(t):
    words = t.documents.select(F.explode(hebrew.tokens(F.col("text"))).alias("w")).select(greek.split_printed(F.col("w")).alias("s"))
    return words.groupBy("s.lead", "s.trail").agg(F.count("*").alias("n"), F.countDistinct("s.word").alias("n_words"))


@query(r"select p_partkey, case when regexp_matches(x, '^[0-9]+( [a-z])?$') then x end as lemma_id from (select p_partkey, regexp_replace(list_last(string_split('c/' || p_size || case when p_partkey % 3 = 0 then ' a' when p_partkey % 3 = 1 then '+' else 'x' end, '/')), '\+$', '') as x from part)")
def lemma_id(t):
    code = F.concat(F.lit("c/"), F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, " a").when(F.col("p_partkey") % 3 == 1, "+").otherwise("x"))
    return t.part.select("p_partkey", hebrew.lemma_id(code).alias("lemma_id"))


@query("""select code, count(*)::bigint as n, case substr(code, 2, 1) when 'P' then 'present' when 'A' then 'aorist' end || ' · active · indicative · ' || substr(code, 1, 1) || case substr(code, 1, 1) when '1' then 'st' when '2' then 'nd' else 'rd' end || case substr(code, 6, 1) when 'S' then ' singular' else ' plural' end as features
    from (select (l_linenumber % 3 + 1) || case when l_quantity < 25 then 'P' else 'A' end || 'AI-' || case when l_returnflag = 'N' then 'S' else 'P' end || '--' as code from lineitem) group by code""")
def decode_greek(t):
    code = F.concat((F.col("l_linenumber") % 3 + 1).cast("string"), F.when(F.col("l_quantity") < 25, "P").otherwise("A"), F.lit("AI-"), F.when(F.col("l_returnflag") == "N", "S").otherwise("P"), F.lit("--"))
    counted = t.lineitem.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    return counted.select("code", "n", morphology.decode_greek(F.lit("V-"), F.col("code"))["features"].alias("features"))


@query("""select code, count(*)::bigint as n, case substr(code, 4, 1) when 'p' then 'Piʿel' else 'Qal' end || ' · ' || case substr(code, 5, 1) when 'p' then 'perfect' else 'imperfect' end || ' · ' || substr(code, 6) as features, 1::bigint as n_prefixes
    from (select 'C/V' || case when l_tax < 0.04 then 'p' else 'q' end || case when l_discount < 0.05 then 'p' else 'i' end || (l_linenumber % 3 + 1) || 'ms' as code from lineitem) group by code""")
def decode_hebrew(t):
    code = F.concat(F.lit("C/V"), F.when(F.col("l_tax") < 0.04, "p").otherwise("q"), F.when(F.col("l_discount") < 0.05, "p").otherwise("i"), (F.col("l_linenumber") % 3 + 1).cast("string"), F.lit("ms"))
    counted = t.lineitem.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    told = morphology.decode_hebrew(F.lit("c/559"), F.concat(F.lit("H"), F.col("code")))
    return counted.select("code", "n", told["features"].alias("features"), F.size(told["prefixes"]).cast("long").alias("n_prefixes"))


# ---- references


@query(r"""with p as (select page_id, regexp_extract(url, '([a-z]+)[^a-z0-9]*([0-9]+)?$', 1) as word, try_cast(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) as int) as num from pages)
    select page_id, case when num between 1 and 100 then 'Site' end as book, case when num between 1 and 100 then num end as ch from p""")
def parse_ref(t):
    canon = t.rows([("Site", "he", "Site", "All", [9] * 100, 0)], "id string, lang string, en string, section string, verses array<int>, idx int")
    aliases = t.rows([("page", "Site")], "alias string, id string")
    pages = t.pages.select("page_id", F.concat(F.lit("page "), F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1)).alias("ref"))
    pages = pages.withColumn("ref", F.when(F.col("ref") != "page ", F.col("ref")))
    return references.parse_refs(pages, "ref", canon, aliases).select("page_id", "book", "ch")


@query("""select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else 'Order' || ' ' || (o_orderkey % 5 + 1) || case when o_orderkey % 2 = 0 then ':' || (o_orderkey % 9 + 1) else '' end end as label, (o_orderkey % 7 <> 0 and o_orderkey % 5 + 1 <= 4)::boolean as valid from orders""")
def ref_label(t):
    key = F.col("o_orderkey")
    en, ch, v = F.when(key % 7 != 0, "Order"), key % 5 + 1, F.when(key % 2 == 0, key % 9 + 1)
    verses = F.when(key % 7 != 0, F.array(*[F.lit(9)] * 4))
    return t.orders.select("o_orderkey", references.ref_label(en, F.lit("X"), ch, v).alias("label"), references.valid_ref(verses, ch).alias("valid"))


@query("select o_orderkey, lag(o_orderkey) over w as prev, lead(o_orderkey) over w as next from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def adjacent(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"))


@query("""with c as (select n_nationkey, n_regionkey, unnest(range(1, n_nationkey % 4 + 2)) as ch from nation)
    select n_nationkey::int as book, ch::int as ch, (lead(n_nationkey * 100 + ch) over w)::int as next_ref, (lag(n_nationkey * 100 + ch) over w)::int as prev_ref from c window w as (partition by n_regionkey order by n_nationkey, ch)""")
def chapter_neighbours(t):
    canon = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("lang"), F.col("n_nationkey").alias("idx"), F.array_repeat(F.lit(9), F.col("n_nationkey") % 4 + 1).alias("verses"))
    ref = lambda c: F.col(f"{c}.book") * 100 + F.col(f"{c}.ch")
    return references.chapters(canon).select("book", "ch", ref("next").alias("next_ref"), ref("prev").alias("prev_ref"))


# ---- index and aggregation


@query(f"""with w as (select doc_id, unnest({TOKENS}) as token, unnest(range(len({TOKENS}))) as i from documents)
    select token, count(*)::bigint as n, min(doc_id) as first_doc, arg_min(i, struct_pack(d := doc_id, i := i))::bigint as first_i, max(doc_id) as last_doc from w group by token""")
def concordance(t):
    rows = postings.occurrences(t.documents, "doc_id", postings.ascii_tokens(F.col("text")))
    out = postings.first_and_last(rows, "token", ["doc_id", "i"])
    return out.select("token", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.i").cast("long").alias("first_i"), F.col("last.doc_id").alias("last_doc"))


@query("select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey")
def first_wins(t):
    return matching.first_wins(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey").alias("ordinal")), "o_custkey", "ordinal").drop("ordinal")


@query("""select user_id, event_type, n from (select user_id, event_type, count(*)::bigint as n, min(struct_pack(t := ts, e := event_id)) as f from events group by all)
    qualify row_number() over (partition by user_id order by n desc, f) = 1""")
def argmax_tie(t):
    ordinal = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * 1_000_000_000 + F.col("event_id")
    return matching.arg_max(t.events.withColumn("ordinal", ordinal), "user_id", "event_type", "ordinal")


@query("""select prev, event_type, count(*)::bigint as n from (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) where prev is not null group by all""")
def pair_counts(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return postings.pair_counts(t.events.withColumn("prev", F.lag("event_type").over(w)).where("prev is not null"), "prev", "event_type")


@query("""select lang, source, count(*)::bigint as words, count(l.doc_id)::bigint as own, (count(*) filter (where l.doc_id is null and d.doc_id % 2 = 0))::bigint as joint, (count(*) filter (where l.doc_id is null and d.doc_id % 2 = 1))::bigint as none,
    round(count(*) filter (where l.doc_id is not null or d.doc_id % 2 = 0) / count(*), 3)::double as coverage from documents d left join labels l using (doc_id) group by rollup(lang, source)""")
def coverage_rollup(t):
    rows = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("own")), "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return postings.coverage(rows, ["lang", "source"], F.lit(1), F.col("own"), ((F.col("own") == 0) & (F.col("doc_id") % 2 == 0)).cast("int"))


@query("""select count(*)::bigint as words, count(l.doc_id)::bigint as own, (floor(count(l.doc_id) * 10000 / count(*) + 0.5) / 100)::double as percent from documents d left join labels l using (doc_id)""")
def coverage_total(t):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("own")), "doc_id", "left")
    return rows.agg(F.count("*").alias("words"), F.count("own").alias("own")).withColumn("percent", postings.percent(F.col("own"), F.col("words")))


@query(f"""with w as (select unnest({TOKENS}) as token from documents), d as (select distinct translate(token, 'abcdefghijklmnopqrstuvwxyz', 'αβχδεφγηιξκλμνοπψρστυωζθυσ') as token from w), l as (select substr(token, 1, 1) as letter, count(*) as n from d group by 1),
    s as (select token, case when l.n > 320 then substr(token, 1, 2) else letter end as shard from d join l on letter = substr(token, 1, 1))
    select shard, count(*)::bigint as n from s group by shard""")
def letter_split(t):
    """Q-H: shards by the first letter, by two where more than 320 begin with it."""
    words = t.documents.select(F.explode(postings.ascii_tokens(F.col("text"))).alias("w")).distinct()
    words = words.select(greek.fold_letters(F.translate("w", "abcdefghijklmnopqrstuvwxyz", "άβχδέφγηίξκλμνόπψρστύωζθυς")).alias("token")).distinct()
    split = [r[0] for r in postings.frequent(words.select(F.substring("token", 1, 1).alias("letter")), "letter", 320).collect()]  # an alphabet at most
    return words.groupBy(greek.first_letters(F.col("token"), split).alias("shard")).agg(F.count("*").alias("n"))


@query("select (o_orderkey // 300)::bigint as shard, count(*)::bigint as n from orders group by 1")
def int_shard(t):
    return t.orders.groupBy(postings.number_shard(F.col("o_orderkey")).alias("shard")).agg(F.count("*").alias("n"))


@query("select distinct 'he' as lang, (o_orderkey // 3000)::bigint as shard from orders")
def shard_manifest(t):
    return postings.manifest(t.orders.select(F.struct(F.lit("he").alias("lang"), postings.number_shard(F.col("o_orderkey"), 3000).alias("shard")).alias("s")), "s").select("s.*")


@query("""select k || '/he-' || s as path from (select distinct o_orderkey // 3000 as s from orders), (select unnest(['lex', 'conc']) as k) union all select 'gr/' || n_name from nation union all select unnest(['index.json', 'canon.json'])""")
def data_files(t):
    shards = t.orders.select(F.lit("he").alias("lang"), postings.number_shard(F.col("o_orderkey"), 3000).alias("shard")).distinct()
    return postings.data_files(shards, t.nation.select(F.lit("gr").alias("lang"), F.col("n_name").alias("book")), ["index.json", "canon.json"])


@query("""with f as (select p_type, p_brand, min(p_partkey) as o from part group by all), r as (select *, row_number() over (partition by p_type order by o) as n from f)
    select p_type, string_agg(p_brand, ', ' order by o) as gloss from r where n <= 3 group by p_type""")
def distinct_gloss(t):
    firsts = t.part.groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("o"))
    listed = firsts.groupBy("p_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "p_brand"))), lambda x: x["p_brand"]).alias("g"))
    return listed.select("p_type", postings.distinct_in_order(F.col("g")).alias("gloss"))


@query("""with d as (select unnest(['new', 'recognized', 'familiar', 'known', 'automatic']) as status), e as (select case event_type when 'click' then 'recognized' when 'view' then 'new' when 'purchase' then 'known' else 'other' end as status from events)
    select d.status, count(e.status)::bigint as n from d left join e using (status) group by d.status""")
def status_zero_filled(t):
    status = F.coalesce(morphology.lookup({"click": "recognized", "view": "new", "purchase": "known"}, F.col("event_type")), F.lit("other"))
    return vocabulary.status_counts(t.events.select(status.alias("status"))).select("status", F.col("n").cast("long").alias("n"))


# ---- ranges


@query("""with r as (select * from (values ('F', 1, 100, 1000, 1), ('F', 50, 500, 2000, 2), ('O', 1, 1000, 5000, 3)) v(s, lo, hi, dest, rule_no)),
    h as (select o_orderkey, r.*, row_number() over (partition by o_orderkey order by rule_no) as n from orders join r on o_orderstatus = s and o_orderkey between lo and hi)
    select o.o_orderkey, coalesce(h.dest + o.o_orderkey - h.lo, o.o_orderkey)::bigint as place, h.rule_no::int as rule_no from orders o left join h on h.o_orderkey = o.o_orderkey and h.n = 1""")
def range_rules(t):
    rules = t.rows([("F", 1, 100, 1000, 1), ("F", 50, 500, 2000, 2), ("O", 1, 1000, 5000, 3)], "o_orderstatus string, lo long, hi long, dest long, rule_no int")
    found = ranges.first_rule(t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("p")), rules, ["o_orderstatus"], "p", "o_orderkey")
    return found.select("o_orderkey", ranges.shifted(F.col("p"), F.col("lo"), F.col("dest")).alias("place"), "rule_no")


@query("""with s as (select user_id, event_id, ts as a, ts + to_seconds(value::int) as b from events),
    f as (select *, case when a <= max(b) over (partition by user_id order by a, b, event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from s),
    i as (select *, sum(n) over (partition by user_id order by a, b, event_id rows unbounded preceding) as island from f)
    select user_id, island::bigint as island, count(*)::bigint as n, min(event_id) as first_event from i group by all""")
def interval_clusters(t):
    spans = t.events.select("user_id", "event_id", F.col("ts").alias("a"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round("value").cast("int"))).alias("b"))
    return ranges.islands(spans, ["user_id"], "a", "b", ["a", "b", "event_id"]).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""with t as (select conv_id, turn, text, role, coalesce(sum((role = 'assistant')::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as segment from conversations),
    c as (select conv_id, segment, min(turn) as lo, max(turn) as hi from t group by all)
    select c.conv_id, c.segment::bigint as segment, count(w)::bigint as n_words from c join conversations x on x.conv_id = c.conv_id and x.turn between c.lo and c.hi, lateral (select unnest(regexp_extract_all(lower(x.text), '[a-z]+')) as w) group by all""")
def range_scan_words(t):
    cut = ranges.segments_after(t.conversations, ["conv_id"], ["turn"], F.col("role") == "assistant")
    spans = cut.groupBy("conv_id", "segment").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    inside = ranges.range_scan(spans, t.conversations.select("conv_id", "turn", "text"), ["conv_id"], "lo", "hi", "turn")
    words = inside.select("conv_id", "segment", F.explode(postings.ascii_tokens(F.col("text"))).alias("w"))
    return words.groupBy("conv_id", "segment").agg(F.count("*").alias("n_words"))


@query("select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as user_text from conversations")
def forward_fill(t):
    return ranges.forward_fill(t.conversations, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "user_text").select("conv_id", "turn", "user_text")


@query("select conv_id, turn, coalesce(sum((role = 'assistant')::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as segment from conversations")
def segments(t):
    return ranges.segments_after(t.conversations, ["conv_id"], ["turn"], F.col("role") == "assistant").select("conv_id", "turn", "segment")


@query("select conv_id, turn, coalesce(sum(len(regexp_extract_all(lower(text), '[a-z]+'))) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from conversations")
def running_offsets(t):
    return ranges.running_offset(t.conversations, ["conv_id"], ["turn"], F.size(postings.ascii_tokens(F.col("text")))).select("conv_id", "turn", F.col("offset").cast("long").alias("offset"))


@query("""with recursive n as (select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nx, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders),
    w as (select o_orderkey as start, o_orderkey as node, 0 as step from n where r = 1 union all select w.start, n.nx, w.step + 1 from w join n on n.o_orderkey = w.node where n.nx is not null)
    select start, max(step)::int as steps, max(node) as greatest from w group by start""")
def chain_walk(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = t.orders.select("o_orderkey", F.lead("o_orderkey").over(w).alias("next"), F.row_number().over(w).alias("r"))
    return ranges.walk_chain(links, links.where("r = 1"), "o_orderkey", "next").groupBy("start").agg(F.max("step").cast("int").alias("steps"), F.max("node").alias("greatest"))


# ---- matching


@query("""with c as (select p_partkey, l_orderkey * 10 + l_linenumber as o, l_returnflag, l_quantity from part join lineitem on l_partkey = p_partkey)
    select p_partkey, o as pick, l_returnflag as flag from (select *, row_number() over (partition by p_partkey order by (l_returnflag <> 'R')::int, (l_quantity < 25)::int, o) as n from c) where n = 1
    union all select p_partkey, null, null from part where p_partkey not in (select l_partkey from lineitem)""")
def top1_pick(t):
    pool = t.lineitem.select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pick"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"))
    wanted = t.part.select(F.col("p_partkey").alias("_w"), "p_partkey")
    found = matching.pick(wanted, pool, by=[("p_partkey", "k")], prefer=[F.col("flag") == "R", F.col("q") >= 25], ordinal="pick", out=["pick", "flag"])
    return found.select("p_partkey", "pick", "flag")


@query(f"""with bt as (select distinct item_id, unnest({TOKENS}) as w from benchmark), dt as (select distinct doc_id, unnest({TOKENS}) as w from documents),
    s as (select item_id, doc_id, count(*) as shared from bt join dt using (w) group by all),
    f as (select item_id, doc_id, 4 * (shared >= 20)::int + 2 * (lang = 'en')::int + (n_chars <= 1000)::int + shared as score from s join documents using (doc_id))
    select item_id, doc_id, score::bigint as score, (score >= 30)::boolean as accepted from f qualify row_number() over (partition by item_id order by score desc, doc_id) = 1""")
def scored_match(t):
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(postings.ascii_tokens(F.col("text")))).alias("w"))
    items = words(t.benchmark, "item_id")
    shared = words(t.documents, "doc_id").join(items, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    facts = shared.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    score = 4 * (F.col("shared") >= 20).cast("int") + 2 * (F.col("lang") == "en").cast("int") + (F.col("n_chars") <= 1000).cast("int") + F.col("shared")
    best = matching.scored(facts, "item_id", score.cast("long"), "doc_id")
    return best.select("item_id", "doc_id", "score").withColumn("accepted", F.col("score") >= 30)


@query("""with d as (select p_type as k, min(p_partkey) as v from part group by 1),
    f as (select p_partkey, unnest([p_name, p_type, regexp_replace(p_type, ' .*$', '')]) as k, unnest([0, 1, 2]) as a from part),
    m as (select p_partkey, v, a, row_number() over (partition by p_partkey order by a) as n from f join d using (k))
    select p.p_partkey, m.v as match, m.a::int as "at", case m.a when 0 then 'exact' when 1 then 'alias' when 2 then 'folded' else '' end as source from part p left join m on m.p_partkey = p.p_partkey and n = 1""")
def cascade_match(t):
    dictionary = t.part.groupBy(F.col("p_type").alias("k")).agg(F.min("p_partkey").alias("match"))
    wanted = t.part.select(F.col("p_partkey").alias("_w"), "p_partkey", "p_name", "p_type")
    found = matching.cascade(wanted, F.array("p_name", "p_type", F.regexp_replace("p_type", " .*$", "")), dictionary, "k", "match")
    return found.select("p_partkey", "match", "at", F.coalesce(F.get(F.array(F.lit("exact"), F.lit("alias"), F.lit("folded")), F.col("at")), F.lit("")).alias("source"))


@query("""select n_nationkey, case when p_name <> '' and n_nationkey % 3 = 0 then p_name when n_nationkey % 3 = 1 and p_brand <> '' then p_brand else '' end as gloss,
    case when n_nationkey % 3 = 0 then 'curated' when n_nationkey % 3 = 1 then 'index' else '' end as source from nation join part on p_partkey = n_nationkey + 1""")
def gloss_cascade(t):
    rows = t.nation.join(t.part, F.col("p_partkey") == F.col("n_nationkey") + 1)
    k = F.col("n_nationkey") % 3
    gloss = markup.first_gloss(("curated", F.when(k == 0, F.col("p_name"))), ("index", F.when(k == 1, F.col("p_brand"))))
    return rows.select("n_nationkey", gloss.alias("g")).select("n_nationkey", "g.gloss", "g.source")


@query("""with l as (select distinct c_mktsegment || '' as lemma from customer union select n_name from nation),
    t as (select n_name as target from nation union select 'BUILDING')
    select lemma, case when target = 'BUILDING' then null else target end as target from l left join t on target = lemma""")
def reconcile_block(t):
    lemmas = t.customer.select(F.col("c_mktsegment").alias("lemma")).unionByName(t.nation.select(F.col("n_name").alias("lemma")))
    targets = t.nation.select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("ordinal")).unionByName(t.rows([("BUILDING", 99)], "target string, ordinal int"))
    blocked = t.rows([("BUILDING", "BUILDING")], "lemma string, target string")
    return matching.reconcile(lemmas, targets, "lemma", "target", "ordinal", greek.candidate_forms, greek.fold_case_sensitive, blocked)


@query("""with n as (select distinct p_name as w from part), p as (select a.w as a, b.w as b from n a join n b on substr(a.w, 1, 1) = substr(b.w, 1, 1) and a.w < b.w)
    select a, b, (levenshtein(a, b) <= case when least(length(a), length(b)) <= 5 then 1 else 3 end)::boolean as same from p where levenshtein(a, b) <= 3""")
def same_word(t):
    """Pairs with one initial within distance 3."""
    pairs = spelling.near_pairs(t.part, "p_name", 3)
    return pairs.select("a", "b", greek.same_word(F.col("a"), F.col("b")).alias("same"))


@query("select n_regionkey, n_nationkey, coalesce((select string_agg(m.n_name, ',' order by m.n_nationkey) from nation m where m.n_regionkey = n.n_regionkey and m.n_name <> n.n_name), '') as family from nation n")
def family_list(t):
    members = t.nation.select("n_regionkey", "n_name", "n_nationkey")
    lists = matching.family(members, "n_regionkey", "n_name", "n_nationkey", members)
    return lists.join(F.broadcast(members.select("n_name", "n_nationkey")), "n_name").select("n_regionkey", "n_nationkey", F.array_join("family", ",").alias("family"))


@query("select l_suppkey, count(distinct l_partkey)::bigint as n, min(l_partkey) as first_part, max(l_partkey) as last_part, sum(distinct l_partkey)::bigint as parts from lineitem where l_partkey in (select p_partkey from part) group by l_suppkey")
def xref_index(t):
    links = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    lemmas = links.select(F.col("l_partkey").alias("id"), F.col("p_name").alias("lemma"), F.col("p_brand").alias("gloss"), F.col("l_partkey").alias("ordinal"), F.col("l_suppkey").alias("bdb"))
    ids = F.transform("options", lambda x: x["id"])
    found = lexicon.cross_references(lemmas).select(F.col("bdb").alias("l_suppkey"), ids.alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("l_suppkey", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_part"), F.element_at("ids", -1).alias("last_part"), total.alias("parts"))


@query("select p_brand, string_agg(distinct p_type, ',' order by p_type) as types from part group by p_brand")
def reverse_map(t):
    return postings.reverse_map(t.part, "p_type", "p_brand").select("p_brand", F.array_join("keys", ",").alias("types"))


@query("select o_orderkey, coalesce(a.c_name, b.c_name) as name from orders left join customer a on a.c_custkey = o_custkey * 10 left join customer b on b.c_custkey = o_custkey")
def fallback_lookup(t):
    names = t.customer.select("c_custkey", F.col("c_name").alias("name"))
    return matching.fallback_lookup(t.orders.select("o_orderkey", "o_custkey"), names, F.col("o_custkey") * 10, F.col("o_custkey"), "c_custkey", "name").select("o_orderkey", "name")


@query("""with w as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w, unnest(range(len(regexp_extract_all(lower(text), '[a-z]+')))) as i from conversations)
    select case when b.w is null then 'none' when b.w = a.w then 'joint' else 'own' end as kind, count(*)::bigint as n from w a left join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.i = b.i group by 1""")
def positional_join(t):
    words = postings.occurrences(t.conversations.withColumn("at", F.struct("conv_id", "turn")), "at", postings.ascii_tokens(F.col("text"))).select("at.*", "i", "token")
    after = words.select("conv_id", (F.col("turn") - 1).alias("turn"), "i", F.col("token").alias("context"))
    joined = words.join(after, ["conv_id", "turn", "i"], "left").withColumn("context", F.when(F.col("context") == F.col("token"), "").otherwise(F.col("context")))
    return joined.groupBy(postings.context_kind(F.col("context")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"select item_id, len({TOKENS})::bigint as n, (len({TOKENS}) * (len({TOKENS}) - 1) // 2)::bigint as checksum from benchmark")
def align_exact(t):
    """Equal texts are aligned without Python."""
    rows = t.benchmark.select("item_id", postings.ascii_tokens(F.col("text")).alias("base"))
    found = alignment.align_frame(rows.withColumn("other", F.col("base")), "base", "other")
    return found.select("item_id", F.size("alignment").cast("long").alias("n"), F.aggregate("alignment", F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


# ---- markup and gates


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as g from documents), c as (select doc_id, g, lower(g) as w, rtrim(g, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as r from l),
    u as (select doc_id, g <> '' and len(regexp_split_to_array(trim(g), '\\s+')) <= 6 and not list_has_any(regexp_split_to_array(w, '[^a-z0-9_]'), {markup.ARCHAIC + markup.CROSS_REFERENCE})
      and left(w, 4) <> 'and ' and not (left(w, 4) = 'the ' and (contains(substr(w, 5), ' which ') or contains(substr(w, 5), ' that '))) and len(list_filter(string_split(g, ''), lambda x: contains('!?{{}}[].', x))) = 0
      and len(string_split(g, '(')) = len(string_split(g, ')')) and len(string_split(g, '"')) % 2 = 1 and not contains(',;:)-–—', left(g, 1)) and not contains(',;:(-–—.', right(r, 1)) as ok from c)
    select doc_id, count(*)::bigint as n_lines, count(*) filter (where ok)::bigint as n_usable from u group by doc_id""")
def usable_filter(t):
    """G13, of every line."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("g"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(markup.usable_gloss(F.col("g"))).alias("n_usable"))


@query()
def sanitize_pages(t):
    clean = t.pages.select("page_id", sanitize.sanitize("html").alias("html"))
    return clean.select("page_id", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("sha256"), markup.is_safe(F.col("html")).alias("safe"))


@query(r"select page_id, length(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&thinsp;', ' '), '&amp;', '&'))::bigint as n_chars from pages".replace('\\"', '"'))
def strip_tags(t):
    return t.pages.select("page_id", F.length(markup.strip_tags(F.col("html"))).cast("long").alias("n_chars"))


@query(r"""select page_id, len(list_filter(g, lambda x: not regexp_matches(x, '(?i)^</?(b|i|em|span|div|p|a|br|table|tr|td|sup|sub)\b'))) > 0 as tag, len(list_filter(g, lambda x: regexp_matches(x, '(?i)\son\w+\s*='))) > 0 as handler,
    len(list_filter(g, lambda x: regexp_matches(x, '(?i)\sstyle\s*='))) > 0 as style, len(list_filter(g, lambda x: regexp_matches(x, '(?i)\s(href|src)\s*='))) > 0 as link from (select page_id, regexp_extract_all(html, '<[^>]*>') as g from pages)""")
def unsafe_flags(t):
    return t.pages.select("page_id", markup.unsafe_flags(F.col("html")).alias("f")).select("page_id", "f.*")


def _events(t) -> DataFrame:
    kinds = {"click": "lookup", "view": "encounter", "purchase": "status", "signup": "known"}
    return t.events.select(F.col("user_id").cast("string").alias("key"), morphology.lookup(kinds, F.col("event_type")).alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), F.col("event_id") % 50).alias("form"), F.concat(F.lit("c"), F.col("event_id") % 7).alias("chapter"), F.lit("known").alias("status"), F.lit("").alias("gloss")).where("kind is not null")


@query("""with e as (select user_id::varchar as key, case event_type when 'click' then 'lookup' when 'view' then 'encounter' when 'purchase' then 'status' when 'signup' then 'known' end as kind, ts, event_id from events),
    l as (select key, list(struct_pack(k := kind, st := null::varchar, l := 0, e := 0, p := 0) order by ts, event_id) as es, count(distinct case when kind = 'lookup' then event_id % 50 end) as forms, count(distinct case when kind = 'lookup' then event_id % 7 end) as chapters from e where kind is not null group by key),
    f as (select key, forms, chapters, list_reduce(list_prepend(struct_pack(k := 'start', st := null::varchar, l := 0, e := 0, p := 0), es), lambda a, x: struct_pack(k := x.k,
      st := case x.k when 'lookup' then case when a.st is null or a.st in ('new', 'automatic') then 'recognized' else a.st end when 'encounter' then case when a.st is null then 'new' when a.st = 'new' and a.l = 0 and a.e >= 3 then 'automatic' else a.st end
        when 'status' then case when a.st is not null then 'known' end else case when a.st is null or a.st = 'new' and a.l = 0 then 'automatic' else a.st end end,
      l := a.l + (x.k = 'lookup')::int, e := a.e + (x.k = 'encounter' or x.k = 'known' and a.st is null)::int, p := a.p + (x.k = 'encounter' and coalesce(a.st, '') = 'new' and a.l = 0 and a.e >= 3)::int)) as s from l)
    select key, s.st as status, s.l::bigint as lookups, s.e::bigint as encounters, least(forms, 40)::bigint as n_forms, chapters::bigint as n_chapters, s.p::bigint as promoted from f where s.st is not null""")
def vocab_fold(t):
    """V1, V2, V3, V6: the state machine against a fold over each word's events in order."""
    states = vocabulary.fold_vocabulary(_events(t))
    return states.select("key", "status", "lookups", "encounters", F.size("forms").cast("long").alias("n_forms"), F.size("chapters").cast("long").alias("n_chapters"), "promoted")


@query("select user_id::varchar as key, count(*) filter (where event_type = 'click')::bigint as lookups, count(*) filter (where event_type = 'view')::bigint as encounters from events where event_type in ('click', 'view', 'purchase', 'signup') group by 1")
def vocab_counters(t):
    return vocabulary.counters(_events(t)).select("key", "lookups", "encounters")


@query("select user_id::varchar as book, (event_id % 5)::bigint as ch, bool_or(event_type = 'purchase') as done, count(*) filter (where event_type <> 'purchase')::bigint as visits, max(event_id)::bigint as last_at from events group by 1, 2")
def chapter_progress(t):
    visits = t.events.select(F.col("user_id").cast("string").alias("book"), (F.col("event_id") % 5).alias("ch"), (F.col("event_type") == "purchase").alias("done"), F.col("event_id").alias("at"))
    return vocabulary.chapter_progress(visits)


@query("select user_id as book, arg_max(event_id % 5, struct_pack(t := ts, c := event_id % 5, e := event_id)) as ch, arg_max(event_id, struct_pack(t := ts, c := event_id % 5, e := event_id)) as v from events group by 1")
def last_position(t):
    rows = t.events.select(F.col("user_id").alias("book"), (F.col("event_id") % 5).alias("ch"), F.col("event_id").alias("v"), F.col("ts").alias("at"))
    return vocabulary.last_positions(rows).select("book", "ch", "v")


@query("select doc_id as path, sha256(text) as sha256 from documents")
def checksums(t):
    return quality.content_hashes(t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("""with b as (select substr(sha256(p), 1, 2) as b, sha256(string_agg(sha256(strlen(p) || ':' || p || strlen(text) || ':' || text), '' order by p)) as d, count(*) as n from (select doc_id::varchar as p, text from documents) group by 1)
    select sha256(string_agg(d, '' order by b)) as fingerprint, sum(n)::bigint as n_files from b""")
def fingerprint(t):
    return quality.fingerprint(t.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query(r"""select 'empty text' as gate, count(*) filter (where text = '')::bigint as n from documents union all select 'unknown language', count(*) filter (where lang not in ('en', 'de', 'fr', 'es')) from documents
    union all select 'length', count(*) filter (where n_chars <> length(text)) from documents union all select 'symbols', count(*) filter (where regexp_matches(text, '[$%&*#]{3}')) from documents union all select 'markup', count(*) filter (where html not like '%<%') from pages""")
def violations(t):
    docs, pages = t.documents, t.pages
    return quality.violations({
        "empty text": (docs, F.col("text") == ""), "unknown language": (docs, ~F.col("lang").isin("en", "de", "fr", "es")), "length": (docs, F.col("n_chars") != F.length("text")),
        "symbols": (docs, F.col("text").rlike("[$%&*#]{3}")), "markup": (pages, ~F.col("html").contains("<")),
    })


@query("select n_name as name, 'new' as kind from nation where n_name not in ('FRANCE', 'GERMANY', 'ATLANTIS') union all select x, 'gone' from (values ('FRANCE'), ('GERMANY'), ('ATLANTIS')) v(x) where x not in (select n_name from nation)")
def allowlist_exact(t):
    allowed = t.rows([("FRANCE",), ("GERMANY",), ("ATLANTIS",)], "name string")
    return matching.allowlist_differences(t.nation.select(F.col("n_name").alias("name")), allowed, "name")


@query("""with g as (select conv_id, max(turn) as m from conversations group by 1), a as (select conv_id, unnest(range(1, m + 1)) as turn from g)
    select a.conv_id, a.turn::bigint as turn, (c.text is null) as missing from a left join (select * from conversations where turn % 3 <> 1) c using (conv_id, turn)""")
def densified(t):
    kept = t.conversations.where("turn % 3 <> 1").select("conv_id", F.col("turn").cast("int").alias("turn"), "text")
    most = t.conversations.groupBy("conv_id").agg(F.max("turn").cast("int").alias("turn")).withColumn("text", F.lit(None).cast("string"))
    dense = postings.densify(kept.unionByName(most.join(kept, ["conv_id", "turn"], "left_anti")), ["conv_id"], "turn")
    return dense.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").isNull().alias("missing"))


# ---- search


@query(f"""with w as (select token, count(*)::bigint as "count" from (select unnest({TOKENS}) as token from documents) group by 1)
    select token as lemma, "count", (case when token = 'the' then 2 else 0 end)::int as score from w where token like 'th%' and (token = 'the' or starts_with(token, 'the')) order by score desc, "count" desc, lemma limit 80""")
def search_english(t):
    words = t.documents.select(F.explode(postings.ascii_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    rows = words.select(F.lit("he").alias("lang"), F.col("token").alias("id"), F.col("token").alias("lemma"), F.lit("").alias("transliteration"), F.col("token").alias("gloss"), "count", F.lit("").alias("strong"), F.lit("").alias("source"), F.col("token").alias("ordinal"))
    return search.search(rows, "the").select("lemma", "count", F.when(F.col("gloss") == "the", 2).otherwise(0).alias("score"))


@query("""select p_partkey::varchar as id, "count" from (select p_partkey, p_size as "count" from part where p_size = 12) order by id""")
def search_number(t):
    rows = t.part.select(F.lit("he").alias("lang"), F.concat_ws(" ", "p_size", F.substring("p_brand", 7, 1)).alias("id"), F.col("p_name").alias("lemma"), F.lit("").alias("transliteration"), F.col("p_name").alias("gloss"), F.col("p_size").alias("count"), F.lit("").alias("strong"), F.lit("").alias("source"), F.col("p_partkey").alias("ordinal"))
    return search.search(rows, "H12", limit=1 << 30).select(F.col("ordinal").cast("string").alias("id"), "count")
