"""Registered queries of the structures that stand in for scans: long alignments, the containment index, near spellings,
compressed postings, verses with annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import markup, registered
from corpuscle.operators import alignment, compressed, containment, postings, quality, ranges, rendering, sanitize, spelling, verses
from corpuscle.plans.applied import ALL_MARKS, GREEK_PLAIN, _lexicon, gr_sql, he, he_sql
from corpuscle.plans.registry import TOKENS, query
from corpuscle.session import shared_folder

# ---- alignment of long texts


@query(f"""with w as (select doc_id, {TOKENS} as base from documents), t as (select *, list_filter(base, lambda x, i: i % 5 <> 0) as thinned from w)
    select doc_id, len(base)::bigint as n, len(thinned)::bigint as n_matched, md5(coalesce(array_to_string(thinned, ' '), '')) as matched_words,
      coalesce(list_sum(list_transform(range(len(base)), lambda i: (i + 1) * (i + i // 3 + 1))), 0)::bigint as checksum from t""")
def align_documents(t):
    """J2 of whole documents, words repeated as they are: against the text without each fifth word all that is left is
    matched, whichever copies; against the text with a strange word after each third one, each word finds itself."""
    words = t.documents.select("doc_id", postings.ascii_tokens(F.col("text")).alias("base"))
    thinned = F.filter("base", lambda w, i: i % 5 != 4)
    marked = F.flatten(F.transform("base", lambda w, i: F.when(i % 3 == 2, F.array(w, F.lit("1"))).otherwise(F.array(w))))
    both = words.select("doc_id", "base", thinned.alias("thinned"), marked.alias("marked"))
    found = alignment.align_frame(alignment.align_frame(both, "base", "thinned", "of_thinned"), "base", "marked", "of_marked")
    matched = F.filter(F.zip_with("base", "of_thinned", lambda w, j: F.when(j >= 0, w)), lambda w: w.isNotNull())
    checksum = F.aggregate(F.transform("of_marked", lambda j, i: (i + 1).cast("long") * (j + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    some = found.select("doc_id", F.size("base").cast("long").alias("n"), matched.alias("matched"), F.coalesce(checksum, F.lit(0).cast("long")).alias("checksum"))
    matched_words = F.md5(F.coalesce(F.array_join("matched", " "), F.lit("")))
    return some.select("doc_id", "n", F.size("matched").cast("long").alias("n_matched"), matched_words.alias("matched_words"), "checksum")


# ---- a verse's markup

#: Forms of markup around a first word a and the others b, by a number: (markup, text, start, end, kind, value, problem)
#: as templates; {a}, {b} and {k} (a without its first letter) are put in. Starts and ends are SQL over their lengths.
FORMS = [
    ('<small>{a}</small><br>{b}', "{a} {b}", "0", "la", "small", "", None),
    ('{a} <span class="mam-kq"><span class="mam-kq-k">({k})</span> <span class="mam-kq-q">[{a}]</span></span> &nbsp;{b}', "{a} {a} {b}", "la + 1", "2 * la + 1", "pair", "{k}", None),
    ('{a} <span class="mam-kq-k">({k}) </span> {b}', "{a} {b}", "la + 1", "la + 1", "written", "{k}", None),
    ('{a}  <span class="mam-kq-q">[{a}]</span> <span class="mam-kq-trivial">{b}</span>', "{a} {a} {b}", "la + 1", "2 * la + 1", "read", "", None),
    ('{a}<sup class="footnote-marker">*</sup><i class="footnote"> {k} </i> {b}', "{a} {b}", "la", "la", "note", "{k}", None),
    ('{a}<b>׀</b><small>׀</small>{b} <span class="mam-spi-pe">{פ}</span>', "{a} ׀ ׀ {b}", "la + 5 + lb", "la + 5 + lb", "pe", "", None),
    ('{a}<span class="mam-implicit-maqaf">־</span>{b}<span class="mam-spi-samekh">{ס}</span>', "{a}־{b}", "la + 1 + lb", "la + 1 + lb", "samekh", "", None),
    ('{a} {b}<u>x</u><big>{a}</big>', "{a} {b}{a}", "la + 1 + lb", "2 * la + 1 + lb", "big", "", "u"),
]


def _form_sql(column: int) -> str:
    value = lambda f: "null" if f is None else f if column in (2, 3) else "replace(replace(replace('" + f + "', '{a}', a), '{b}', b), '{k}', k)"
    return "case " + " ".join(f"when form = {n} then {value(f[column])}" for n, f in enumerate(FORMS)) + " end"


@query(f"""with w as (select conv_id, turn, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '') as w from conversations),
    h as (select conv_id, turn, (conv_id + turn) % {len(FORMS)} as form, {he_sql("w[1]")} as a, {he_sql("array_to_string(w[2:], ' ')")} as b from w where len(w) > 1), v as (select *, substr(a, 2) as k, length(a) as la, length(b) as lb from h)
    select conv_id, turn, {_form_sql(1)} as text, ({_form_sql(2)})::int as start, ({_form_sql(3)})::int as "end", {_form_sql(4)} as kind, {_form_sql(5)} as value, coalesce({_form_sql(6)}, '') as problems from v""")
def verse_annotations(t):
    """Markup as text and annotations; what isn't known is a problem."""
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " "), lambda x: x != "")
    rows = t.conversations.select("conv_id", "turn", w.alias("w")).where(F.size("w") > 1)
    rows = rows.select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % len(FORMS)).alias("form"), he(F.col("w")[0]).alias("a"), he(F.array_join(F.slice("w", 2, F.size("w")), " ")).alias("b"))
    html = F.get(F.array(*[F.lit(f[0]) for f in FORMS]), F.col("form").cast("int"))
    for name, value in (("{a}", F.col("a")), ("{b}", F.col("b")), ("{k}", F.substring("a", 2, 1 << 20))):
        html = F.replace(html, F.lit(name), value)
    parsed = verses.with_verses(rows.select("conv_id", "turn", html.alias("html")), "html")
    told = verses.annotations(parsed.withColumn("problems", F.array_join("problems", ",")), ["conv_id", "turn", "text", "problems"])
    return told.where("kind <> 'small' or start = 0")


# ---- search by an index

#: A search, and what its rows are in SQL: ordinal, id, count, and whether they come first.
SEARCHES = {
    "הרִנג": f"select p_partkey as o, p_partkey::varchar as id, p_size as n, translate({he_sql('p_name')}, '{ALL_MARKS} ', '') = 'רנג' as first from part where contains(translate({he_sql('p_name')}, '{ALL_MARKS} ', ''), 'רנג')",
    "ΡΊΝΓ": f"""select p_partkey as o, {gr_sql("p_name || ' ' || p_partkey")} as id, p_size as n, false as first from part where contains(replace({gr_sql("p_name || ' ' || p_partkey", GREEK_PLAIN)}, 'ς', 'σ'), 'ρινγ')""",
    "sm": "select p_partkey + side * (1::bigint << 40) as o, case side when 0 then p_partkey::varchar else {lemma} end as id, p_size as n, false as first from part, (select unnest([0, 1]) as side) where regexp_matches(p_type, '(?i)\\bsm')".replace(
        "{lemma}", gr_sql("p_name || ' ' || p_partkey")
    ),
    "h 12": "select p_partkey as o, p_partkey::varchar as id, p_size as n, false as first from part where p_partkey = 12",
}


@query(" union all ".join(f"(select '{q}' as query, id, n as \"count\" from ({sql}) order by first desc, n desc, o limit 80)" for q, sql in SEARCHES.items()))
def search_indexed(t):
    """Q-S by the containment index: its four routes."""
    index = containment.ContainmentIndex.build(_lexicon(t))
    out: DataFrame | None = None
    for q in SEARCHES:
        found = index.search(q).select(F.lit(q).alias("query"), "id", "count")
        out = found if out is None else out.unionByName(found)
    return out


# ---- near spellings


@query(f"""with w as (select distinct unnest({TOKENS}) as w from conversations), p as (select a.w as a, b.w as b from w a join w b on substr(a.w, 1, 1) = substr(b.w, 1, 1) and a.w < b.w and abs(length(a.w) - length(b.w)) <= 3)
    select a, b from p where levenshtein(a, b) <= case when least(length(a), length(b)) <= 5 then 1 else 3 end""")
def near_spellings(t):
    """G11, J15 over all words of the conversations, by neighbourhoods of deletions and by segments."""
    return spelling.same_words(t.conversations.select(F.explode(F.array_distinct(postings.ascii_tokens(F.col("text")))).alias("w")), "w")


# ---- compressed postings


def _blocks(t) -> DataFrame:
    return compressed.compress(postings.occurrences(t.documents, "doc_id", postings.ascii_tokens(F.col("text"))), "token", "doc_id", "i")


@query(f"""with w as (select doc_id, unnest({TOKENS}) as token, unnest(range(len({TOKENS}))) as i from documents) select token, count(*)::bigint as n, min(doc_id) as first_doc, max(doc_id) as last_doc, sum(doc_id * 31 + i * 7)::bigint as checksum from w group by token""")
def compressed_postings(t):
    """A1: written as blocks of gaps, and read again."""
    blocks = _blocks(t)
    ends = blocks.groupBy("token").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
    sums = compressed.decompress(blocks).groupBy("token").agg(F.sum(F.col("doc") * 31 + F.col("place") * 7).alias("checksum"))
    return ends.join(sums, "token")


@query(f"""with w as (select doc_id, unnest({TOKENS}) as token from documents), c as (select token, count(*) as n from w group by 1), o as (select token, row_number() over (order by n desc, token) as r from c),
    two as (select doc_id as doc, count(*) filter (where r = 1) as n_one, count(*) filter (where r = 8) as n_other from w join o using (token) where r in (1, 8) group by 1)
    select doc, n_one::bigint as n_one, n_other::bigint as n_other from two where n_one > 0 and n_other > 0""")
def two_words(t):
    """A1: documents with the first and the eighth of all words, by skip entries."""
    blocks = _blocks(t)
    common = [r.token for r in blocks.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(8).collect()]
    return compressed.documents_with(blocks, common[0], common[7])


@query(f"""with w as (select doc_id, unnest({TOKENS}) as token, unnest(range(len({TOKENS}))) as i from documents), c as (select token, count(*) as n from w group by 1), o as (select token, row_number() over (order by n desc, token) as r from c),
    a as (select doc_id, i from w join o using (token) where r = 2), b as (select doc_id, i - 1 as i from w join o using (token) where r = 1) select doc_id as doc, i::int as place from a join b using (doc_id, i)""")
def word_pairs(t):
    """A1: where the second of all words stands right before the first."""
    blocks = _blocks(t)
    common = [r.token for r in blocks.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(2).collect()]
    return compressed.phrase(blocks, common[1], common[0])


# ---- rules, gates and SQL functions


@query("""with h as (select o_orderkey, l_orderkey * 10 + l_linenumber as rule_no, row_number() over (partition by o_orderkey order by l_orderkey * 10 + l_linenumber) as n
      from orders join lineitem on o_orderstatus = l_linestatus and o_orderkey between l_orderkey - l_quantity::bigint and l_orderkey + 2 * l_quantity::bigint)
    select o.o_orderkey, h.rule_no::bigint as rule_no from orders o left join h on h.o_orderkey = o.o_orderkey and h.n = 1""")
def many_range_rules(t):
    """J5 with as many rules as there are order lines, by dyadic blocks: nothing is broadcast."""
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("long")
    rules = t.lineitem.select(F.col("l_linestatus").alias("o_orderstatus"), (k * 10 + F.col("l_linenumber")).cast("long").alias("rule_no"), (k - q).alias("lo"), (k + 2 * q).alias("hi"))
    return ranges.first_rule_by_blocks(t.orders.select("o_orderkey", "o_orderstatus"), rules, ["o_orderstatus"], "o_orderkey").select("o_orderkey", "rule_no")


@query("""select 'rows' as gate, count(*)::bigint as n, count(*)::bigint as written from pages union all select 'markup', count(*) filter (where html like '%<%'), (select count(*) from pages) from pages
    union all select 'no address', count(*) filter (where coalesce(url, '') = ''), (select count(*) from pages) from pages union all select 'long', count(*) filter (where length(html) > 2000), (select count(*) from pages) from pages""")
def checked_write(t):
    """Q1, Q4, K6: gates are counted in the pass that writes; the table is there only if those that must hold do."""
    path = shared_folder(t.spark, "checked")
    counts = quality.write_checked(t.pages, path, {"no address": F.coalesce("url", F.lit("")) == ""}, {"markup": F.col("html").contains("<"), "long": F.length("html") > 2000})
    return t.rows(sorted(counts.items()), "gate string, n long").withColumn("written", F.lit(t.spark.read.parquet(path).count()).cast("long"))


@query(f"""with w as (select conv_id, turn, list_distinct({TOKENS}) as d, {TOKENS} as a from conversations), f as (select conv_id, turn, unnest(a) as x, unnest(range(len(a))) as p from w), g as (select conv_id, turn, x, min(p) as p from f group by all),
    b as (select conv_id, turn, row_number() over (partition by conv_id, turn order by p) - 1 as i from g), k as (select *, i % 5 = 3 as gone, sum((i % 5 <> 3)::int) over (partition by conv_id, turn order by i) - 1 as j from b)
    select conv_id, turn, i::int as base_place, case when gone then -1 else j end::int as other_place, i::bigint as n_before from k""")
def sql_functions(t):
    """X-UDF: called from SQL, the table function by partitions and in order, a side's words in one row, by a native function."""
    registered.register(t.spark)
    t.conversations.createOrReplaceTempView("corpuscle_conversations")
    return t.spark.sql("""
        with words as (select conv_id, turn, array_distinct(regexp_extract_all(lower(text), '[a-z]+', 0)) as word from corpuscle_conversations),
        sides as (select conv_id, turn, 0 as side, word from words union all select conv_id, turn, 1, filter(word, (w, i) -> i % 5 <> 3) from words)
        select conv_id, turn, base_place, other_place, cast(size(hebrew_tokens(repeat('x ', base_place))) as long) as n_before
        from aligned_words(table(sides) partition by (conv_id, turn) order by (side, word))""")


# ---- senses


@query("""select page_id, '<div class="sense"><span class="n">1</span> <a data-ref="Site.' || (page_id % 9 + 1) || '.2">' || page_id || '</a> <span>z</span><div class="sense"><b>w' || page_id || '</b> <b>s</b></div></div><div class="sense"><span class="he-inline">v</span></div>' as html,
      'Site.' || (page_id % 9 + 1) || '.2' as target from pages""")
def rendered_senses(t):
    """H3, H4: nested senses with links to passages, links elsewhere, and right-to-left words."""
    k = F.col("page_id").cast("string")
    place = F.concat(F.lit("The Site "), (F.col("page_id") % 9 + 1).cast("string"), F.lit(":2-7"))
    first = F.concat(F.lit('<a data-ref="'), place, F.lit('" href="/x">'), k, F.lit('</a>\n <a data-ref="Tob 1" href="/y">z</a>'))
    inner = F.concat(F.lit('<big><big><span dir="rtl">w'), k, F.lit("</span></big></big> <strong>s</strong>"))
    sense = lambda number, text, *more: F.struct(number.alias("number"), text.alias("definition"), *more)
    nested = F.array(sense(F.lit(None).cast("string"), inner))
    content = F.to_json(F.struct(F.array(sense(F.lit("1"), first, nested.alias("senses")), sense(F.lit(""), F.lit('<span dir="rtl">v</span>'), F.array().cast(nested_type()).alias("senses"))).alias("senses")))
    html = rendering.with_rendered_senses(t.pages.select("page_id", content.alias("content")), "content", {"The Site": "Site"}).select("page_id", "html")
    return html.withColumn("target", F.get(F.filter(rendering.links(F.col("html")), lambda x: x["kind"] == "ref"), 0)["target"])


def nested_type() -> str:
    return "array<struct<number:string,definition:string>>"


@query("select page_id, true as safe, true as again, true as balanced, 0::bigint as n_unsafe from pages")
def sanitized_properties(t):
    """H1, H2, Q8: what is written is safe, stays when it is sanitised again, and closes what it opens."""
    tags = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    clean = t.pages.select("page_id", sanitize.sanitize("html").alias("html"))
    flags = markup.unsafe_flags(F.col("html"))
    unsafe = sum((flags[f].cast("int") for f in ("tag", "handler", "style", "link")), F.lit(0)).cast("long")
    balanced = tags(F.col("html"), "<[a-z]+[^>]*>") - tags(F.col("html"), "<br>") == tags(F.col("html"), "</[a-z]+>")
    return clean.select("page_id", markup.is_safe(F.col("html")).alias("safe"), (sanitize.sanitize("html") == F.col("html")).alias("again"), balanced.alias("balanced"), unsafe.alias("n_unsafe"))
