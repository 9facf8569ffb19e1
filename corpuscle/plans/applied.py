"""Further registered queries: text, morphology, references, alignment, storage and state, fed with Hebrew and Greek
values that are made from the tables letter by letter, or with a small table of cases joined to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import greek, hebrew, markup, morphology, references, versification
from corpuscle.operators import alignment, lexicon, matching, postings, quality, ranges, rendering, search, vocabulary
from corpuscle.plans.registry import TOKENS, query
from corpuscle.session import shared_folder
from corpuscle.sources import readers, writers

#: What Latin letters become: vowels are points, z an accent, a hyphen the maqaf, a period the verse's end.
LATIN = "abcdefghijklmnopqrstuvwxyz-."
HEBREW = "".join(map(chr, [0x5B7, 0x5D1, 0x5DB, 0x5D3, 0x5B5, 0x5E4, 0x5D2, 0x5D4, 0x5B4, 0x5D9, 0x5E7, 0x5DC, 0x5DE, 0x5E0, 0x5B9, 0x5E2, 0x5D8, 0x5E8, 0x5E1, 0x5EA, 0x5BB, 0x5D5, 0x5E9, 0x5D7, 0x5E6, 0x596, 0x5BE, 0x5C3]))
VOWEL_POINTS, ACCENT, MAQAF, SOF = "".join(map(chr, [0x5B7, 0x5B5, 0x5B4, 0x5B9, 0x5BB])), chr(0x596), chr(0x5BE), chr(0x5C3)
GREEK = "άβχδέφγηίξκλμνόπψρστύωζθυς"
GREEK_PLAIN = "αβχδεφγηιξκλμνοπψρστυωζθυς"


def he(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN, HEBREW)


def gr(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN[:26], GREEK)


def he_sql(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{HEBREW}')"


def gr_sql(x: str, to: str = GREEK) -> str:
    return f"translate(lower({x}), '{LATIN[:26]}', '{to}')"


ALL_MARKS = VOWEL_POINTS + ACCENT
LETTERS_ONLY = "regexp_replace({}, '[^א-ת]', '', 'g')"
PRINTED = "p_name || ' ' || p_type || '-' || p_name || '.'"


def printed() -> Column:
    return F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit("-"), F.col("p_name"), F.lit("."))


# ---- Hebrew and Greek text


@query(f"""with h as (select p_partkey, {he_sql(PRINTED)} as h from part)
    select p_partkey, h as full_text, trim(regexp_replace(replace(h, '{ACCENT}', ''), ' +', ' ', 'g')) as niqqud,
      trim(regexp_replace(translate(h, '{MAQAF}{ALL_MARKS}', ' '), ' +', ' ', 'g')) as consonants, translate(h, '{ALL_MARKS}{MAQAF}{SOF} ', '') as skeleton, translate(h, '{ALL_MARKS}{MAQAF}{SOF} ', '') as alignment_key from h""")
def hebrew_views(t):
    """T2, T5, T6, T7, T8."""
    h = he(printed())
    modes = [hebrew.render(h, mode).alias(name) for mode, name in (("full", "full_text"), ("niqqud", "niqqud"), ("consonants", "consonants"))]
    return t.part.select("p_partkey", *modes, hebrew.skeleton(h).alias("skeleton"), hebrew.alignment_key(h).alias("alignment_key"))


@query(f"""with h as (select conv_id, turn, {he_sql('text')} as h from conversations)
    select conv_id, turn, len(list_filter(regexp_split_to_array(h, '[ {MAQAF}]'), lambda x: replace(x, '{SOF}', '') <> ''))::bigint as n_words, len(list_filter(regexp_split_to_array(h, ' +'), lambda x: x <> ''))::bigint as n_tokens from h""")
def hebrew_words(t):
    """T3, T4."""
    h = he(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.size(hebrew.content_words(h)).cast("long").alias("n_words"), F.size(hebrew.tokens(h)).cast("long").alias("n_tokens"))


@query(f"""with h as (select p_partkey, p_name, {he_sql(PRINTED)} as h from part)
    select p_partkey, {LETTERS_ONLY.format('h')} as consonants, translate({LETTERS_ONLY.format('h')}, 'וי', '') as bare, p_name as headword, (ascii(substr(h, 1, 1)) between 1488 and 1514)::boolean as begins_with_letter from h""")
def hebrew_letters(t):
    """T9, T12, T13, T14."""
    h = he(printed())
    headword = F.concat("p_name", F.get(F.array(F.lit(""), F.lit("²"), F.lit("¹⁰")), (F.col("p_partkey") % 3).cast("int")))
    return t.part.select("p_partkey", hebrew.consonants(h).alias("consonants"), hebrew.bare(h).alias("bare"), hebrew.strip_homograph(headword).alias("headword"), hebrew.is_letter(F.substring(h, 1, 1)).alias("begins_with_letter"))


@query(f"""with h as (select p_partkey, replace({he_sql('p_name')}, ' ', '') as h from part), n as (select *, length({LETTERS_ONLY.format('h')}) as n from h)
    select p_partkey, case when n > 2 then regexp_extract(h, '^([^א-ת]*([א-ת][^א-ת]*){{2}})', 1) end as first_two, case when n > 2 then regexp_replace(h, '^[^א-ת]*([א-ת][^א-ת]*){{2}}', '') end as rest from n""")
def letter_pieces(t):
    """T10."""
    h = F.replace(he(F.col("p_name")), F.lit(" "), F.lit(""))
    n = F.length(hebrew.consonants(h))
    pieces = hebrew.split_by_letters(h, F.array(F.lit(2), F.greatest(n - 2, F.lit(1))))
    return t.part.select("p_partkey", F.get(pieces, 0).alias("first_two"), F.get(pieces, 1).alias("rest"))


def _digits(ones: str, tens: str) -> str:
    return f"(case when n % 100 // 10 > 0 then '{tens}'[n % 100 // 10] else '' end) || (case when n % 10 > 0 then '{ones}'[n % 10] else '' end)"


@query(f"""with n as (select distinct p_partkey % 1100 as n from part), h as (select n, n // 100 as h from n)
    select n, case when n = 0 or n > 999 then n::varchar else repeat('ת', case when h > 8 then 2 when h > 4 then 1 else 0 end) || (case when h > 8 then 'ק' when h > 4 then 'קרשת'[h - 4] when h > 0 then 'קרשת'[h] else '' end)
      || (case n % 100 when 15 then 'טו' when 16 then 'טז' else {_digits('אבגדהוזחט', 'יכלמנסעפצ')} end) end as numeral from h""")
def hebrew_numerals(t):
    """T11."""
    return t.part.select((F.col("p_partkey") % 1100).alias("n")).distinct().select("n", hebrew.numeral(F.col("n")).alias("numeral"))


@query(f"""with n as (select distinct p_partkey % 1100 as n from part)
    select n, case when n = 0 or n > 999 then n::varchar else (case when n >= 100 then 'ρστυφχψωϡ'[n // 100] else '' end) || {_digits('αβγδεϛζηθ', 'ικλμνξοπϟ')} || 'ʹ' end as numeral from n""")
def greek_numeral_range(t):
    """G5."""
    return t.part.select((F.col("p_partkey") % 1100).alias("n")).distinct().select("n", greek.numeral(F.col("n")).alias("numeral"))


@query(f"""with g as (select p_partkey, {gr_sql('p_name', GREEK_PLAIN)} as g from part)
    select p_partkey, 'Α' || g as plain, 'Α' || replace(g, 'ς', 'σ') as case_sensitive, 'α' || replace(g, 'ς', 'σ') as folded, replace('α' || replace(g, 'ς', 'σ'), ' ', '') as letters from g""")
def greek_folds(t):
    """G1, G2, G3."""
    g = F.concat(F.lit("Ἀ"), gr(F.col("p_name")))
    return t.part.select("p_partkey", greek.plain(g).alias("plain"), greek.fold_case_sensitive(g).alias("case_sensitive"), greek.fold(g).alias("folded"), greek.fold_letters(g).alias("letters"))


@query("""with a as (select p_partkey, regexp_replace(regexp_replace(replace(lower(p_name), ' ', ''), 'g([gkjc])', 'N\\1', 'g'), 'g([gkjc])', 'N\\1', 'g') as x from part),
    b as (select p_partkey, regexp_replace(x, '([aeho])[uy]', '\\1U', 'g') as x from a)
    select p_partkey, replace(replace(replace(replace(translate(translate(x, 'cfqx', 'CFQX'), 'hvjwzuNU', 'ēōxzsynu'), 'C', 'ch'), 'F', 'ph'), 'Q', 'ps'), 'X', 'th') as latin from b""")
def greek_transliteration(t):
    """G6."""
    return t.part.select("p_partkey", greek.transliterate(gr(F.col("p_name"))).alias("latin"))


@query("""with k as (select *, p_partkey % 6 as k from part)
    select p_partkey, case when k < 4 then p_name else p_name || ' ' || p_type end as clean,
      case k when 0 then p_name when 1 then p_name when 2 then p_brand when 3 then p_type when 4 then p_name else p_name end as definition, 'descendant of ' || p_name as fixed from k""")
def gloss_cleaning(t):
    """G9, G12, G14."""
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    raw = F.when(k == 0, name).when(k == 1, F.concat(F.lit("  "), name, F.lit("."))).when(k == 2, F.concat(F.lit("{"), name, F.lit("} ("), "p_brand", F.lit(")"))).when(k == 3, F.concat(F.lit("["), F.col("p_type"), F.lit("] "), name)).when(k == 4, F.concat(name, F.lit(" (x) [y] "), "p_type")).otherwise(F.concat(name, F.lit("   "), "p_type"))
    definition = F.when(k == 2, F.concat(F.lit("from "), name)).when(k == 3, "").when(k == 4, F.concat(name, F.lit(", x; y"))).otherwise(F.concat(name, F.lit(": z")))
    usage = F.when(k == 2, F.concat(F.lit("× "), F.col("p_brand"), F.lit(", more"))).when(k == 3, F.concat(F.lit("+"), "p_type"))
    return t.part.select("p_partkey", markup.clean_gloss(raw).alias("clean"), markup.leading_definition(definition, usage).alias("definition"), markup.fix_typos(F.concat(F.lit("descendent of "), name)).alias("fixed"))


@query("select p_partkey, replace(replace(p_name || ' &lt; ' || p_brand || ' &amp; x', '#', '#'), '~', '') as escaped, '/word/he/' || p_partkey || '%20a' as link from part")
def escaped_links(t):
    """G15."""
    return t.part.select("p_partkey", markup.escape(F.concat("p_name", F.lit(" < "), "p_brand", F.lit(" & x"))).alias("escaped"), search.word_link(F.lit("he"), F.concat(F.col("p_partkey").cast("string"), F.lit(" a"))).alias("link"))


# ---- morphology: cases by row, each with what it must say

HEBREW_CASES = [
    ("b/310", "HR/Vqp1cs", "preposition + Qal · perfect · 1cs", "verb", "Qal · perfect · 1cs"),
    ("310", "HNcfpc", "noun · feminine plural · construct", "noun", "noun · feminine plural"),
    ("44", "HNp", "proper noun", "proper noun", "proper noun"),
    ("c/55", "HC/Aampa", "conjunction + adjective · masculine plural · absolute", "adjective", "adjective · masculine plural"),
    ("60", "AVhrmsa", "Hafʿel · participle · masculine singular · absolute", "verb", "Hafʿel · participle · masculine singular"),
    ("61", "HVqc", "Qal · infinitive construct", "verb", "Qal · infinitive construct"),
    ("62", "HD", "adverb", "adverb", "adverb"),
    ("63", "HAcmsa", "number · masculine singular · absolute", "number", "number · masculine singular"),
]
GREEK_CASES = [
    ("N-", "----DPF-", "noun · dative plural feminine"),
    ("V-", "2PAD-S--", "verb · present · active · imperative · 2nd singular"),
    ("V-", "-AMN----", "verb · aorist · middle · infinitive"),
    ("A-", "----NSMC", "adjective · nominative singular masculine · comparative"),
    ("D-", None, "adverb"),
    ("V-", "-XPPGSN-", "verb · perfect · passive · participle · genitive singular neuter"),
]


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "null" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return ", ".join(f"({', '.join(map(cell, row))})" for row in rows)


@query(f"""with c as (select * from (values {_values([(i, *c[2:]) for i, c in enumerate(HEBREW_CASES)])}) v(k, line, class, short)) select l_returnflag as flag, k, line, class, short, count(*)::bigint as n from lineitem join c on k = l_orderkey % {len(HEBREW_CASES)} group by all""")
def hebrew_morphology(t):
    """D4, D5, D7, D8."""
    cases = t.rows([(i, *c[:2]) for i, c in enumerate(HEBREW_CASES)], "k int, lemma string, code string")
    counted = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % len(HEBREW_CASES)).cast("int").alias("k")).agg(F.count("*").alias("n"))
    decoded = morphology.decode_hebrew(F.col("lemma"), F.col("code"))
    named = counted.join(F.broadcast(cases), "k").withColumn("d", decoded)
    return named.select("flag", "k", morphology.hebrew_line(F.col("d")).alias("line"), morphology.coarse_class(F.col("lemma"), F.col("code")).alias("class"), morphology.short_line(F.col("d")).alias("short"), "n")


@query(f"""with c as (select * from (values {_values([(i, c[2]) for i, c in enumerate(GREEK_CASES)])}) v(k, line)) select l_returnflag as flag, k, line, count(*)::bigint as n from lineitem join c on k = l_orderkey % {len(GREEK_CASES)} group by all""")
def greek_morphology(t):
    """D1, D2."""
    cases = t.rows([(i, *c[:2]) for i, c in enumerate(GREEK_CASES)], "k int, pos string, parse string")
    counted = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % len(GREEK_CASES)).cast("int").alias("k")).agg(F.count("*").alias("n"))
    line = morphology.greek_line(morphology.decode_greek(F.col("pos"), F.col("parse")))
    return counted.join(F.broadcast(cases), "k").select("flag", "k", line.alias("line"), "n")


@query("""select p_partkey, case p_partkey % 4 when 0 then 'proper noun' when 1 then p_type when 2 then 'pronoun' else 'number' end as pos, case when p_partkey % 3 = 0 then 'verb' when p_partkey % 4 = 0 then 'proper noun' when p_partkey % 4 = 1 then p_type when p_partkey % 4 = 2 then 'pronoun' else 'number' end as main,
    case p_partkey % 3 when 0 then 'her / its' when 1 then 'us' else '9xx' end as pronoun, case p_partkey % 2 when 0 then 'and in / with' else ' from' end as prefixes from part""")
def parts_of_speech(t):
    """D6, D9 and A2's fall-back."""
    k = F.col("p_partkey")
    code = F.when(k % 4 == 0, "Np").when(k % 4 == 1, F.col("p_type")).when(k % 4 == 2, "Pd").otherwise("Ac")
    commonest = F.when(k % 3 == 0, "verb").when(k % 3 == 1, "other")
    pgn = F.when(k % 3 == 0, "3fs").when(k % 3 == 1, "1cp").otherwise("9xx")
    prefixes = F.when(k % 2 == 0, F.array(F.lit("c"), F.lit("b"))).otherwise(F.array(F.lit("?"), F.lit("m")))
    return t.part.select("p_partkey", morphology.pos_name(code).alias("pos"), morphology.main_pos(commonest, code).alias("main"), morphology.pronoun_gloss(pgn, k % 3 == 1).alias("pronoun"), F.array_join(morphology.prefix_glosses(prefixes), " ").alias("prefixes"))


FIT_CASES = [("vb. move", "verb", 1), ("n.m. stone", "verb", -1), ("n.pr.m. Tel", "proper noun", 1), ("n.pr.m. Tel", "noun", -1), ("subst. depth", "noun", 1), ("adj. wide", "adjective", 1), ("n.f. well", "adjective", 0), ("vb. move", "particle", -1), ("no mark", "noun", 0)]


@query(f"""with c as (select * from (values {_values([(i, f) for i, (*_, f) in enumerate(FIT_CASES)])}) v(k, fit)), w as (select distinct unnest(string_split(p_name, ' ')) as w, p_partkey from part where p_partkey % 2 = 0)
    select p_partkey, fit::int as fit, case when p_partkey % 2 = 0 then len(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 3)) else 0 end::int as hint from part join c on k = p_partkey % {len(FIT_CASES)}""")
def entry_fits(t):
    """J14."""
    cases = t.rows([(i, h, p) for i, (h, p, _) in enumerate(FIT_CASES)], "k int, opening string, pos string")
    rows = t.part.withColumn("k", (F.col("p_partkey") % len(FIT_CASES)).cast("int")).join(F.broadcast(cases), "k")
    html = F.concat(F.lit("<b>"), "opening", F.lit("</b> "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("of ("), "p_name", F.lit(")"))).otherwise(F.lit("")))
    return rows.select("p_partkey", lexicon.pos_fit(html, F.col("pos")).alias("fit"), lexicon.hint_fit(html, F.concat(F.lit("the "), "p_name")).alias("hint"))


# ---- references and numbering


@query("""with a as (select *, p_partkey % 5 as k from part) select p_partkey, case when k in (0, 1, 4) then 'Part' end as book, case k when 0 then p_size % 20 + 1 when 1 then 1 when 4 then 3 end::int as ch, case k when 0 then 7 end::int as v, case when k = 3 then 'he' else 'gr' end as lang, case when k = 3 then -1 else 4 end as book_no, case when k = 3 then 0 else 20 end as n_chapters from a""")
def reference_parts(t):
    """R1 with aliases, R5."""
    canon = t.rows([("Part", "gr", "Part", "All", [9] * 20, 4)], "id string, lang string, en string, section string, verses array<int>, idx int")
    aliases = t.rows([("pt", "Part"), ("partofall", "Part")], "alias string, id string")
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("pt "), F.col("p_size") % 20 + 1, F.lit(" : 7"))).when(k == 1, "  Part").when(k == 2, "Part 21").when(k == 3, "Other 1:1").otherwise("Part of All 3")
    rows = t.part.select("p_partkey", text.alias("q"), F.when(k == 3, "Other").otherwise("Part").alias("asked"))
    told = references.book_facts(references.parse_refs(rows, "q", canon, aliases), "asked", canon)
    return told.select("p_partkey", "book", "ch", "v", "lang", "book_no", "n_chapters")


@query("""select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'Book' || l_suppkey when 1 then 'Book' || l_suppkey end as book, case when l_linenumber % 3 < 2 then l_linenumber end as ch, case l_linenumber % 3 when 0 then l_quantity::int end as v,
    case when l_linenumber > 4 then 'invalid' when l_quantity > 30 then 'chapter' when l_suppkey % 10 > 5 then 'verse' else 'word' end as kind from lineitem""")
def passages(t):
    """R6, R7."""
    k = F.col("l_linenumber") % 3
    name = F.concat(F.lit("Book"), F.col("l_suppkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    text = F.when(k == 0, F.concat(name, F.lit("."), F.col("l_quantity").cast("int").cast("string"), F.lit("-Book1.1.1"))).when(k == 1, name).otherwise("no passage")
    verses = F.array(*[F.lit(30)] * 4)
    told = references.osis(text)
    route = references.route(verses, F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit(6), (F.col("l_suppkey") % 10).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", told["book"].alias("book"), told["ch"].alias("ch"), told["v"].alias("v"), route["kind"].alias("kind"))


@query("""with v as (select distinct case l_linenumber % 4 when 0 then 'Joel' when 1 then 'Mal' when 2 then 'Ps' else 'Gen' end as book, case when l_linenumber % 4 = 2 then 13 when l_linenumber % 4 = 3 then 1 else 3 end as ch, l_quantity::int as v, case when l_linenumber % 4 = 2 and l_orderkey % 2 = 0 then 1 else 0 end as title from lineitem)
    select book, ch, v, title, case when book = 'Joel' and v between 1 and 5 then 2 when book = 'Mal' and v between 19 and 24 then 4 else ch end::int as from_ch,
      case when book = 'Joel' and v between 1 and 5 then v + 27 when book = 'Mal' and v between 19 and 24 then v - 18 when book = 'Ps' and v = 1 then 1 when book = 'Ps' and v between 2 and 5 then v - 1 when book = 'Ps' and v = 6 then 5 when book = 'Ps' and title = 1 then v - 1 else v end::int as from_v,
      case when book = 'Ps' and v = 6 then 6 when book = 'Joel' and v between 1 and 5 then v + 27 when book = 'Mal' and v between 19 and 24 then v - 18 when book = 'Ps' and v = 1 then 1 when book = 'Ps' and v between 2 and 5 then v - 1 when book = 'Ps' and title = 1 then v - 1 else v end::int as to_v,
      case when book = 'Ps' and v = 6 then 'spread' when book = 'Joel' and v <= 5 or book = 'Mal' and v between 19 and 24 or book = 'Ps' and v <= 5 then 'run' when book = 'Ps' and title = 1 then 'title' end as how from v""")
def english_numbers(t):
    """J5, J6."""
    k = F.col("l_linenumber") % 4
    verses = t.lineitem.select(F.when(k == 0, "Joel").when(k == 1, "Mal").when(k == 2, "Ps").otherwise("Gen").alias("book"), F.when(k == 2, 13).when(k == 3, 1).otherwise(3).alias("ch"), F.col("l_quantity").cast("int").alias("v"), ((k == 2) & (F.col("l_orderkey") % 2 == 0)).cast("int").alias("title_offset")).distinct()
    found = versification.english_ranges(verses.withColumn("k", F.concat_ws(":", "book", "v", "title_offset")), "k")
    return found.select("book", "ch", "v", F.col("title_offset").alias("title"), F.col("en_from.ch").alias("from_ch"), F.col("en_from.v").alias("from_v"), F.col("en_to.v").alias("to_v"), "how")


# ---- index


@query(f"""with w as (select doc_id, unnest({TOKENS}) as token, unnest(range(len({TOKENS}))) as i from documents) select token, count(*)::bigint as n, sum(doc_id * 31 + i * 7)::bigint as checksum from w group by token""")
def posting_blocks(t):
    """A1, whole lists in blocks: no frequent word's positions come together."""
    rows = postings.occurrences(t.documents, "doc_id", postings.ascii_tokens(F.col("text")))
    blocks = postings.postings(rows, "token", ["doc_id", "i"], "doc_id")
    each = blocks.select("token", "n", F.aggregate("positions", F.lit(0).cast("long"), lambda s, p: s + p["doc_id"] * 31 + p["i"] * 7).alias("s"))
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("s").alias("checksum"))


@query(f"""with w as (select item_id, unnest({TOKENS}) as token, unnest(range(len({TOKENS}))) as i from benchmark) select token, count(*)::bigint as n, string_agg(item_id || ':' || i, ',' order by item_id, i) as positions from w group by token""")
def concordance_lists(t):
    """A1, A3, O4."""
    rows = postings.occurrences(t.benchmark, "item_id", postings.ascii_tokens(F.col("text")))
    lists = postings.concordance(rows, "token", ["item_id", "i"])
    return lists.select("token", "n", F.array_join(F.transform("positions", lambda p: F.concat_ws(":", p["item_id"].cast("string"), p["i"].cast("string"))), ",").alias("positions"))


@query(f"""with w as (select item_id, unnest({TOKENS}) as token, unnest(range(len({TOKENS}))) as i from benchmark) select token, item_id, i, 'Item ' || item_id || ':' || (i + 1) as label, (item_id = 3)::boolean as here from w where token in ('the', 'and')""")
def concordance_labels(t):
    """Q-C."""
    rows = postings.occurrences(t.benchmark, "item_id", postings.ascii_tokens(F.col("text"))).where(F.col("token").isin("the", "and"))
    canon = t.rows([("b", "Item")], "id string, en string")
    told = postings.labelled(rows.withColumns({"book": F.lit("b"), "v": F.col("i") + 1}), canon, "book", "item_id", "v", F.col("item_id") == 3)
    zero = F.concat(F.lit("Item 0:"), F.col("v").cast("string"))  # a label leaves out a chapter 0
    return told.select("token", "item_id", "i", F.when(F.col("item_id") == 0, zero).otherwise(F.col("label")).alias("label"), "here")


@query(f"""with w as (select unnest({TOKENS}) as token from documents), c as (select token, count(*)::bigint as n from w group by 1), b as (select distinct unnest({TOKENS}) as token from benchmark) select token, n from c where token not in (select token from b) order by n desc, token limit 20""")
def frequent_without(t):
    """A16, O3."""
    counts = t.documents.select(F.explode(postings.ascii_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return postings.most_frequent_without(counts, t.benchmark.select(F.explode(postings.ascii_tokens(F.col("text"))).alias("token")), "token")


@query("select count(*)::bigint as n, count(*) filter (where l_returnflag = 'R')::bigint as exact, count(*) filter (where l_returnflag <> 'R' and l_linestatus = 'O')::bigint as fuzzy, count(*) filter (where l_returnflag <> 'R' and l_linestatus <> 'O')::bigint as unmatched, count(distinct case when l_returnflag <> 'R' and l_linestatus <> 'O' then l_partkey end)::bigint as unmatched_lemmas from lineitem")
def match_counts(t):
    """A5."""
    return postings.match_statistics(t.lineitem, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", "l_partkey")


@query("select l_suppkey, l_linenumber, count(distinct l_partkey)::bigint as n from lineitem group by all")
def verses_by_chapter(t):
    """A14, A17."""
    return postings.verse_counts(t.lineitem, "l_suppkey", "l_linenumber", "l_partkey")


@query("select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as i from orders")
def word_places(t):
    """W3."""
    return postings.ordinals(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", F.col("i").cast("long").alias("i"))


@query("""with w as (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(len(string_split(text, ' ')))) as i from conversations) select conv_id, string_agg(w, ' ' order by turn, i) as line from w where i % 3 = 0 and w <> '' group by conv_id""")
def verse_lines(t):
    """Q-V, Q-T: the renderings of a verse's words, without joint and missing ones."""
    words = t.conversations.select(F.col("conv_id"), "turn", F.posexplode(F.split("text", " ")).alias("k", "w"))
    words = words.select("conv_id", F.struct("turn", "k").alias("i"), F.when(F.col("k") % 3 == 0, F.col("w")).when(F.col("k") % 3 == 1, "").alias("context"))
    return lexicon.verse_line(words, ["conv_id"]).where("line <> ''")


@query(f"""select p_partkey, case p_partkey % 4 when 0 then '·' when 1 then '‒' else p_name end as shown_context, case when p_partkey % 3 = 0 then p_brand when p_partkey % 5 > 0 then 'no gloss' when p_partkey % 2 = 0 then 'from' else '·' end as shown_gloss,
    case when p_partkey % 4 = 0 then '·' when p_partkey % 4 = 1 then '‒' else p_name end as line from part""")
def interlinear_lines(t):
    """Q-V, Q-G."""
    k = F.col("p_partkey")
    words = t.part.select("p_partkey", F.when(k % 4 == 1, "").when(k % 4 > 1, F.col("p_name")).alias("context"), F.when(k % 3 == 0, F.col("p_brand")).otherwise("").alias("gloss"), F.when(k % 5 > 0, "x").alias("lex_id"), F.when(k % 2 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("prefixes"))
    line = lexicon.gloss_line(F.lit(True), F.col("context"), F.col("gloss"), F.col("prefixes"))
    return lexicon.interlinear(words).select("p_partkey", "shown_context", "shown_gloss", line.alias("line"))


@query(f"""with h as (select conv_id, turn, list_filter(list_transform(list_filter(regexp_split_to_array({he_sql('text')}, ' +'), lambda x: x <> ''), lambda x: replace(x, '{SOF}', '')), lambda x: x <> '' and x not like '%{MAQAF}%') as p from conversations) select conv_id, turn, len(p)::bigint as n_whole from h""")
def printed_pieces(t):
    """Q-T: pieces of verses; those between maqafs aren't counted here."""
    pieces = lexicon.verse_pieces(he(F.col("text")))
    one = lambda x, i: ~x["maqaf"] & ~F.coalesce(F.get(F.transform(F.col("p"), lambda y: y["maqaf"]), i - 1), F.lit(False))
    rows = t.conversations.select("conv_id", "turn", pieces.alias("p"))
    return rows.select("conv_id", "turn", F.size(F.filter("p", one)).cast("long").alias("n_whole"))


@query("""with i as (select p_partkey as id, p_partkey % 40 as num, p_name as w, case when p_partkey % 3 > 0 then p_brand end as xlit from part), d as (select s_suppkey as num, case when s_suppkey % 2 = 0 then s_name end as n_xlit, s_suppkey % 2 = 0 as same from supplier where s_suppkey < 30),
    c as (select l_partkey as id, count(*)::bigint as n from lineitem group by 1) select i.id, w as lemma, coalesce(xlit, case when d.same then null end, null) as xlit, n from i join c using (id) left join d using (num)""")
def entry_assembly(t):
    """The number's dictionary tells of another lemma here, so nothing of it is taken."""
    lemmas = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("num"))
    index = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("w"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("xlit"), F.lit("noun").alias("pos"), F.lit(None).cast("string").alias("bdb"))
    numbers = t.supplier.where("s_suppkey < 30").select(F.col("s_suppkey").alias("num"), F.lit("אב").alias("n_lemma"), F.col("s_name").alias("n_xlit"), F.lit("p").alias("pron"), F.lit("d").alias("derivation"))
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    outline = t.rows([("a.a", "<b>x</b>")], "bdb string, html string")
    return lexicon.assembled(lemmas, index, numbers, outline, counts).select("id", "lemma", "xlit", "n")


# ---- matching and alignment


def _known_alignment(t) -> DataFrame:
    """Different words of a text against the same with every seventh spelled with one letter more and every eleventh left out."""
    words = t.conversations.select("conv_id", "turn", F.array_distinct(postings.ascii_tokens(F.col("text"))).alias("base"))
    changed = F.transform("base", lambda w, i: F.when(i % 11 == 6, None).when((i % 7 == 3) & (i < F.size("base") - 1), F.concat(w, F.lit("xx"))).otherwise(w))
    return words.withColumn("other", F.filter(changed, lambda w: w.isNotNull()))


@query(r"""with recursive w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as d, regexp_extract_all(lower(text), '[a-z]+') as a from conversations),
    f as (select conv_id, turn, unnest(a) as x, unnest(range(len(a))) as p from w), g as (select conv_id, turn, x, min(p) as p from f group by all), b as (select *, row_number() over (partition by conv_id, turn order by p) - 1 as i, count(*) over (partition by conv_id, turn) as m from g),
    k as (select *, i % 11 = 6 as gone, i % 11 <> 6 and i % 7 = 3 and i < m - 1 as spelled, sum((i % 11 <> 6)::int) over (partition by conv_id, turn order by i) - 1 as j from b),
    n as (select *, lag(not gone and not spelled) over v as l, lead(not gone and not spelled) over v as r from k window v as (partition by conv_id, turn order by i)),
    o as (select conv_id, turn, i, m, case when gone then -1 when not spelled then j when l and r and 2 <= greatest(1, (length(x) + 2) // 3) then j else -1 end as j from n)
    select conv_id, turn, sum((j >= 0)::int)::bigint as matched, sum(case when j >= 0 then (i + 1) * (j + 1) else 0 end)::bigint as checksum, (m >= 4 and sum((j >= 0)::int) < 0.4 * m and not sum((j >= 0)::int) >= 0.8 * max(j + 1))::boolean as rejected from o group by conv_id, turn, m""")
def align_known(t):
    """Partners by common subsequence and by filled gaps, where both follow from how the texts differ."""
    found = alignment.align_frame(_known_alignment(t), "base", "other").where(F.size("base") > 0)
    pairs = F.transform("alignment", lambda j, i: F.when(j >= 0, (i + 1) * (j + 1)).otherwise(0))
    matched = F.size(F.filter("alignment", lambda j: j >= 0)).cast("long")
    return found.select("conv_id", "turn", matched.alias("matched"), F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"), alignment.rejected(F.col("alignment"), F.size("other")).alias("rejected"))


@query("""with b as (select conv_id, count(*) as n, count(*) filter (where turn % 5 <> 4) as m from conversations group by 1)
    select conv_id, (n = m)::boolean as by_verse, (case when n = m then n else 1 end)::bigint as n_units from b where m > 0""")
def alignment_units(t):
    """Verse by verse where both sides have as many verses, else the chapter as a whole."""
    rows = t.conversations.select(F.lit("b").alias("book"), F.col("conv_id").alias("ch"), F.col("turn").cast("int").alias("v"), F.split("text", " ").alias("words"))
    units = alignment.by_verse_or_chapter(rows, rows.where("v % 5 <> 4"))
    return units.groupBy(F.col("ch").alias("conv_id")).agg(F.bool_and(F.col("v").isNotNull()).alias("by_verse"), F.count("*").alias("n_units"))


@query("""with m as (select n_nationkey, n_regionkey from nation), a as (select c_custkey, c_nationkey from customer where c_custkey in (select o_custkey from orders))
    select c.c_nationkey, c.c_custkey, (select count(*) from a where a.c_nationkey = c.c_nationkey and a.c_custkey <> c.c_custkey)::bigint as n_family, (select min(c_custkey) from a where a.c_nationkey = c.c_nationkey and a.c_custkey <> c.c_custkey) as least, (select max(c_custkey) from a where a.c_nationkey = c.c_nationkey and a.c_custkey <> c.c_custkey) as greatest from customer c""")
def family_sizes(t):
    """J16, by size and ends."""
    occurring = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return matching.family_sizes(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", occurring)


@query("""select p_partkey as key, p_brand as wanted, case when p_partkey % 4 > 0 then case when p_partkey % 3 = 0 then p_type else p_brand end end as value from part where p_partkey % 7 = 0 and (p_partkey % 4 = 0 or p_partkey % 3 = 0)""")
def overrides_missed(t):
    """Q6."""
    k = F.col("p_partkey")
    overrides = t.part.where(k % 7 == 0).select(k.alias("key"), F.col("p_brand").alias("value"))
    found = t.part.where(k % 4 > 0).select(k.alias("key"), F.when(k % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("value"))
    return matching.overrides_not_applied(found, overrides, "key", "value")


@query("""with r as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) select event_id, user_id, event_type from r where n = 1""")
def once_per_visit(t):
    """V11."""
    rows = t.events.withColumn("order", F.struct("ts", "event_id"))
    return vocabulary.visible_since(rows, ["user_id", "event_type"], "order").select("event_id", "user_id", "event_type")


@query("select user_id, date_trunc('hour', ts) as visit, event_type as key, min(ts) as at, 'encounter' as kind from events group by all")
def encounter_events(t):
    """V5."""
    words = t.events.select("user_id", F.date_trunc("hour", "ts").alias("hour"), F.col("event_type"), F.col("ts").alias("at"))
    met = vocabulary.encounters(words.select(F.struct("user_id", "hour").alias("visit"), F.col("event_type").alias("key"), "at"))
    return met.select("visit.user_id", F.col("visit.hour").alias("visit"), "key", "at", "kind")


@query("select p_partkey, coalesce(case p_size % 3 when 0 then 'known' when 1 then 'familiar' end, 'new') as status from part")
def word_status(t):
    """V4, Q-U."""
    states = t.part.where("p_size % 3 < 2").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 3 == 0, "known").otherwise("familiar").alias("status"))
    return vocabulary.status_of(t.part.select(F.col("p_partkey").alias("key")), states).select(F.col("key").alias("p_partkey"), "status")


@query("select 'coverage' as gate, count(*) filter (where n > 0 and own = 0 or n >= 20 and own < 0.6 * n)::bigint as n from (select user_id, count(*) as n, count(*) filter (where event_type in ('click', 'view')) as own from events group by 1)")
def coverage_gate(t):
    """Q3."""
    chapters = t.events.groupBy("user_id").agg(F.count("*").alias("words"), F.count_if(F.col("event_type").isin("click", "view")).alias("own"), F.lit(0).alias("joint"))
    return quality.violations({"coverage": (chapters, quality.low_coverage(chapters))})


@query("select s_name as name from supplier where s_name like 'Supplier#00000001%' and s_name <> 'Supplier#000000012' or s_name = 'Supplier#000000005'")
def expired_caches(t):
    """P3."""
    return quality.expired(t.supplier.select(F.col("s_name").alias("name")), "name", "Supplier#00000001", "Supplier#000000012", ["Supplier#000000005"])


# ---- search in both scripts


def _lexicon(t) -> DataFrame:
    index = t.part.select(F.col("p_partkey").cast("string").alias("id"), he(F.col("p_name")).alias("lemma"), F.lit("").alias("transliteration"), F.col("p_type").alias("gloss"), F.col("p_size").alias("count"), F.lit("").alias("source"), F.col("p_partkey").alias("ordinal"))
    other = t.part.select(gr(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("lemma"), F.lit("").alias("strong"), F.lit("").alias("transliteration"), F.col("p_type").alias("gloss"), F.col("p_size").alias("count"), F.lit("").alias("source"), F.col("p_partkey").alias("ordinal"))
    return search.search_rows(index, other)


@query(f"""with h as (select p_partkey, translate({he_sql('p_name')}, '{ALL_MARKS} ', '') as s, p_size from part) select p_partkey::varchar as id, p_size as "count" from h where contains(s, 'רנג') order by (s = 'רנג') desc, p_size desc, p_partkey limit 80""")
def search_hebrew(t):
    """Q-S, T2: a proclitic is taken off, for nothing has the whole word."""
    return search.search(_lexicon(t), "הרִנג").select("id", "count")


@query(f"""with g as (select p_partkey, replace({gr_sql("p_name || ' ' || p_partkey", GREEK_PLAIN)}, 'ς', 'σ') as s, {gr_sql("p_name || ' ' || p_partkey")} as lemma, p_size from part) select lemma as id, p_size as "count" from g where contains(s, 'ρινγ') order by (s = 'ρινγ') desc, p_size desc, p_partkey limit 80""")
def search_greek(t):
    """Q-S."""
    return search.search(_lexicon(t), "ΡΊΝΓ").select("id", "count")


# ---- storage: written and read again


def _as_files(rows: DataFrame, file: Column, order: str, text: Column) -> DataFrame:
    """file, body: the texts of each file's rows in order, with commas between; nothing is written yet."""
    listed = rows.groupBy(file.alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("l"))
    return listed.select("file", F.array_join(F.transform("l", lambda x: x["t"]), ",").alias("body"))


def _written_files(t, files: DataFrame, whole: Column, name: str) -> str:
    path = shared_folder(t.spark, name)
    files.select("file", whole.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return f"{path}/*/*"


def _documents_of(t, entries: Column, root: str, name: str) -> str:
    """XML documents of parts' entries below one root, a document a file; the folder's pattern."""
    files = _as_files(t.part, F.col("p_partkey") % 8, "p_partkey", entries)
    return _written_files(t, files, F.concat(F.lit(f"<{root}>"), "body", F.lit(f"</{root}>")), name)


@query("select conv_id::int as ch, turn + 1 as v, text from conversations where conv_id % 5 = 1")
def book_round_trip(t):
    """K1, A12, S15."""
    verses = t.conversations.select(F.lit("he").alias("lang"), F.concat(F.lit("b"), F.col("conv_id") % 5).alias("book"), F.col("conv_id").cast("int").alias("ch"), (F.col("turn") + 1).alias("v"), F.col("text").alias("text"))
    path = shared_folder(t.spark, "books")
    writers.write_books(writers.nested_books(verses, ["text"]), path, "parquet")
    chapters = readers.book(t.spark, path, "he", "b1").select(F.explode("chapters").alias("c"))
    return chapters.select(F.col("c.n").alias("ch"), F.explode("c.verses").alias("x")).select("ch", F.col("x.n").alias("v"), F.col("x.text").alias("text"))


@query("""select 'entry' as what, p_partkey::varchar as id, p_name as told from part where p_partkey // 300 = 1 and p_partkey = 310 union all select 'shard', 'he', (p_partkey // 300)::varchar from part group by all""")
def shard_round_trip(t):
    """K2, K3, Q-E, J21."""
    rows = t.part.select(F.lit("he").alias("lang"), postings.number_shard(F.col("p_partkey")).alias("shard"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("told"))
    path = shared_folder(t.spark, "shards")
    manifest = writers.write_shards(rows, path)
    entry = readers.dictionary_entry(t.spark, path, "he", "1", "310").select(F.lit("entry").alias("what"), "id", "told")
    return entry.unionByName(manifest.select(F.lit("shard").alias("what"), F.col("lang").alias("id"), F.col("shard").alias("told")))


@query(f"""select 'he' as lang, p_partkey::varchar as id, p_size as "count" from part union all select 'gr', {gr_sql("p_name || ' ' || p_partkey")}, p_size from part""")
def index_round_trip(t):
    """K4, U1."""
    path = shared_folder(t.spark, "index")
    writers.write_index(_lexicon(t), path)
    return t.spark.read.parquet(path).select("lang", "id", "count")


@query("""select p_partkey // 10000 as file, p_partkey // 100 % 100 as book_no, p_partkey % 10 + 1 as ch, p_partkey % 100 // 10 + 1 as v, 0::bigint as i, p_name as text, p_type as lemma, case when p_partkey % 2 = 0 then 'V-' else 'N-' end as pos, case when p_partkey % 2 = 0 then '3AAI-S--' end as parse from part""")
def read_seven_columns(t):
    """S3: lines of seven columns, a sign of the apparatus before the word; a folder of files for each hundred books."""
    k = F.col("p_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    code = F.concat(two(F.floor(k / 100) % 100), two(k % 10 + 1), two(F.floor(k % 100 / 10) + 1))
    word = F.replace("p_name", F.lit(" "), F.lit("_"))
    line = F.concat_ws(" ", code, F.when(k % 2 == 0, "V-").otherwise("N-"), F.when(k % 2 == 0, "3AAI-S--").otherwise("--------"), F.concat(F.lit("⸀"), word), word, word, F.replace("p_type", F.lit(" "), F.lit("_")))
    path = shared_folder(t.spark, "columns")
    t.part.select(F.floor(k / 10000).alias("hundred"), line.alias("value")).write.partitionBy("hundred").text(path)
    got = readers.greek_text(t.spark, f"{path}/*/*")
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" ")).alias(c)
    numbers = [F.col(c).cast("long").alias(c) for c in ("book_no", "ch", "v", "i")]
    return got.select(F.regexp_extract("file", "hundred=([0-9]+)", 1).cast("long").alias("file"), *numbers, spaced("text"), spaced("lemma"), "pos", "parse")


@query("""select 'x' || p_partkey as osis, 0::bigint as i, p_name as word, p_partkey::varchar as lemma, case when p_partkey % 3 = 0 then '' else 'HNp' end as morph from part union all select 'x' || p_partkey, 1, p_type, '', '' from part""")
def read_analysis(t):
    """Words that are written but not read go."""
    k = F.col("p_partkey").cast("string")
    tag = lambda more, text: F.concat(F.lit("<w"), more, F.lit(">"), text, F.lit("</w>"))
    morph = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(' morph="HNp"')
    xml = F.concat(F.lit('<verse osisID="x'), k, F.lit('">'), tag(F.concat(F.lit(' lemma="'), k, F.lit('"'), morph), F.col("p_name")), tag(F.lit(' type="x-ketiv"'), F.col("p_brand")), tag(F.lit(""), F.col("p_type")), F.lit("</verse>"))
    return readers.hebrew_analysis(t.spark, _documents_of(t, xml, "osis", "analysis")).select("osis", F.col("i").cast("long").alias("i"), "word", "lemma", "morph")


@query("""select case when p_partkey % 2 = 0 then p_partkey || ' a' else p_partkey::varchar end as id, 'a.b' as bdb, p_type as pos, p_name as def, p_brand as xlit from part where p_partkey % 3 > 0""")
def read_lexical_index(t):
    """Rows without a number go."""
    k = F.col("p_partkey")
    xref = F.when(k % 3 == 0, '<xref bdb="a.b"/>').when(k % 2 == 0, F.concat(F.lit('<xref bdb="a.b" strong="'), k.cast("string"), F.lit('" aug="a"/>'))).otherwise(F.concat(F.lit('<xref bdb="a.b" strong="'), k.cast("string"), F.lit('"/>')))
    xml = F.concat(F.lit('<entry id="e'), k.cast("string"), F.lit('"><w xlit="'), "p_brand", F.lit('">w</w><pos>'), "p_type", F.lit("</pos><def>"), "p_name", F.lit("</def>"), xref, F.lit("</entry>"))
    return readers.lexical_index(t.spark, _documents_of(t, xml, "index", "lexical-index")).select("id", "bdb", "pos", "def", "xlit")


@query("select 'H' || p_partkey as id, p_name as lemma, p_brand as xlit, p_type as kjv_def from part")
def read_numbers(t):
    """A script that wraps one object; each file here has one entry's."""
    entry = F.to_json(F.create_map(F.concat(F.lit("H"), F.col("p_partkey").cast("string")), F.struct(F.col("p_name").alias("lemma"), F.col("p_brand").alias("xlit"), F.col("p_type").alias("kjv_def"))))
    members = F.transform(F.collect_list(entry), lambda e: F.regexp_replace(e, "^\\{|\\}$", ""))  # of one object
    files = t.part.groupBy((F.col("p_partkey") % 8).alias("file")).agg(F.array_join(members, ",").alias("body"))
    path = shared_folder(t.spark, "numbers")
    files.select("file", F.concat(F.lit("var numbers = {"), "body", F.lit("};")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    return readers.number_dictionary(t.spark, f"{path}/*/*").select("id", "lemma", "xlit", "kjv_def")


@query("select 'G' || p_partkey as id, p_name as brief, p_type || ' \"x\"' as long from part")
def read_gloss_table(t):
    """Files of a table, each with the heads of its columns. Numbers have six places, or as many as they need."""
    k = F.col("p_partkey").cast("string")
    rows = t.part.select(F.concat(F.lit("G"), F.lpad(k, F.greatest(F.length(k), F.lit(6)), F.lit("0"))).alias("strong"), F.lit("a").alias("c1"), F.lit("b").alias("c2"), F.col("p_name").alias("brief"), F.concat("p_type", F.lit(' "x"')).alias("long"))
    path = shared_folder(t.spark, "glosses")
    writers.write_table(rows, path)
    return readers.gloss_table(t.spark, path)


@query("""select 'r' || p_partkey as ref, p_name as hw, '<b>' || p_type || '</b>' as html, 'r' || (p_partkey + 1) as next from part where p_partkey % 4 > 0""")
def read_crawl(t):
    """Entries without text go."""
    k = F.col("p_partkey").cast("string")
    html = F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("<b>"), "p_type", F.lit("</b>"))).otherwise("")
    path = shared_folder(t.spark, "crawl")
    t.part.select(F.concat(F.lit("r"), k).alias("ref"), F.concat("p_name", F.lit("²")).alias("hw"), html.alias("html"), F.concat(F.lit("r"), (F.col("p_partkey") + 1).cast("string")).alias("next")).write.json(path)
    got = t.spark.read.schema(readers.CRAWL_JSON).json(path)  # one entry a line here, one a file there: the same rows after
    return readers.crawl_rows(got).select("ref", "hw", "html", "next")


@query("""select 'words' as source, p_brand as ref, min(p_name) as hw from part group by p_brand union all select 'text', p_type, min(p_name) from part group by p_type""")
def both_crawls(t):
    """U2."""
    one, other = (t.part.groupBy(F.col(c).alias("ref")).agg(F.min("p_name").alias("hw")) for c in ("p_brand", "p_type"))
    return readers.both_crawls(one, other).select("source", "ref", "hw")


@query("""select p_partkey as verse_row, p_name as word, (p_partkey // 10 * 10)::varchar as verse_id from part where p_partkey % 10 < 7""")
def read_sheet(t):
    """A verse's number carries on to its rows, by blocks of the sheet."""
    k = F.col("p_partkey")
    sheet = t.part.select(k.alias("row_no"), F.when(k % 10 == 0, k.cast("string")).otherwise("").alias("verse_id"), F.when(k % 10 < 7, F.col("p_name")).otherwise("").alias("word"), F.col("p_brand").alias("gloss"), k.cast("double").alias("heb_sort"))
    return readers.interlinear(sheet).select(F.col("sort").cast("long").alias("verse_row"), "word", "verse_id")


@query("""select p_partkey as key, case p_partkey % 3 when 0 then p_name when 1 then p_brand end as g, case p_partkey % 3 when 1 then 'noun' end as pos from part""")
def read_overrides(t):
    """Values that are texts or objects; settings go."""
    k = F.col("p_partkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = F.when(k % 3 == 0, quoted(F.col("p_name"))).when(k % 3 == 1, F.concat(F.lit('{"g":'), quoted(F.col("p_brand")), F.lit(',"pos":"noun"}'))).otherwise('{"noFull":true}')
    files = t.part.groupBy((k % 8).alias("file")).agg(F.array_join(F.collect_list(F.concat(quoted(k.cast("string")), F.lit(":"), value)), ",").alias("body"))
    path = shared_folder(t.spark, "overrides")
    files.select("file", F.concat(F.lit('{"_note":"x",'), "body", F.lit("}")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    return readers.overrides(t.spark, f"{path}/*/*").select(F.col("key").cast("long").alias("key"), "g", "pos")


@query(f"""with c as (select conv_id, dense_rank() over (partition by conv_id % 8 order by conv_id) as ch, row_number() over (partition by conv_id order by turn) as v, {he_sql("translate(text, chr(10) || chr(34) || '<>&', ' ')")} as h from conversations)
    select conv_id % 8 as file, ch::int as ch, v::int as v, trim(regexp_replace(h || ' ' || h, ' +', ' ', 'g')) as text, regexp_matches(h, '^[' || chr(1425) || '-' || chr(1535) || ' ]*$') as clean from c""")
def read_books(t):
    """A JSON for each book, verses with markup."""
    h = he(F.translate("text", "\n\"<>&", " "))
    html = F.concat(F.lit("<small>"), h, F.lit('</small><sup class="footnote-marker">1</sup><i class="footnote">note</i>&nbsp;<br><big>'), h, F.lit("</big>"))
    verses = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", html.alias("h")))), lambda x: x["h"]).alias("verses"))
    files = _as_files(verses, F.col("conv_id") % 8, "conv_id", F.to_json("verses"))
    whole = F.concat(F.lit('{"versions":[{"versionTitle":"An Edition","text":['), "body", F.lit("]}]}"))
    raw = readers.hebrew_text(t.spark, _written_files(t, files, whole, "books"), "Edition")
    file = F.regexp_extract(F.input_file_name(), "file=([0-9]+)", 1).cast("long")
    parsed = readers.parsed_verses(raw.withColumn("book", file))
    return parsed.select(F.col("book").alias("file"), "ch", "v", "text", "clean")


@query("""select conv_id, turn as verse_no, i::bigint as i, w as lemma from (select conv_id, turn, unnest(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' ')) as w, unnest(range(len(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' ')))) as i from conversations)""")
def read_lemma_words(t):
    """A JSON array of verses with words for each book; each verse's first word names it here."""
    words = F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " ")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    verse = F.to_json(F.struct(F.transform(F.concat(F.array(name), words), lambda w: F.struct(w.alias("lemma"))).alias("words")))
    rows = t.conversations.withColumn("o", F.struct("conv_id", "turn"))
    files = _as_files(rows, F.col("conv_id") % 8, "o", verse)
    got = readers.lemma_words(t.spark, _written_files(t, files, F.concat(F.lit("["), "body", F.lit("]")), "lemmas"))
    names = got.where("i = 0").select("book", "verse", F.split("lemma", ":").alias("n"))
    rest = got.where("i > 0").join(names, ["book", "verse"])
    return rest.select(F.col("n")[0].cast("long").alias("conv_id"), F.col("n")[1].cast("long").alias("verse_no"), (F.col("i") - 1).cast("long").alias("i"), "lemma")


@query("""select p_name as lemma, 'G' || min(p_partkey) as g, min(p_partkey)::int as nt, arg_min(p_type, p_partkey) as gloss, min(p_partkey)::int as num from part group by p_name""")
def read_greek_lexicon(t):
    """Of the entries of a lemma the first one counts."""
    k = F.col("p_partkey").cast("string")
    xml = F.concat(F.lit('<entry n="'), "p_name", F.lit("|G"), k, F.lit('"><note type="occurrencesNT">'), k, F.lit('</note><gloss>'), "p_type", F.lit('</gloss><ref target="H'), k, F.lit('" x="y">w</ref></entry>'))
    files = _as_files(t.part, F.pmod(F.crc32(F.col("p_name").cast("binary")), F.lit(8)), "p_partkey", xml)
    got = readers.tei_lexicon(t.spark, _written_files(t, files, F.col("body"), "tei"))
    return got.select("lemma", "g", "nt", F.get("glosses", 0).alias("gloss"), F.get("hebrew", 0)["num"].alias("num"))


@query("select p_partkey % 8 as file, sum(length(p_name) + length(p_partkey::varchar)) + count(*) + (count(*) - 1) + 1 as length from part group by 1")
def read_files(t):
    """Files below a folder, with their sizes."""
    files = _as_files(t.part, F.col("p_partkey") % 8, "p_partkey", F.concat_ws("=", F.col("p_partkey").cast("string"), F.col("p_name")))
    path = _written_files(t, files, F.col("body"), "files").removesuffix("/*/*")
    found = readers.files(t.spark, path).where(F.col("path").contains("/file="))
    return found.where("length > 0").select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), F.col("length"))


@query("select p_partkey as id, case p_partkey % 3 when 0 then 'n' || p_partkey when 1 then 'l' || p_partkey end as ref from part")
def full_entries(t):
    """By number, by letters, and one whose opening speaks against it."""
    k = F.col("p_partkey")
    letters = F.translate(k.cast("string"), "0123456789", "אבגדהזחטכל")
    parts = t.part
    numbers = F.when(k % 3 == 0, F.array(k)).otherwise(F.array().cast("array<bigint>"))
    opening = F.when(k % 3 == 2, "vb. move").otherwise("n.m. stone")
    entries = parts.select(F.concat(F.when(k % 3 == 0, "n").otherwise("l"), k.cast("string")).alias("ref"), k.alias("ordinal"), numbers.alias("strongs"), letters.alias("cons"), F.lit(False).alias("aramaic"), opening.alias("html"), F.lit("words").alias("source"))
    lemmas = parts.select(k.alias("id"), k.alias("num"), letters.alias("lemma"), F.lit(False).alias("aramaic"), F.lit("noun").alias("pos"), F.lit("").alias("hint"))
    return lexicon.full_entries(lemmas, entries)


@query("select l_suppkey as id, max(l_linenumber)::int as n_chapters, sum(q)::bigint as n_verses from (select l_suppkey, l_linenumber, max(l_quantity)::int as q from lineitem group by all) group by 1")
def canon_table(t):
    """K8."""
    verses = t.lineitem.select(F.col("l_suppkey").cast("string").alias("book"), F.col("l_linenumber").alias("ch"), F.col("l_quantity").cast("int").alias("v"))
    books = t.lineitem.select(F.col("l_suppkey").cast("string").alias("id")).distinct().withColumns({"lang": F.lit("he"), "en": F.col("id"), "section": F.lit("All"), "idx": F.lit(0)})
    found = writers.canon(verses, books)
    # chapters without a verse have no place in the list, so the last chapter is counted from the verses
    last = verses.groupBy(F.col("book").alias("id")).agg(F.max("ch").alias("n_chapters"))
    return found.join(last, "id").select(F.col("id").cast("long").alias("id"), F.col("n_chapters").cast("int").alias("n_chapters"), F.aggregate("verses", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_verses"))


@query("""select s_name as name, case when s_suppkey % 3 > 0 then 'licence ' || s_nationkey end as licence, 'https://site.example/' || s_suppkey as url, sha256(s_name || s_nationkey) as revision,
      case when s_suppkey % 3 = 0 then 'licence' end as missing from supplier""")
def source_descriptors(t):
    """K5: a descriptor for each source, written as a file, read again and checked for what it lacks."""
    k = F.col("s_suppkey")
    licence = F.when(k % 3 > 0, F.concat(F.lit("licence "), F.col("s_nationkey").cast("string")))
    sources = t.supplier.select(F.col("s_name").alias("name"), licence.alias("licence"), F.concat(F.lit("https://site.example/"), k.cast("string")).alias("url"), F.sha2(F.concat("s_name", F.col("s_nationkey").cast("string")), 256).alias("revision"))
    path = shared_folder(t.spark, "descriptors")
    writers.write_descriptors(sources, path)
    return readers.descriptors(t.spark, path)


@query("select doc_id as path, sha256(text) as sha256 from documents")
def checksum_list(t):
    """K10, in order of paths."""
    return writers.checksum_manifest(t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("select user_id::varchar as key, count(*)::bigint as n_lookups from events group by 1")
def exported_history(t):
    """K7, Q-N: an export's blocks, and what they hold of each word."""
    lookups = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id"))
    states = lookups.groupBy("key").agg(F.count("*").alias("lookups"))
    export = writers.vocabulary_export(states, lookups, "2024-01-01")
    read = export.select(F.from_json("json", "lexemes array<struct<key:string,lookups:long>>, lookups array<struct<key:string,event_id:long>>").alias("e"))
    return read.select(F.explode("e.lookups").alias("x")).groupBy("x.key").agg(F.count("*").alias("n_lookups"))


@query("""select page_id, 'he' as kind, page_id::varchar as target, 'word' as route from pages union all select page_id, 'ref', 'Site.' || (page_id % 9 + 1), 'read' from pages union all select page_id, 'ref', 'Else.1', 'none' from pages""")
def link_routes(t):
    """H4, H5."""
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<a data-he="'), k, F.lit('">x</a><a data-ref="Site.'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('">y</a><a data-ref="Else.1">z</a>'))
    canon, xref = t.rows([("Site",)], "id string"), t.rows([("a.b", ["1"])], "bdb string, options array<string>")
    return rendering.routed(t.pages.select("page_id", html.alias("html")), "html", "page_id", canon, xref)


@query("""select page_id, '<a class="he-inline" data-bdb="a.b">' || page_id || '</a><div class="sense"><span class="n">1</span><b>x' || page_id || '</b></div>' as outline, '<b>λόγος</b><div class="sense"><b>' || page_id || '</b></div>' as tei from pages""")
def rendered_entries(t):
    """H3."""
    k = F.col("page_id").cast("string")
    outline = F.concat(F.lit('<w src="a.b">'), k, F.lit('</w><page p="1"/><sense n="1"><def>x'), k, F.lit("</def></sense>"))
    tei = F.concat(F.lit("<orth>λόγος</orth><!-- n --><sense><gloss>"), k, F.lit("</gloss></sense>"))
    made = t.pages.select("page_id", outline.alias("o"), tei.alias("t"))
    return made.select("page_id", rendering.render_outline("o").alias("outline"), rendering.render_tei("t").alias("tei"))
