"""Passage references over a canon table: parsing, validity, labels, neighbours.

A canon is a DataFrame (id, lang, en, section, verses array<int>, idx int), one row per book in order; aliases a
DataFrame (alias, id). Both are small tables, which are broadcast if their rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import broadcast_if_few

# A book's number, the word that may stand inside its name, and what parts chapter and verse.
BOOK_NUMBERS, INNER_WORD, PARTING = ["1", "2", "3"], "of", [":", ".", ","]


def _number(c: Column) -> Column:
    return F.expr("null").cast("int") if c is None else F.when(c != "", c.try_cast("int"))


def ref_tokens(text: Column) -> Column:
    """Words, numbers and other signs of a reference, in order; blanks part them."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+|[^ \\t\\n\\x0b\\f\\ra-z0-9]"), F.lit(0))


def parsed_ref(tokens: Column) -> Column:
    """struct<name,ch,v> of a reference's tokens; null if they aren't one. ch and v are text, null if not told.

    A name is a word, perhaps with a book's number before it or with "of" and another word after it. A chapter's number
    may follow, and a parting sign with a verse's number.
    """
    at = lambda i: F.get(tokens, i)
    is_word, is_number = (lambda t, p=p: F.coalesce(t.rlike(p), F.lit(False)) for p in ("^[a-z]", "^[0-9]"))
    first = F.coalesce(at(F.lit(0)).isin(BOOK_NUMBERS), F.lit(False)).cast("int")
    long = F.coalesce(at(first + 1) == INNER_WORD, F.lit(False)) & is_word(at(first + 2))
    n_name = first + F.when(long, 3).otherwise(1)
    rest = F.slice(tokens, n_name + 1, F.greatest(F.size(tokens) - n_name, F.lit(0)))
    has_ch = is_number(F.get(rest, 0)).cast("int")
    verse = F.slice(rest, has_ch + 1, F.greatest(F.size(rest) - has_ch, F.lit(0)))
    whole = (F.size(verse) == 0) | (F.size(verse) == 2) & F.get(verse, 0).isin(PARTING) & is_number(F.get(verse, 1))
    name = F.array_join(F.slice(tokens, 1, n_name), "")
    found = F.struct(name.alias("name"), F.when(has_ch == 1, F.get(rest, 0)).alias("ch"), F.get(verse, 1).alias("v"))
    return F.when(is_word(at(first)) & whole, found)


def parse_refs(df: DataFrame, text_col: str, canon: DataFrame, aliases: DataFrame) -> DataFrame:
    """df with book, ch, v: of what text_col says, or all null. A name may be an alias or an id; the chapter is 1 if it isn't told."""
    names = aliases.select("alias", "id").unionByName(canon.select(F.lower("id").alias("alias"), "id").join(aliases, "alias", "left_anti"))
    known = broadcast_if_few(names.join(canon.select("id", "verses"), "id"))
    told = df.withColumn("_tokens", ref_tokens(F.col(text_col))).withColumn("_ref", parsed_ref(F.col("_tokens")))
    ch, v = (F.col(f"_ref.{x}").try_cast("int") for x in ("ch", "v"))
    joined = told.withColumns({"_ch": F.when(F.col("_ref.ch").isNull(), 1).otherwise(ch), "_v": v})
    joined = joined.join(known, F.col("_ref.name") == F.col("alias"), "left")
    ok = F.col("_ch").between(1, F.size("verses"))
    ok &= F.col("_ref.v").isNull() | F.col("_v").between(1, F.get("verses", F.col("_ch") - 1))
    return joined.select(*df.columns, *[F.when(ok, F.col(c)).alias(name) for c, name in (("id", "book"), ("_ch", "ch"), ("_v", "v"))])


def valid_ref(verses: Column, ch: Column, v: Column | None = None) -> Column:
    """Whether the chapter (and verse) exists; verses: the book's, null if there is no such book."""
    ok = F.coalesce((ch == F.floor(ch)) & ch.between(1, F.size(verses)), F.lit(False)) & verses.isNotNull()
    return ok if v is None else ok & F.coalesce((v == F.floor(v)) & v.between(1, F.get(verses, ch.cast("int") - 1)), F.lit(False))


def ref_label(en: Column, book_id: Column, ch: Column, v: Column) -> Column:
    """'Name 3:4'; the id where the book is unknown."""
    tail = F.concat(F.when(ch.isNotNull() & (ch != 0), F.concat(F.lit(" "), ch)).otherwise(F.lit("")), F.when(v.isNotNull() & (v != 0), F.concat(F.lit(":"), v)).otherwise(F.lit("")))
    return F.when(en.isNull(), book_id).otherwise(F.concat(en, tail))


def chapters(canon: DataFrame) -> DataFrame:
    """All chapters with their neighbours within the language: lang, book, ch, prev, next (struct<book,ch>)."""
    rows = canon.select("lang", "idx", F.col("id").alias("book"), F.explode(F.sequence(F.lit(1), F.size("verses"))).alias("ch"))
    order = Window.partitionBy("lang").orderBy("idx", "ch")
    here = F.struct("book", "ch")
    return rows.select("lang", "idx", "book", "ch", F.lag(here).over(order).alias("prev"), F.lead(here).over(order).alias("next"))


def osis(c: Column) -> Column:
    """struct<book,ch,v> of 'Id.c.v' or 'Id.c', a range's beginning; null if it isn't one."""
    one = F.regexp_extract(c, r"^([^-]*)", 1)
    part = lambda i: F.regexp_extract(one, r"^(\w+)\.([0-9]+)(?:\.([0-9]+))?", i)
    return F.when(part(1) != "", F.struct(part(1).alias("book"), _number(part(2)).alias("ch"), _number(part(3)).alias("v")))


def route(verses: Column, ch: Column, v: Column, word_count: Column, i: Column) -> Column:
    """struct<kind,notice> of a deep link: word, verse or chapter, and what was wrong with it."""
    bad_v = v.isNotNull() & ~valid_ref(verses, ch, v)
    bad_i = i.isNotNull() & ~F.coalesce(i.between(0, word_count - 1), F.lit(False))
    kind = F.when(~valid_ref(verses, ch), F.lit("invalid")).when(v.isNull() | bad_v, F.lit("chapter")).when(i.isNull() | bad_i, F.lit("verse")).otherwise(F.lit("word"))
    return F.struct(kind.alias("kind"), F.when(bad_v, F.lit("no such verse")).when(bad_i & v.isNotNull(), F.lit("no such word")).alias("notice"))


def book_facts(df: DataFrame, book_col: str, canon: DataFrame) -> DataFrame:
    """df with lang (he for an unknown book), book_no (its place from 0; -1), n_chapters (0)."""
    known = broadcast_if_few(canon.select(F.col("id").alias("_id"), "lang", F.col("idx").alias("book_no"), F.size("verses").alias("n_chapters")))
    joined = df.join(known, F.col(book_col) == F.col("_id"), "left").drop("_id")
    unknown = {"lang": "he", "book_no": -1, "n_chapters": 0}
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in unknown.items()})
