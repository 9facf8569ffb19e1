"""Inverted index, shards, manifests, index rows, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import broadcast_if_few

WORD = "[a-z]+"


def ascii_tokens(text: Column) -> Column:
    """Runs of a to z of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def occurrences(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """doc, i (from 0), token."""
    return docs.select(doc, F.posexplode(tokens).alias("i", "token"))


def concordance(rows: DataFrame, lemma: str, position: list[str]) -> DataFrame:
    """lemma, n, positions (array of structs in corpus order). For lemmas whose lists fit in a row; see postings for all."""
    return rows.groupBy(lemma).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*position))).alias("positions"))


def postings(rows: DataFrame, lemma: str, position: list[str], block: str, n_blocks: int = 64) -> DataFrame:
    """The concordance cut into blocks of the corpus (by the hash of the column block), so that no frequent lemma's list is gathered in one place."""
    cut = rows.withColumn("block", F.pmod(F.xxhash64(block), F.lit(n_blocks)).cast("int"))
    return cut.groupBy(lemma, "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*position))).alias("positions"))


def first_and_last(rows: DataFrame, lemma: str, position: list[str]) -> DataFrame:
    """lemma, n, first, last: a summary that combines before it shuffles."""
    here = F.struct(*position)
    return rows.groupBy(lemma).agg(F.count("*").alias("n"), F.min(here).alias("first"), F.max(here).alias("last"))


def pair_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def frequent(rows: DataFrame, key: str, more_than: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def number_shard(number: Column, width: int = 300) -> Column:
    return F.floor(number / width)


def manifest(rows: DataFrame, shard: str) -> DataFrame:
    """The shards that are written, in order."""
    return rows.select(shard).distinct().orderBy(shard)


def data_files(shards: DataFrame, books: DataFrame, fixed: list[str], kinds: tuple[str, ...] = ("lex", "conc")) -> DataFrame:
    """path: of everything that is published: shards (lang, shard) of each kind, books (lang, book), fixed ones."""
    spark = shards.sparkSession
    by_shard = shards.select(F.explode(F.array(*[F.concat_ws("/", F.lit(k), F.concat_ws("-", "lang", F.col("shard").cast("string"))) for k in kinds])).alias("path"))
    by_book = books.select(F.concat_ws("/", "lang", "book").alias("path"))
    return by_shard.unionByName(by_book).unionByName(spark.createDataFrame([(p,) for p in fixed], "path string"))


def distinct_in_order(values: Column, most: int = 3, sep: str = ", ") -> Column:
    return F.array_join(F.slice(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), 1, most), sep)


def coverage(rows: DataFrame, levels: list[str], words: Column, own: Column, joint: Column) -> DataFrame:
    """levels (rolled up), words, own, joint, none, coverage (of own and joint, three places)."""
    total = rows.rollup(*levels).agg(F.sum(words).alias("words"), F.sum(own).alias("own"), F.sum(joint).alias("joint"))
    return total.withColumn("none", F.col("words") - F.col("own") - F.col("joint")).withColumn("coverage", F.round((F.col("own") + F.col("joint")) / F.col("words"), 3))


def percent(part: Column, whole: Column) -> Column:
    """Of a hundred, two places, half up."""
    return F.floor(part * 10000 / whole + 0.5) / 100


def ordinals(rows: DataFrame, by: list[str], order: list[str], out: str = "i") -> DataFrame:
    """Place within the group, from 0."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def densify(verses: DataFrame, by: list[str], verse: str) -> DataFrame:
    """All verses 1 .. max of each group, those that are missing with nulls in the other columns."""
    all_verses = verses.groupBy(*by).agg(F.max(verse).alias("_m")).select(*by, F.explode(F.sequence(F.lit(1), F.col("_m"))).alias(verse))
    return all_verses.join(verses, [*by, verse], "left")


def context_kind(context: Column) -> Column:
    """own, joint (rendered with another word: empty) or none (null): three things that must not be mixed up."""
    return F.when(context.isNull(), F.lit("none")).when(context == "", F.lit("joint")).otherwise(F.lit("own"))


def labelled(rows: DataFrame, canon: DataFrame, book: str, ch: str, v: str, here: Column) -> DataFrame:
    """A concordance's positions with label ('Name 3:4') and here: whether it is where the reader is."""
    from corpuscle.functions.references import ref_label

    names = broadcast_if_few(canon.select(F.col("id").alias("_id"), F.col("en").alias("_en")))
    joined = rows.join(names, F.col(book) == F.col("_id"), "left")
    return joined.withColumns({"label": ref_label(F.col("_en"), F.col(book), F.col(ch), F.col(v)), "here": F.coalesce(here, F.lit(False))}).drop("_id", "_en")


def most_frequent_without(counts: DataFrame, found: DataFrame, key: str, n: str = "n", most: int = 20) -> DataFrame:
    """A report: the most frequent keys that found doesn't have; ties by key."""
    return counts.join(found.select(key).distinct(), key, "left_anti").orderBy(F.desc(n), key).limit(most)


def match_statistics(rows: DataFrame, exact: Column, fuzzy: Column, lemma: str) -> DataFrame:
    """One row: n, exact, fuzzy, unmatched, and how many different lemmas are unmatched."""
    neither = ~exact & ~fuzzy
    return rows.agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"), F.count_if(fuzzy & ~exact).alias("fuzzy"), F.count_if(neither).alias("unmatched"), F.countDistinct(F.when(neither, F.col(lemma))).alias("unmatched_lemmas"))


def verse_counts(verses: DataFrame, book: str, ch: str, v: str) -> DataFrame:
    """book, ch, n: different verses of each chapter."""
    return verses.groupBy(book, ch).agg(F.countDistinct(v).alias("n"))


def reverse_map(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """value, keys: all keys that have it, distinct and in order."""
    return pairs.where(F.col(value).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"))
