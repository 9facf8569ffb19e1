"""An index for the lexicon search: letter n-grams to rows, intersected and verified, in place of a scan of all lemmas.

``ContainmentIndex.build`` writes two tables: the rows, by their ordinal, and postings (kind, gram, ordinal), sorted by
all three over the files. So a query's filter on kind and gram reads the row groups that hold them (file statistics tell
which), and a gram that a great part of all rows has lies in many files. A row that matches has all n-grams of what is
searched for; rows that have them all are looked up by ordinal and go through ``search.search``, which decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import greek, hebrew
from corpuscle.operators import search
from corpuscle.session import broadcast_if_few, kept, shared_folder

#: Letters of a gram; shorter searches look for grams of their own length.
GRAM = 3
#: Postings of a file.
FILE_ROWS = 5_000_000


def substrings(text: Column) -> Column:
    """All different substrings of one to GRAM letters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    of = lambda k: F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(k))), lambda g: F.length(g) == k)
    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def prefixes(text: Column) -> Column:
    return F.filter(F.array(*[F.substring(text, 1, k) for k in range(1, GRAM + 1)]), lambda g: g != "")


def word_prefixes(text: Column) -> Column:
    """Beginnings, of up to GRAM letters, of all that follows a word's boundary."""
    begins = F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9_])(?=([A-Za-z0-9_][\\s\\S]{{0,{GRAM - 1}}}))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(begins, prefixes)))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts() -> dict[str, Column]:
    """What grams are taken from. They are columns of their own: within substrings() a text would be made anew for each letter."""
    he, gr = F.col("lang") == "he", F.col("lang") == "gr"
    return {"_skeleton": F.when(he, hebrew.skeleton(F.col("lemma"))), "_folded": F.when(gr, greek.fold(F.col("lemma"))), "_gloss": F.lower("gloss"), "_word": _lower(F.col("gloss")), "_sound": F.lower("transliteration")}


def _kinds() -> dict[str, Column]:
    """For each route of the search the grams that a row is found by, of columns as _texts has them."""
    he, gr = F.col("lang") == "he", F.col("lang") == "gr"
    none = F.array().cast("array<string>")
    number = F.when(he, F.array(F.concat(F.lit("H"), F.substring_index("id", " ", 1)))).otherwise(F.array("strong"))
    return {
        "skeleton": F.when(he, substrings(F.col("_skeleton"))).otherwise(none),
        "folded": F.when(gr, substrings(F.col("_folded"))).otherwise(none),
        "word": word_prefixes(F.col("_word")),
        "gloss": substrings(F.col("_gloss")),
        "sound": prefixes(F.col("_sound")),
        "number": number,
    }


def wanted(text: str) -> list[str]:
    """The grams that a text which contains this one has."""
    if len(text) <= GRAM:
        return [text]
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


class ContainmentIndex:
    """Postings and rows (as ``search.search_rows`` makes them; ordinals are different) in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.rows = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "rows"))

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None) -> ContainmentIndex:
        spark = rows.sparkSession
        path = path or shared_folder(spark, "containment")
        rows.sortWithinPartitions("ordinal").write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        grams = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in _kinds()]), F.array(*_kinds().values()))).alias("kind", "grams")
        each = rows.withColumns(_texts()).select("ordinal", grams).select("kind", F.explode("grams").alias("gram"), "ordinal").where("gram is not null")
        by = ["kind", "gram", "ordinal"]
        each.repartitionByRange(*by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/postings")
        return cls(spark, path)

    def having(self, kind: str, grams: list[str]) -> DataFrame:
        """ordinal: of the rows that have all the grams."""
        found = self.postings.where((F.col("kind") == kind) & F.col("gram").isin(grams))
        if len(grams) == 1:
            return found.select("ordinal")
        return found.groupBy("ordinal").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("ordinal")

    def candidates(self, query: str) -> DataFrame:
        """ordinal: of rows that may match; each that matches is among them. They may repeat."""
        s = query.strip()
        number = re.fullmatch(r"([HGhg])?\s*([0-9]+)", s)
        if not s:
            return self.postings.select("ordinal").limit(0)
        if number:
            letters = (number[1] or "HG").upper()
            return self.postings.where((F.col("kind") == "number") & F.col("gram").isin([f"{x}{number[2]}" for x in letters])).select("ordinal")
        if re.search("[א-ת]", s):
            out = [self.having("skeleton", wanted(f)) for f in search.hebrew_forms(s) if len(f) >= 2]
            if not out:
                return self.postings.select("ordinal").limit(0)
        elif re.search("[Ͱ-Ͽἀ-῿]", s):
            folded = self.spark.range(1).select(greek.fold(F.lit(s))).first()[0]
            out = [self.having("folded", wanted(folded))] if folded else [self.rows.where("lang = 'gr'").select("ordinal")]
        else:
            word = s.lower()
            begins = word[0].isascii() and (word[0].isalnum() or word[0] == "_")
            by_gloss = self.having("word", [word[:GRAM]]) if begins else self.having("gloss", wanted(word))
            out = [by_gloss, self.having("sound", [word[:GRAM]])]
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        return found

    def search(self, query: str, **how) -> DataFrame:
        """As search.search over all rows."""
        found = kept(self.candidates(query).distinct(), "candidates")
        rows = self.rows.join(broadcast_if_few(found), "ordinal", "left_semi").select(*self.rows.columns)
        return search.search(rows, query, **how)
