"""Lexicon search: the query's script picks one plan, which filters, ranks, and keeps the first rows.

Rows: lang (he, gr), id, lemma, transliteration, gloss, count, strong, source, and ordinal (their order, for ties).
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import greek, hebrew

LIMIT, TRIES = 80, 3
_BOUNDARY = "(?<![A-Za-z0-9_])"


def search_rows(he: DataFrame, gr: DataFrame) -> DataFrame:
    """One table of the two indices: he (id, lemma, transliteration, gloss, count, source), gr (lemma, strong, transliteration, gloss, count, source), with ordinal."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    shared = [text("transliteration"), text("gloss"), "count"]
    hebrew_rows = he.select(F.lit("he").alias("lang"), "id", F.when(F.coalesce("lemma", F.lit("")) == "", F.col("id")).otherwise(F.col("lemma")).alias("lemma"), *shared, F.concat(F.lit("H"), F.substring_index("id", " ", 1)).alias("strong"), text("source"), "ordinal")
    greek_rows = gr.select(F.lit("gr").alias("lang"), F.col("lemma").alias("id"), "lemma", *shared, text("strong"), text("source"), (F.col("ordinal") + F.lit(1 << 40)).alias("ordinal"))
    return hebrew_rows.unionByName(greek_rows)


def word_link(lang: Column, word: Column) -> Column:
    return F.concat(F.lit("/word/"), lang, F.lit("/"), F.replace(F.url_encode(word), F.lit("+"), F.lit("%20")))


def word_link_text(lang: str, word: str) -> str:
    return f"/word/{lang}/{quote(word, safe="!'()*~-._")}"


def search(rows: DataFrame, query: str, scope: str = "all", limit: int = LIMIT, opening_ranks: bool = False) -> DataFrame:
    """Rows that match, in order. A number: of either language or one (H, G). Hebrew letters: lemmas that contain the
    skeleton, with up to two proclitics taken off while nothing is found. Greek letters: lemmas that contain the folded
    text. Else: a gloss with a word that begins so, or a transliteration that does.

    opening_ranks: whether a gloss that opens with the word comes before the others; by default only equal ones do.
    """
    s = query.strip()
    if not s:
        return rows.limit(0)
    number = re.fullmatch(r"([HGhg])?\s*([0-9]+)", s)
    if number:
        found, order = _by_number(rows, (number[1] or "").upper(), number[2])
    elif re.search("[א-ת]", s):
        found, order = _by_hebrew(rows, s)
    elif re.search("[Ͱ-Ͽἀ-῿]", s):
        folded = greek.fold(F.lit(s))
        found, order = rows.where((F.col("lang") == "gr") & greek.fold(F.col("lemma")).contains(folded)), [F.desc(greek.fold(F.col("lemma")) == folded)]
    else:
        found, order = _by_gloss(rows, s.lower(), opening_ranks)
    if scope != "all":
        found = found.where(F.col("lang") == scope)
    best = found.orderBy(*order, F.desc("count"), "ordinal").limit(limit)
    if "_try" in best.columns:  # the first form that finds anything: its rows come first, so they are among the best
        first = F.min("_try").over(Window.partitionBy(F.lit(0)))  # over at most limit rows
        best = best.withColumn("_first", first).where("_try = _first").orderBy(*order, F.desc("count"), "ordinal")
    return best.select(*rows.columns)


def _by_number(rows: DataFrame, letter: str, digits: str):
    he = (F.col("lang") == "he") & (F.substring_index("id", " ", 1) == digits) & F.lit(letter != "G")
    gr = (F.col("lang") == "gr") & (F.col("strong") == f"G{digits}") & F.lit(letter != "H")
    return rows.where(he | gr), [F.desc(F.col("lang") == "he")]


def hebrew_forms(query: str) -> list[str]:
    """What is looked for, in this order: the skeleton, then without up to two proclitics."""
    bare = re.sub(f"{hebrew.POINTS}|[{hebrew.SOF_PASUQ}{hebrew.PASEQ}{hebrew.MAQAF} ]", "", query)
    forms = [bare]
    while len(forms) < TRIES and forms[-1] and forms[-1][0] in hebrew.PROCLITICS and len(forms[-1]) > 2:
        forms.append(forms[-1][1:])
    return forms


def _by_hebrew(rows: DataFrame, query: str):
    """All tries at once: each row gets the first form that it contains, and rows are in order of these."""
    forms = hebrew_forms(query)
    lemma = hebrew.skeleton(F.col("lemma"))
    tries = F.coalesce(*[F.when(lemma.contains(f), F.lit(i)) for i, f in enumerate(forms) if len(f) >= 2], F.lit(None).cast("int"))
    hits = rows.where(F.col("lang") == "he").withColumn("_try", tries).where("_try is not null")
    wanted = F.get(F.array(*[F.lit(f) for f in forms]), F.col("_try"))
    return hits, [F.asc("_try"), F.desc(hebrew.skeleton(F.col("lemma")) == wanted)]


def _by_gloss(rows: DataFrame, word: str, opening_ranks: bool):
    begins = F.col("gloss").rlike(f"(?i){_BOUNDARY}\\Q{word}\\E") if word[0].isascii() and (word[0].isalnum() or word[0] == "_") else F.lower("gloss").contains(word)
    found = rows.where(begins | F.lower("transliteration").startswith(word))
    equal = (F.lower("gloss") == word) | (F.lower("transliteration") == word)
    score = F.when(equal, 2)
    if opening_ranks:
        score = score.when(F.col("gloss").rlike(f"(?i)^\\Q{word}\\E(?![A-Za-z0-9_])"), 1)
    return found, [F.desc(score.otherwise(0))]
