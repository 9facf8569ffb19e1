"""Hebrew text as column functions: marks, words, views, numerals, lemma ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes of the Masoretic text.
POINTS = "[֑-ֽֿ-ׂׄ-ׇ͏]"
CANTILLATION = "[֑-ֽ֯׀]"
MAQAF, PASEQ, SOF_PASUQ = "־", "׀", "׃"
LETTERS = "א-ת"
LETTER = f"[{LETTERS}]"
#: Letters that a printed form may carry before its lemma.
PROCLITICS = "ובכלמהש"
MATRES = "וי"
#: Presentation forms and the letters that composition makes of them, for consonants() without a normaliser.
_ONES = ["", *"אבגדהוזחט"]
_TENS = ["", *"יכלמנסעפצ"]
_HUNDREDS = ["", *"קרשת"]


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def strip_points(c: Column) -> Column:
    return F.regexp_replace(c, POINTS, "")


def tokens(c: Column) -> Column:
    """Parts between spaces; a paseq that stands alone is one."""
    return F.filter(F.split(c, " +"), lambda w: w != "")


def content_words(c: Column) -> Column:
    """Words between spaces and maqafs, without paseq and sof pasuq; empty ones are dropped."""
    parts = F.split(F.translate(c, PASEQ, ""), f"[ {MAQAF}]")
    return F.filter(F.transform(parts, lambda w: F.translate(w, SOF_PASUQ, "")), lambda w: w != "")


def to_niqqud(c: Column) -> Column:
    """Vowels only: accents, meteg and paseq go."""
    return _collapse(F.regexp_replace(c, CANTILLATION, ""))


def to_consonants(c: Column) -> Column:
    """Letters only; a maqaf is a space, sof pasuq stays."""
    return _collapse(F.translate(strip_points(c), MAQAF, " "))


def render(c: Column, mode: str) -> Column:
    return {"full": lambda x: x, "niqqud": to_niqqud, "consonants": to_consonants}[mode](c)


def skeleton(c: Column) -> Column:
    """The bare letters of one word."""
    return F.translate(strip_points(c), SOF_PASUQ + PASEQ + MAQAF + " ", "")


def alignment_key(c: Column) -> Column:
    """What words are aligned by: the skeleton, without morpheme slashes."""
    return F.translate(skeleton(c), "/", "")


def is_letter(c: Column) -> Column:
    return c.rlike(f"^{LETTER}$")


def consonants(c: Column) -> Column:
    """Only the letters alef to tav."""
    return F.regexp_replace(c, "[^א-ת]", "")


def bare(c: Column) -> Column:
    """Consonants without vowel letters."""
    return F.translate(consonants(c), MATRES, "")


def strip_homograph(c: Column) -> Column:
    """A headword without the superscript digits at its end."""
    return F.trim(F.regexp_replace(c, "[⁰¹²³⁴-⁹]+$", ""))


def lemma_id(c: Column) -> Column:
    """The number, with its letter, after the last slash; a plus at its end goes. Null unless it is one."""
    stem = F.regexp_replace(F.element_at(F.split(c, "/"), -1), "\\+$", "")
    return F.when(stem.rlike("^[0-9]+( [a-z])?$"), stem)


def split_by_letters(word: Column, counts: Column) -> Column:
    """Pieces of a word with so many letters each, marks with the letter before them; null if the counts don't add up.

    One pattern cuts the word at its letters, and a piece is a slice of what it finds: linear in the word's length.
    """
    # a letter with the marks behind it; marks before the first letter belong to it too
    units = F.regexp_extract_all(word, F.lit(f"(?s)(?:^[^{LETTERS}]+)?[{LETTERS}][^{LETTERS}]*"), F.lit(0))
    ends = F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    cut = F.transform(F.arrays_zip(counts.alias("n"), F.slice(ends, 1, F.size(counts)).alias("at")), lambda z: F.array_join(F.slice(units, F.greatest(z["at"], F.lit(0)) + 1, F.greatest(z["n"], F.lit(0))), ""))
    return F.when((F.size(units) == F.element_at(ends, -1)) & (F.size(units) > 0), cut)


def numeral(n: Column) -> Column:
    """1 to 999 in letters: 400s repeated, 15 and 16 by nine; other numbers as digits."""
    pick = lambda some, i: F.get(F.array(*[F.lit(x) for x in some]), i.cast("int"))
    h, rest = F.floor(n / 100), n % 100
    fours = F.floor((h - 1) / 4)
    hundreds = F.concat(F.repeat(F.lit(_HUNDREDS[4]), F.greatest(fours, F.lit(0)).cast("int")), pick(_HUNDREDS, h - 4 * F.greatest(fours, F.lit(0))))
    small = F.when(rest == 15, _ONES[9] + _ONES[6]).when(rest == 16, _ONES[9] + _ONES[7]).otherwise(F.concat(pick(_TENS, F.floor(rest / 10)), pick(_ONES, rest % 10)))
    return F.when((n > 0) & (n < 1000), F.concat(hundreds, small)).otherwise(n.cast("string"))
