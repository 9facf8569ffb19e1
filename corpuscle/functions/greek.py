"""Greek text as column functions: folding, printed words, numerals, transliteration, citation forms."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining marks that folding drops, and the punctuation around printed words.
MARKS = "[̀-ͯ᷀-᷿]"
LEAD = "⟦(\\[«‹“‘"
TRAIL = "⟧)\\]»›”’.,;·:!?—–\\-"
SIGLA = "[⸀-⸇]"
KERAIA = "ʹ"
_ONES = ["", *"αβγδε", "ϛ", *"ζηθ"]
_TENS = ["", *"ικλμνξοπ", "ϟ"]
_HUNDREDS = ["", *"ρστυφχψω", "ϡ"]
XLIT = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", ["a", "b", "g", "d", "e", "z", "ē", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "y", "ph", "ch", "ps", "ō"], strict=True))


def _precomposed() -> tuple[str, str]:
    """Precomposed letters of the Latin and Greek blocks, and the letter that each decomposes to."""
    pre, base = [], []
    for lo, hi in ((0xC0, 0x250), (0x370, 0x400), (0x1E00, 0x1F00), (0x1F00, 0x2000)):
        for cp in range(lo, hi):
            plain = "".join(ch for ch in unicodedata.normalize("NFD", chr(cp)) if not (0x300 <= ord(ch) <= 0x36F))
            if len(plain) == 1 and plain != chr(cp):
                pre.append(chr(cp))
                base.append(plain)
    return "".join(pre), "".join(base)


PRE, BASE = _precomposed()


def plain(c: Column) -> Column:
    """Without accents, breathings and other marks; case and final sigma stay."""
    return F.regexp_replace(F.translate(c, PRE, BASE), MARKS, "")


def fold_case_sensitive(c: Column) -> Column:
    """plain(), with one sigma. For matching lemmas: a name and a common noun stay apart."""
    return F.translate(plain(c), "ς", "σ")


def fold(c: Column) -> Column:
    """fold_case_sensitive(), in lower case. The sigma is replaced first, so a capital one at a word's end stays final."""
    return F.lower(fold_case_sensitive(c))


def fold_letters(c: Column) -> Column:
    """fold(), letters alpha to omega only."""
    return F.regexp_replace(fold(c), "[^α-ω]", "")


def split_printed(c: Column) -> Column:
    """struct<lead,word,trail>: punctuation before, the word, punctuation after."""
    pattern = f"(?s)^([{LEAD}]*)(.*?)([{TRAIL}]*)$"
    return F.struct(*[F.regexp_extract(c, pattern, i + 1).alias(name) for i, name in enumerate(("lead", "word", "trail"))])


def numeral(n: Column) -> Column:
    """1 to 999 in letters, with a keraia; other numbers as digits."""
    pick = lambda some, i: F.get(F.array(*[F.lit(x) for x in some]), i.cast("int"))
    return F.when((n > 0) & (n < 1000), F.concat(pick(_HUNDREDS, F.floor(n / 100)), pick(_TENS, F.floor(n % 100 / 10)), pick(_ONES, n % 10), F.lit(KERAIA))).otherwise(n.cast("string"))


#: Other spellings under which a lemma may be cited, by trust: (pattern, replacement). The first two are movable letters.
CITATIONS = [(r"\(([^)]*)\)", "$1"), (r"\([^)]*\)", ""), ("ομαι$", "ω"), ("αμαι$", "ημι"), ("υί", "υεί"), ("άω$", "έω"), ("οῦς$", "εος"), ("οῦν$", "εον")]
#: Further ones, for dictionaries.
MORE_CITATIONS = [("εν$", "α"), ("ει$", "ω"), ("ίτης$", "είτης"), ("ῖτις$", "εῖτις")]


def candidate_forms(c: Column, alias: Column | None = None, dictionary: bool = False) -> Column:
    """array<string> of citation forms by trust, the lemma first; with a reviewed alias second. Empty ones are dropped."""
    rules = CITATIONS + (MORE_CITATIONS if dictionary else [])
    forms = [c, *([alias] if alias is not None else []), *[F.regexp_replace(c, p, r) for p, r in rules]]
    return F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != ""))


def same_word(a: Column, b: Column, folded=fold_case_sensitive) -> Column:
    """Equal when folded, or the same first letter and an edit distance of 1 (up to 5 letters) or 3."""
    x, y = folded(a), folded(b)
    limit = F.when(F.least(F.length(x), F.length(y)) <= 5, 1).otherwise(3)
    return (x == y) | ((F.substring(x, 1, 1) == F.substring(y, 1, 1)) & (F.levenshtein(x, y) <= limit))


ROUGH = "̔"


def transliterate(c: Column) -> Column:
    """Latin letters by the general style: rough breathing h, gamma before a velar n, upsilon after a vowel u.

    Native: letters become triples (letter, breathing, diaeresis) by a table made once from Unicode, then each is
    spelled by itself and its neighbours.
    """
    letters = [chr(cp) for lo, hi in ((0x370, 0x400), (0x1F00, 0x2000)) for cp in range(lo, hi)]
    known = [(ch, d) for ch in letters if (d := unicodedata.normalize("NFD", ch))[0].lower() in XLIT]
    table = F.create_map(*[x for ch, d in known for x in (F.lit(ch), F.struct(F.lit(d[0]).alias("l"), F.lit(ROUGH in d).alias("rough"), F.lit("̈" in d).alias("dots")))])
    bare = lambda ch: F.struct(ch.alias("l"), F.lit(False).alias("rough"), F.lit(False).alias("dots"))
    composed = F.regexp_replace(c, "[̀-̓̕-ͯ]", "")  # loose marks but the rough breathing
    parts = F.transform(F.filter(F.split(composed, f"(?<=.)(?!{ROUGH})"), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(table, F.substring(x, 1, 1)), bare(F.substring(x, 1, 1))))
    spelled = F.create_map(*[x for k, v in XLIT.items() for x in (F.lit(k), F.lit(v))])

    def spell(z, i):
        low = F.lower(z["l"])
        before, after = F.lower(F.get(parts, i - 1)["l"]), F.lower(F.get(parts, i + 1)["l"])
        t = F.coalesce(F.try_element_at(spelled, low), F.when(z["l"].rlike("^[A-Za-z]$"), z["l"]), F.lit(""))
        t = F.when(z["rough"], F.when(low == "ρ", F.lit("rh")).otherwise(F.concat(F.lit("h"), t))).otherwise(t)
        t = F.when((low == "γ") & after.isin(*"γκξχ"), F.lit("n")).otherwise(t)
        t = F.when((low == "υ") & before.isin(*"αεηο") & ~z["dots"], F.lit("u")).otherwise(t)
        return F.when(low != z["l"], F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 9))).otherwise(t)

    return F.array_join(F.transform(parts, spell), "")


def strip_sigla(c: Column) -> Column:
    """Without the marks of the apparatus."""
    return F.regexp_replace(c, SIGLA, "")


def first_letters(c: Column, split_letters: list[str]) -> Column:
    """A lemma's shard: its folded first letter, two where that letter is split, x where there is none."""
    letters = fold_letters(c)
    first = F.substring(letters, 1, 1)
    return F.when(letters == "", F.lit("x")).when(first.isin(*split_letters) if split_letters else F.lit(False), F.substring(letters, 1, 2)).otherwise(first)


def chained(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)
