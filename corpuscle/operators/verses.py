"""A verse's markup as its text and standoff annotations: (start, end, kind, value) rows over the text's characters.

The markup is read as a tree; a table says what each kind of element does to the text and what is noted of it. Whatever
the table doesn't know, and every character that isn't Hebrew, is a problem of the verse: new markup is never dropped
without being seen. Offsets follow the text through the collapsing of spaces, so text[start:end] is what is annotated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.functions.batches import by_slices
from corpuscle.functions.hebrew import MAQAF, PASEQ
from corpuscle.operators.elements import Element, pieces, plain, text_of, tree

# Classes of the edition's markup, its signs, and the dash of a verse that isn't there.
WRITTEN, READ, PAIR = "mam-kq-k", "mam-kq-q", "mam-kq"
MARKS = {"mam-spi-pe": ("pe", "{פ}"), "mam-spi-samekh": ("samekh", "{ס}"), "mam-spi-invnun": ("nun", "׆")}
KEPT = {"mam-kq-trivial", "mam-implicit-maqaf"}
MARKER, NOTE = "footnote-marker", "footnote"
SIZES = ("small", "big", "sup")
ABSENT = ("", "—")
SPACES = " \xa0 "

_NOTE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
VERSE = T.StructType([T.StructField("text", T.StringType()), T.StructField("absent", T.BooleanType()), T.StructField("annotations", T.ArrayType(_NOTE)), T.StructField("problems", T.ArrayType(T.StringType()))])


@dataclass
class Notes:
    """A text as it grows, with what is noted of it so far."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    notes: list[tuple[int, int, str, str]] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    def say(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def note(self, start: int, kind: str, value: str = "") -> None:
        self.notes.append((start, self.length, kind, value))

    def problem(self, element: Element) -> None:
        kind = element.get("class")
        self.problems.append(f"{element.name}.{kind}" if kind else element.name)


def _between(element: Element, begin: str, end: str, after: str = "") -> str | None:
    """The element's text between two signs, behind which one of after may stand; None if it isn't so."""
    text = text_of(element)
    inner, found, rest = text[1:].partition(end)
    return inner if text[:1] == begin and found and (rest == "" or len(rest) == 1 and rest in after) else None


def _pair(element: Element, out: Notes) -> bool:
    inner = [c for c in element.children if isinstance(c, Element)]
    if [c.get("class") for c in inner] != [WRITTEN, READ] or any(isinstance(c, str) and c.strip(SPACES) for c in element.children):
        return False
    written, read, start = _between(inner[0], "(", ")", MAQAF + SPACES), _between(inner[1], "[", "]"), out.length
    if written is None or read is None:
        return False
    out.say(plain(read))
    out.note(start, "pair", plain(written))
    return True


def _read_only(element: Element, out: Notes) -> bool:
    read, start = _between(element, "[", "]"), out.length
    if read is not None:
        out.say(plain(read))
        out.note(start, "read")
    return read is not None


def _written_only(element: Element, out: Notes) -> bool:
    written = _between(element, "(", ")", MAQAF + " ")
    if written is not None:
        out.note(out.length, "written", plain(written))
    return written is not None


def _mark(element: Element, out: Notes) -> bool:
    kind, sign = MARKS[element.get("class") or ""]
    if text_of(element) != sign:
        return False
    out.note(out.length, kind)
    return True


def _kept(element: Element, out: Notes) -> bool:
    _say_all(element, out)
    return True


def _sized(element: Element, out: Notes) -> bool:
    if text_of(element) == PASEQ and element.name == "small":
        return _paseq(element, out)
    start = out.length
    _say_all(element, out)
    out.note(start, element.name)
    return True


def _paseq(element: Element, out: Notes) -> bool:
    if text_of(element) != PASEQ:
        return False
    out.say(f" {PASEQ} ")
    return True


def _note(element: Element, out: Notes) -> bool:
    out.note(out.length, "note", plain(text_of(element)).strip())
    return True


def _space(element: Element, out: Notes) -> bool:
    out.say(" ")
    return True


#: What is done with an element, by its name and class. It says whether the element's content has the form it must have.
HANDLERS: dict[tuple[str, str | None], Callable[[Element, Notes], bool]] = {
    ("span", PAIR): _pair,
    ("span", READ): _read_only,
    ("span", WRITTEN): _written_only,
    **{("span", c): _mark for c in MARKS},
    **{("span", c): _kept for c in KEPT},
    ("sup", MARKER): lambda element, out: True,  # goes; the note follows
    ("i", NOTE): _note,
    ("b", None): _paseq,
    ("br", None): _space,
    **{(name, None): _sized for name in SIZES},
}


def _say_all(element: Element, out: Notes) -> None:
    for child in element.children:
        if isinstance(child, str):
            out.say(plain(child))
            continue
        handler = HANDLERS.get((child.name, child.get("class")))
        if handler is None or not handler(child, out):
            out.problem(child)


def _collapsed(text: str) -> tuple[str, list[int]]:
    """Runs of spaces as one, none at the ends; and where each place of the text (its end too) has gone."""
    out, places, gap = [], [], False
    for c in text:
        if c in SPACES:
            places.append(len(out) + gap)
            gap = bool(out)
            continue
        if gap:
            out.append(" ")
        gap = False
        places.append(len(out))
        out.append(c)
    places.append(len(out) + gap)
    return "".join(out), [min(p, len(out)) for p in places]


def verse(html: str | None) -> tuple | None:
    """(text, absent, annotations, problems) of a verse; None of null."""
    if html is None:
        return None
    out = Notes()
    _say_all(tree(pieces(html)), out)
    text, places = _collapsed("".join(out.parts))
    if text in ABSENT:
        return "", True, [], out.problems
    odd = sorted({c for c in text if c != " " and c != "͏" and not "֑" <= c <= "׿"})
    problems = [*out.problems, *[f"character {c}" for c in odd]]
    notes = sorted((*_trimmed(text, places[a], places[b]), kind, value) for a, b, kind, value in out.notes)
    return text, False, notes, problems


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A stretch without the spaces at its ends."""
    if start == end:
        return start, end
    inner = text[start:end]
    return start + len(inner) - len(inner.lstrip(" ")), start + len(inner.rstrip(" "))


@F.arrow_udf(VERSE)
def _verses(html: pa.Array) -> pa.Array:
    return by_slices(html, lambda h: verse(h) or (None, None, None, None), to_arrow_type(VERSE))


def with_verses(df: DataFrame, html: str) -> DataFrame:
    """df with text, absent, annotations and problems of its markup; all null where the markup is."""
    parsed = df.withColumn("_verse", _verses(F.col(html)))
    return parsed.select(*df.columns, "_verse.*")


def annotations(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, kind, value: a row for each annotation of with_verses' rows."""
    return parsed.select(*keys, F.inline("annotations"))


def without_problems(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The closed world: rows as they are; reading one that has a problem fails, and says where and which."""
    where = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.array_join("problems", ", "))
    checked = F.when(F.size("problems") > 0, F.raise_error(F.concat(F.lit("unknown markup at "), where)).cast("string")).otherwise(F.col("text"))
    return parsed.withColumn("text", checked)
