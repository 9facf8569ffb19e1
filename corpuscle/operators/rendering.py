"""Source markup of dictionaries rendered as entries: a table says what each element becomes; the result is sanitised."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.operators.elements import Element, Node, pieces, rewritten, tree, written
from corpuscle.operators.sanitize import sanitize_text
from corpuscle.session import broadcast_if_few

#: What an element becomes: (tag, class, {attribute: attribute it comes from}). None: it goes with its content; "": only
#: its tags go. A tuple with a condition first asks for an attribute that matches. Tables are tried in order.
OUTLINE = {
    "status": None, "page": None, "w": [("src", ".+", ("a", "he-inline", {"data-bdb": "src"})), ("span", "he-inline", {})], "def": ("b", "", {}), "pos": ("i", "pos", {}), "stem": ("span", "stem", {}),
    "asp": ("i", "", {}), "ref": [("r", ".+", ("a", "", {"data-ref": "r"})), ""], "sense": ("div", "sense", {}), "foreign": ("i", "", {}), "em": ("em", "", {}),
}
TEI = {
    "pb": None, "note": [("type", "occurrencesNT", None), ("span", "note", {})], "orth": ("b", "gr", {}),
    "foreign": [("n", "H[0-9]+", ("a", "he-inline", {"data-he": "n"})), ("xml:lang", "heb", ("span", "he-inline", {})), ("xml:lang", "grc", ("span", "gr", {})), ("i", "", {})],
    "gloss": ("b", "", {}), "ref": [("osisRef", ".+", ("a", "", {"data-ref": "osisRef"})), ""], "sense": ("div", "sense", {}), "seg": [("type", "septuagint", ("span", "lxx", {})), ""],
    "form": ("div", "form", {}), "etym": ("div", "etym", {}), "lb": ("br", "", {}), "table": ("table", "", {}), "row": ("tr", "", {}), "cell": ("td", "", {}), "div": ("div", "", {}), "p": ("p", "", {}),
    **dict.fromkeys(("emph", "hi", "tns", "gram", "gramGrp", "pos", "mood", "per", "number", "usg", "re", "head"), ("i", "", {})),
}
_TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][\w:.-]*)((?:\s+[\w:.-]+\s*=\s*\"[^\"]*\")*)\s*(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*\"([^\"]*)\"")


def _target(table: dict, name: str, attributes: dict[str, str]):
    rule = table.get(name, "")
    for one in rule if isinstance(rule, list) else [rule]:
        if not (isinstance(one, tuple) and len(one) == 3 and isinstance(one[1], str) and not isinstance(one[2], dict)):
            return one
        if re.fullmatch(one[1], attributes.get(one[0], "")):
            return one[2]
    return ""


def render_text(xml: str | None, table: dict) -> str | None:
    """One entry: elements renamed by the table, a sense's number put before it, spaces collapsed, sanitised."""
    if xml is None:
        return None
    out, stack, skipping, last = [], [], 0, 0
    for m in _TAG.finditer(xml):
        if not skipping:
            out.append(xml[last : m.start()])
        last = m.end()
        closing, name, raw, alone = m.groups()
        if name is None:
            continue
        if closing:
            while stack:  # what wasn't closed inside is closed here
                opened, end, skipped = stack.pop()
                skipping -= skipped
                if not skipping and end:
                    out.append(end)
                if opened == name:
                    break
            continue
        attributes = dict(_ATTRIBUTE.findall(raw))
        target = _target(table, name, attributes)
        if target is None:
            if not alone:
                stack.append((name, "", 1))
                skipping += 1
            continue
        end = ""
        if target and not skipping:
            tag, kind, taken = target
            wanted = "".join(f' {k}="{attributes.get(v, "").removeprefix("H") if k == "data-he" else attributes.get(v, "")}"' for k, v in taken.items())
            out.append(f"<{tag}{f' class={chr(34)}{kind}{chr(34)}' if kind else ''}{wanted}>")
            if name == "sense" and "n" in attributes:
                out.append(f'<span class="n">{attributes["n"]}</span> ')
            end = "" if tag == "br" else f"</{tag}>"
        if alone:
            out.append(end)
        else:
            stack.append((name, end, 0))
    if not skipping:
        out.append(xml[last:])
    return sanitize_text(re.sub("> <", "><", re.sub(r"\s+", " ", "".join(out))).strip())


@F.pandas_udf(T.StringType())
def render_outline(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: render_text(x, OUTLINE))


@F.pandas_udf(T.StringType())
def render_tei(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: render_text(x, TEI))


def passage_id(place: str | None, books: dict[str, str]) -> str | None:
    """The id of a place such as "I Kings 3:4-5": the book's id, chapter and verse by points; None if it isn't one."""
    book, _, numbers = (place or "").rpartition(" ")
    first, *until = numbers.split("-")
    parts = first.split(":")
    if book not in books or len(until) > 1 or len(parts) > 2 or not all(x.isascii() and x.isdecimal() for x in (*parts, *until)):
        return None
    return ".".join((books[book], *parts))


#: What an element of a sense becomes, but for links: (name, attribute and value that it must have) to (name, class).
INLINE = {("strong", None): ("b", None), ("span", ("dir", "rtl")): ("span", "he-inline")}


def _inline(element: Element, books: dict[str, str]) -> Element:
    """An element of a definition, its content done: links lead to passages or are plain, and right-to-left text is Hebrew."""
    if element.name == "a":
        target = passage_id(element.get("data-ref"), books)
        return Element("a", [("data-ref", target)], element.children) if target else Element("span", [], element.children)
    if element.name == "big" and len(element.children) == 1 and isinstance(only := element.children[0], Element):
        if only.name == "big" and len(only.children) == 1 and isinstance(word := only.children[0], Element) and word.get("class") == "he-inline":
            return Element("b", [("class", "he-inline")], word.children)  # twice as large: the entry's own word
    for (name, asked), (to, kind) in INLINE.items():
        if element.name == name and (asked is None or asked in element.attributes):
            return Element(to, [("class", kind)] if kind else [], element.children)
    return element


def relinked(html: str, books: dict[str, str]) -> list[Node]:
    """A definition's nodes with links and words as entries have them."""
    return rewritten(tree(pieces(html)), lambda e: _inline(e, books)).children


def relink(html: str, books: dict[str, str]) -> str:
    """Links to passages by the books' ids; other links become plain spans; right-to-left spans are Hebrew."""
    return written(Element("", [], relinked(html, books)))


def _sense(sense: dict, books: dict[str, str]) -> Element:
    number = [Element("span", [("class", "n")], [str(sense["number"])]), " "] if sense.get("number") else []
    inner = [_sense(s, books) for s in sense.get("senses") or []]
    return Element("div", [("class", "sense")], [*number, *relinked(sense.get("definition") or "", books), *inner])


def render_senses(content: str | None, books: dict[str, str]) -> str | None:
    """Nested senses (JSON: senses of number, definition, senses) as nested blocks."""
    if content is None:
        return None
    blocks = [_sense(s, books) for s in json.loads(content).get("senses") or []]
    return sanitize_text(re.sub(r"\s+", " ", written(Element("", [], blocks))))


def with_rendered_senses(df: DataFrame, content: str, books: dict[str, str], out: str = "html") -> DataFrame:
    """df with the senses rendered; books: names to ids (the size of a canon)."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: render_senses(v, books))

    return df.withColumn(out, run(content))


def links(html: Column) -> Column:
    """array<struct<kind,target>> of an entry's links, in order: ref, he or bdb."""
    found = F.regexp_extract_all(html, F.lit(r'data-(ref|he|bdb)="[^"]*"'), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "data-(ref|he|bdb)", 1).alias("kind"), F.regexp_extract(x, '="([^"]*)"', 1).alias("target")))


def routed(df: DataFrame, html: str, key: str, canon: DataFrame, xref: DataFrame) -> DataFrame:
    """key, kind, target, route: where each link leads: read (a passage of the canon), word (one lemma), choice (several), none.

    canon: id; xref: bdb, options (array).
    """
    each = df.select(key, F.explode(links(F.col(html))).alias("l")).select(key, "l.*")
    book = F.regexp_extract(F.substring_index("target", "-", 1), r"^(\w+)\.[0-9]+", 1)
    known = each.join(broadcast_if_few(canon.select(F.col("id").alias("_book"))), (F.col("kind") == "ref") & (book == F.col("_book")), "left").join(xref.select(F.col("bdb").alias("_bdb"), F.size("options").alias("_n")), (F.col("kind") == "bdb") & (F.col("target") == F.col("_bdb")), "left")
    route = F.when(F.col("_book").isNotNull(), "read").when(F.col("kind") == "he", "word").when(F.col("_n") == 1, "word").when(F.col("_n") > 1, "choice").otherwise("none")
    return known.select(key, "kind", "target", route.alias("route"))
