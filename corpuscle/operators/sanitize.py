"""Markup sanitising as a scalar Arrow function: a fold over the tree of what is allowed.

What goes with its content is left out of the pieces, what isn't allowed out of the tree; what remains is written with
its allowed attributes, so the result is balanced however the source was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.batches import by_slices
from corpuscle.functions.markup import ALLOWED_CLASSES, ALLOWED_TAGS, DROPPED_WITH_CONTENT, fits_value
from corpuscle.operators.elements import Element, Tag, pieces, plain, tree, written


def shown(found: Iterable[str | Tag]) -> Iterator[str | Tag]:
    """The pieces outside of elements that go with their content. Such an element ends where as many of its name end as
    have begun."""
    hidden, depth = "", 0
    for piece in found:
        tag = piece if isinstance(piece, Tag) and not piece.empty else None
        if depth:
            depth += 0 if tag is None or tag.name != hidden else -1 if tag.ends else 1
        elif isinstance(piece, Tag) and not piece.ends and piece.name in DROPPED_WITH_CONTENT:
            hidden, depth = piece.name, int(tag is not None)
        else:
            yield piece


def allowed_value(name: str, value: str) -> str:
    """What stays of an attribute's value; empty where it isn't allowed."""
    if name == "class":
        return " ".join(c for c in value.split() if c in ALLOWED_CLASSES)
    return value if fits_value(name, value) else ""


def _attributes(element: Element) -> Iterator[tuple[str, str]]:
    for name, value in element.attributes:
        if name in ALLOWED_TAGS[element.name] and (kept := allowed_value(name, plain(value))):
            yield name, kept


def sanitize_text(html: str | None) -> str | None:
    """Null stays null. Idempotent; what it returns has allowed tags only, each of them closed."""
    if html is None:
        return None
    allowed = tree(shown(pieces(html)), lambda tag: tag.name in ALLOWED_TAGS)
    return written(allowed, _attributes, lambda text: escape(plain(text), quote=False))


@F.arrow_udf(T.StringType())
def sanitize(html: pa.Array) -> pa.Array:
    """Only allowed tags, attributes and values; scripts and the like go with their content; nesting is put right."""
    return by_slices(html, sanitize_text, pa.string())
