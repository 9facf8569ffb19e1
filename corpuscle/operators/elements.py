"""Markup as trees: a scanner reads text and tags, ``tree`` nests them, ``rewritten`` and ``written`` fold over the result.

The scanner walks the text by character classes, never by a pattern over a whole tag, so a tag of any length costs its
length. What it can't read as a tag is text. Trees of any depth are built and folded without recursion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import escape

from corpuscle.functions.markup import ENTITIES

#: What a reader skips, by how it begins and ends.
SKIPPED = {"<!--": "-->", "<![CDATA[": "]]>"}
QUOTES = "\"'"
#: Elements without content.
VOID = frozenset(["br"])


@dataclass
class Tag:
    name: str
    ends: bool = False  # </name>
    empty: bool = False  # <name/>
    attributes: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, str]] = field(default_factory=list)
    children: list[Element | str] = field(default_factory=list)

    def get(self, name: str) -> str | None:
        """The first attribute of that name."""
        return next((v for k, v in self.attributes if k == name), None)


Node = Element | str


class Scanner:
    """Reads one tag at a place; ``at`` moves on as long as characters fit."""

    def __init__(self, html: str, at: int):
        self.html, self.at = html, at

    def here(self) -> str:
        return self.html[self.at : self.at + 1]

    def run(self, fits) -> str:
        start = self.at
        while (c := self.here()) and fits(c):
            self.at += 1
        return self.html[start : self.at]

    def takes(self, c: str) -> bool:
        if self.here() != c:
            return False
        self.at += 1
        return True

    def value(self) -> str | None:
        """What follows an equals sign: quoted, or bare up to what can't stand in a bare value."""
        quote = self.here()
        if quote and quote in QUOTES:
            end = self.html.find(quote, self.at + 1)
            if end < 0:
                return None
            found, self.at = self.html[self.at + 1 : end], end + 1
            return found
        return self.run(lambda c: not c.isspace() and c not in "\"'<>`") or None

    def tag(self) -> Tag | None:
        """The tag that begins here, or None; at is behind it."""
        self.takes("<")
        ends = self.takes("/")
        if not (self.here().isascii() and self.here().isalpha()):
            return None
        tag = Tag(self.run(lambda c: c.isascii() and c.isalnum()).lower(), ends)
        while True:
            blank = self.run(str.isspace)
            if self.takes(">"):
                return tag
            if ends:
                return None
            if self.takes("/"):
                self.run(str.isspace)
                tag.empty = True
                return tag if self.takes(">") else None
            name = self.run(lambda c: not c.isspace() and c not in "\"'<>=/") if blank else ""
            if not name:
                return None
            behind, value = self.at, ""
            self.run(str.isspace)
            if self.takes("="):
                self.run(str.isspace)
                if (value := self.value()) is None:
                    return None
            else:
                self.at = behind
            tag.attributes.append((name.lower(), value))


def pieces(html: str) -> Iterator[str | Tag]:
    """Text and tags in order. A sign that begins neither a tag nor what is skipped is text."""
    at = 0
    while at < len(html):
        sign = html.find("<", at)
        if sign < 0:
            sign = len(html)
        if sign > at:
            yield html[at:sign]
        at = sign
        if at == len(html):
            return
        end = next((html.find(end, at + len(begin)) + len(end) for begin, end in SKIPPED.items() if html.startswith(begin, at) and html.find(end, at + len(begin)) >= 0), None)
        if end is not None:
            at = end
            continue
        scanner = Scanner(html, at)
        tag = scanner.tag()
        yield "<" if tag is None else tag
        at = at + 1 if tag is None else scanner.at


def plain(text: str) -> str:
    """Text with its entities as characters; unknown ones stay."""
    head, *rest = text.split("&")
    return head + "".join(map(_after_ampersand, rest))


def _after_ampersand(part: str) -> str:
    name, semicolon, tail = part.partition(";")
    if semicolon and name.isascii():
        if name.isalpha() and name.lower() in ENTITIES:
            return ENTITIES[name.lower()] + tail
        if name[:1] == "#":
            digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
            if digits and all(c in "0123456789abcdefABCDEF"[: 10 if base == 10 else 22] for c in digits):
                code = int(digits, base) if len(digits) < 12 else 0
                return (chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "") + tail
    return "&" + part


def tree(found: Iterable[str | Tag], nests: Callable[[Tag], bool] | None = None) -> Element:
    """The pieces below a nameless root. An end closes all that is open within its element; without one it is passed over.

    nests: which tags stand for elements at all; of the others only the content stays.
    """
    root = Element("")
    path = [root]
    for piece in found:
        if isinstance(piece, str):
            path[-1].children.append(piece)
        elif piece.ends:
            depth = max((i for i, e in enumerate(path) if i and e.name == piece.name), default=None)
            del path[len(path) if depth is None else depth :]
        elif nests is None or nests(piece):
            path[-1].children.append(child := Element(piece.name, piece.attributes))
            if not piece.empty and piece.name not in VOID:
                path.append(child)
    return root


def events(root: Element) -> Iterator[tuple[Element, bool] | str]:
    """Text, and elements as they begin (True) and end (False), in order; not the root itself."""
    waiting: list[tuple[Element, bool] | str] = [(c, True) if isinstance(c, Element) else c for c in reversed(root.children)]
    while waiting:
        event = waiting.pop()
        yield event
        if not isinstance(event, str) and event[1]:
            waiting.append((event[0], False))
            waiting += [(c, True) if isinstance(c, Element) else c for c in reversed(event[0].children)]


def rewritten(root: Element, change: Callable[[Element], Node | list[Node]]) -> Element:
    """A tree in which each element, its content rewritten already, gives way to what change makes of it."""
    open_: list[list[Node]] = [[]]
    for event in events(root):
        if isinstance(event, str):
            open_[-1].append(event)
        elif event[1]:
            open_.append([])
        else:
            made = change(Element(event[0].name, event[0].attributes, open_.pop()))
            open_[-1] += made if isinstance(made, list) else [made]
    return Element(root.name, root.attributes, open_[0])


def written(root: Element, attributes: Callable[[Element], Iterable[tuple[str, str]]] = lambda e: e.attributes, text: Callable[[str], str] = str) -> str:
    """The content of the root as markup; values are escaped, text is what the function makes of it."""
    out = []
    for event in events(root):
        if isinstance(event, str):
            out.append(text(event))
        elif event[1]:
            out.append(f"<{event[0].name}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in attributes(event[0]))}>")
        elif event[0].name not in VOID:
            out.append(f"</{event[0].name}>")
    return "".join(out)


def text_of(root: Element) -> str:
    """All text below an element."""
    return "".join(e for e in events(root) if isinstance(e, str))
