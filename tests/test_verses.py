"""Verses' markup: text, annotations that point into it, and what isn't known."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.operators import verses
from corpuscle.operators.elements import Element, pieces, rewritten, text_of, tree, written

PAIR = '<span class="mam-kq"><span class="mam-kq-k">(חם)</span> <span class="mam-kq-q">[קר]</span></span>'


def noted(html):
    text, absent, notes, problems = verses.verse(html)
    return text, [(text[a:b], kind, value) for a, b, kind, value in notes], problems


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (f"טל {PAIR}&nbsp;עב", ("טל קר עב", [("קר", "pair", "חם")], [])),
        ('טל <span class="mam-kq-k">(חם)־</span>עב', ("טל עב", [("", "written", "חם")], [])),
        ('<span class="mam-kq-q">[קר]</span>', ("קר", [("קר", "read", "")], [])),
        ("<big>ט</big>ל<small> ע </small>ב", ("טל ע ב", [("ט", "big", ""), ("ע", "small", "")], [])),
        ("טל<b>׀</b>עב<small>׀</small>", ("טל ׀ עב ׀", [], [])),
        ('טל<span class="mam-spi-pe">{פ}</span> <span class="mam-spi-invnun">׆</span>', ("טל", [("", "nun", ""), ("", "pe", "")], [])),
        ('טל<sup class="footnote-marker">1</sup><i class="footnote">see <b>x</b></i>', ("טל", [("", "note", "see x")], [])),
        ('<span class="mam-kq-trivial">טל</span><span class="mam-implicit-maqaf">־</span>ע<!-- no -->', ("טל־ע", [], [])),
        ('<span class="new">טל</span>ע', ("ע", [], ["span.new"])),
        ('<span class="mam-spi-pe">{ס}</span>ע', ("ע", [], ["span.mam-spi-pe"])),
        ("<b>טל</b>ע 3", ("ע 3", [], ["b", "character 3"])),
        (PAIR.replace("[", ""), ("", [], ["span.mam-kq"])),
    ],
)
def test_verse(html, expected):
    text, notes, problems = noted(html)
    assert (text, sorted(notes), problems) == expected


def test_absent_and_null():
    assert verses.verse("<br>—&thinsp;")[:2] == ("", True) and verses.verse(" ")[1] and verses.verse(None) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["א", " ", "  ", "&nbsp;", "<big>", "</big>", "<small> ב</small>", "<br>", PAIR, '<span class="mam-spi-pe">{פ}</span>', "<b>׀</b>", "<u>", "</u>"]), max_size=14))
def test_offsets_point_into_the_text(parts):
    text, absent, notes, _ = verses.verse("".join(parts))
    assert "  " not in text and text == text.strip()
    for a, b, kind, _ in notes:
        assert 0 <= a <= b <= len(text) and text[a:b] == text[a:b].strip()
        if kind == "pair":
            assert text[a:b] == "קר"


def test_annotations_as_rows_and_the_closed_world(spark):
    df = verses.with_verses(spark.createDataFrame([(1, f"טל {PAIR}", "x"), (2, None, "x"), (3, "<u>x</u>", "x")], "id int, html string, kind string"), "html")
    assert [tuple(r) for r in verses.annotations(df, ["id"]).collect()] == [(1, 3, 5, "pair", "חם")]
    assert df.where("id = 2 and text is null").count() == 1
    assert verses.without_problems(df.where("id < 3"), ["id"]).count() == 2
    with pytest.raises(Exception, match="unknown markup at 3 u"):
        verses.without_problems(df, ["id"]).collect()


def test_trees():
    root = tree(pieces("a<b>b<i x='1'>c</b>d</i><br/>e</u>"))
    assert written(root) == '<b>b<i x="1">c</i></b>d<br>e'.replace("<b>", "a<b>", 1) and text_of(root) == "abcde"
    assert written(rewritten(root, lambda e: Element("u", [], e.children) if e.name == "i" else e.children)) == "ab<u>c</u>de"
    deep = "<b>" * 50_000 + "x" + "</b>" * 50_000
    assert written(tree(pieces(deep))) == deep
