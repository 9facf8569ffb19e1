"""Hot keys and long texts: what one key or one document holds must neither meet in one place nor cost its square."""

import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import common as C
from corpuscle.llm import edit_fingerprint, line_dedup, pattern_packing


def lines_by_hand(rows, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def dropped(df, min_docs):
    out = line_dedup.drop_common_lines(df, min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_a_million_lines_that_go_take_seconds(spark):
    shared = "\n".join(f"line {i}" for i in range(1_000_000))
    rows = [(1, "first\n" + shared + "\nlast"), (2, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    began = time.time()
    found = dropped(df, 2)
    assert time.time() - began < 90
    assert found == lines_by_hand(rows, 2)


@pytest.mark.parametrize("most", [1, 3])
def test_lines_repeated_within_documents_are_counted_beyond_the_bound(spark, monkeypatch, most):
    """More common keys than may be broadcast: one stands ten thousand times in a few documents."""
    monkeypatch.setattr(C, "MOST_HEAVY", most)
    rows = [(i, "\n".join(["hot"] * 3000 + [f"k{j}" for j in range(8)] + [f"own {i}", ""])) for i in range(4)] + [(9, None), (None, "hot\nk1\nelse")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dropped(df, 3) == lines_by_hand(rows, 3)


def test_line_dedup_takes_text_ids(spark):
    rows = [(f"d{i}", f"shared\nown {i}") for i in range(4)] + [(None, "shared")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert dropped(df, 3) == lines_by_hand(rows, 3)
    kept = line_dedup.drop_common_lines(df, min_docs=3, keep_first=True).where("text like '%shared%'").collect()
    assert [r.doc_id for r in kept] == ["d0"]


def test_pieces_of_one_id_and_text_are_spread_over_salts(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).repartition(3)
    pieces = pattern_packing.token_pieces(df, 64, salts=16)
    assert max(r["count"] for r in pieces.groupBy("length", "_salt").count().collect()) <= 2000 / 16 + 3
    packed = pattern_packing.pack(df, 64)
    places = {(r.sequence_id, r.offset) for r in packed.collect()}
    assert len(places) == 2000 and len({s for s, _ in places}) == -(-2000 // 64)


@pytest.mark.parametrize("most", [1, 2, 100])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted(spark, monkeypatch, tmp_path, most, how):
    monkeypatch.setattr(C, "MOST_HEAVY", most)
    rows = spark.createDataFrame([(k, i) for i in range(50) for k in ("hot", f"k{i % 7}", f"only {i}")], "k string, i int")
    keys = [("hot", 50, "h"), *[(f"k{j}", 8, f"v{j}") for j in range(7)], ("nowhere", 1, "n")]
    found = C.join_counted(rows, C.written(spark.createDataFrame(keys, "k string, n long, v string"), "keys"), "k", "n", how=how)
    value = {k: v for k, _, v in keys}
    expected = [(r.k, r.i, value.get(r.k)) for r in rows.collect() if how == "left" or r.k in value]
    assert sorted(map(tuple, found.select("k", "i", "v").collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("most", [1, 250_000])
def test_near_class_of_copies_that_a_third_of_all_rows_are(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MOST_HEAVY", most)
    words = " ".join(f"w{i}" for i in range(90))
    rows = [(i, ["", words, f"{i} " * 40][i % 3], "x") for i in range(60)] + [(100, words + " z", "x"), (None, words, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_class string")
    found = edit_fingerprint.with_near_class(edit_fingerprint.edited_fingerprints(df)).collect()
    near = {(r.doc_id, r.n_chars): r.near_class for r in found}
    assert len(found) == len(rows) and {v for (i, n), v in near.items() if i is not None and i < 60 and i % 3 == 0} == {0}
    assert {v for (i, n), v in near.items() if i is None or i == 100 or i % 3 == 1} == {1}
