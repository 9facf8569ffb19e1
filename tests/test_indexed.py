"""Long alignments, the containment index, near spellings and compressed postings, against plain forms of them."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.operators import alignment, compressed, containment, search, spelling
from test_operators import lexicon


def by_table(a, b):
    """Partners by the whole table of suffix lengths."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [-1] * n, 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out[i] = j
        i, j = (i + 1, j + 1) if a[i] == b[j] else (i + 1, j) if t[i + 1][j] >= t[i][j + 1] else (i, j + 1)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.sampled_from("abcde"), max_size=60), st.sampled_from([(2, 1), (3, 4), (16, 64)]))
def test_alignment_is_the_table(a, b, cuts):
    before = alignment.CUTS, alignment.STRETCH
    alignment.CUTS, alignment.STRETCH = cuts
    try:
        assert alignment.common_subsequence(a, b) == by_table(a, b)
    finally:
        alignment.CUTS, alignment.STRETCH = before


def test_alignment_of_long_texts_takes_linear_memory():
    import tracemalloc

    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    a = [rng.choice(words) for _ in range(12_000)]
    b = [w for w in a if rng.random() < 0.9]
    tracemalloc.start()
    found = alignment.common_subsequence(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [a[i] for i, j in enumerate(found) if j >= 0] == b
    assert peak < 8e6  # the table would have 130 million places


QUERIES = ["נהר", "הנהר", "צפור", "ו", "חו", "ποταμός", "πυρ", "ΠΥΡ", "υ", "οταμ", "ἐν", "H205", "g400", "52", "310", "999", "river", "r", "ri", "riverbank", "fl", "FLAME", "I", "(", "a ri", ", s", "é", "nahar", "tsi", "\t", "on f"]


@pytest.mark.parametrize("scope", ["all", "he"])
def test_the_index_finds_what_the_scan_finds(spark, scope):
    rows = lexicon(spark).unionByName(lexicon(spark).select("lang", "id", F.lit("").alias("lemma"), "transliteration", F.lit("éclat (of) Fire_1").alias("gloss"), "count", "strong", "source", (F.col("ordinal") + 500).alias("ordinal")))
    rows = rows.cache()
    index = containment.ContainmentIndex.build(rows)
    for q in QUERIES:
        expected = [tuple(r) for r in search.search(rows, q, scope).collect()]
        assert [tuple(r) for r in index.search(q, scope=scope).collect()] == expected, q
        if expected:
            few = index.candidates(q).distinct().count()
            assert few < rows.count(), q


def test_the_index_reads_only_the_postings_asked_for(spark):
    index = containment.ContainmentIndex.build(lexicon(spark))
    plan = index.candidates("ποταμός")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(kind,folded)" in plan and "In(gram, [" in plan
    assert index.having("folded", containment.wanted("ποταμοσ")).count() == 1


def near_by_hand(words, distance):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = sorted({w for w in words if w})
    return {(a, b, lev(a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if a[0] == b[0] and abs(len(a) - len(b)) <= distance and lev(a, b) <= distance}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_near_pairs_are_all_pairs(spark, distance):
    rng = random.Random(distance)
    letters = "abc"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8]))) for _ in range(60)]
    long = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(9, 26))) for _ in range(40)]
    for w in long[:]:
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randint(1, distance)):
                at = rng.randrange(1, len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice([[], ["z"], ["y", "y"]])
            long.append("".join(x))
    words += [*long, "", None, "αβγδε", "αβγε", words[0]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {tuple(r) for r in spelling.near_pairs(df, "w", distance).collect()} == near_by_hand([w for w in words if w], distance)


def test_near_pairs_look_at_few_candidates(spark):
    rng = random.Random(1)
    words = {"s" + "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(7, 20))) for _ in range(3000)}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = spelling.candidates(df, "w", 3).first()
    assert found.keys <= len(words) * spelling.keys_of(3)
    assert found.pairs < len(words) ** 2 / 20  # all have one initial
    one = spark.createDataFrame([("x" * 5000,)], "w string")
    assert spelling.candidates(one, "w", 3).first().keys <= spelling.keys_of(3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=50))
def test_numbers_in_bytes_round_trip(values):
    data, offsets = compressed.to_bytes(np.array(values, np.int64))
    assert compressed.from_bytes(data).tolist() == values and len(offsets) == len(values) + 1


def occurrences(spark, n=4000):
    rng = random.Random(5)
    rows = [(rng.choices(["the", "of", "rare", "αβγ", ""], [60, 30, 1, 8, 1])[0], rng.choice([-5, 3, 7, 8, 10**12, rng.randrange(400)]), rng.randrange(50)) for _ in range(n)]
    return rows + rows[:9], spark.createDataFrame([*rows, *rows[:9], (None, 1, 1), ("the", None, 1), ("of", 1, None)], "w string, d long, i int")


def test_postings_round_trip(spark):
    rows, df = occurrences(spark)
    blocks = compressed.compress(df.repartition(5), "w", "d", "i")
    assert sorted(tuple(r) for r in compressed.decompress(blocks).collect()) == sorted(rows)
    told = blocks.select("token", "n", "first_doc", "last_doc", F.length("data").alias("size")).collect()
    assert max(r.n for r in told) <= compressed.BLOCK and all(r.first_doc <= r.last_doc for r in told)
    assert sum(r["size"] for r in told) < 4 * len(rows)
    assert compressed.compress(df.limit(0), "w", "d", "i").count() == 0


@pytest.mark.parametrize(("one", "other"), [("the", "rare"), ("rare", "the"), ("the", "of"), ("of", "nowhere"), ("the", "the")])
def test_two_words(spark, one, other):
    rows, df = occurrences(spark)
    blocks = compressed.compress(df, "w", "d", "i")
    at = lambda w: [(d, i) for x, d, i in rows if x == w]
    docs = {d for d, _ in at(one)} & {d for d, _ in at(other)}
    expected = {(d, sum(x == d for x, _ in at(one)), sum(x == d for x, _ in at(other))) for d in docs}
    assert {tuple(r) for r in compressed.documents_with(blocks, one, other).collect()} == expected
    pairs = [(d, i) for d, i in at(one) for e, j in at(other) if d == e and j == i + 1]
    assert sorted(tuple(r) for r in compressed.phrase(blocks, one, other).collect()) == sorted(pairs)


def test_skip_entries_spare_blocks(spark):
    df = spark.range(40_000).select(F.lit("the").alias("w"), F.col("id").alias("d"), F.lit(0).alias("i"))
    blocks = compressed.compress(df, "w", "d", "i")
    asked = spark.createDataFrame([(17,), (20_000,), (90_000,)], "doc long")
    assert blocks.count() >= 40_000 // compressed.BLOCK and compressed.overlapping(blocks, asked).count() == 2
