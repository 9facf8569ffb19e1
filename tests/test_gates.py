"""Rules of any number, gates within a write, functions in SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import hebrew, registered
from corpuscle.operators import quality, ranges


@pytest.mark.parametrize("broadcast", [True, False])
def test_first_rule_of_random_rules(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ranges, "MOST_RULES", 0)
    rng = random.Random(4)
    ends = lambda: sorted(rng.choice([-70, -64, -1, 0, 1, 31, 32, 33, 64, rng.randint(-90, 90), 1 << 40, -(1 << 50)]) for _ in range(2))
    rules = [(rng.choice("ab"), n, *ends(), f"r{n}") for n in rng.sample(range(1000), 70)] + [("a", 2000, 9, 3, "empty")]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, -64, 0, 32, rng.randint(-100, 100), 1 << 39, (1 << 40) + 1])) for i in range(300)]
    got = ranges.first_rule(spark.createDataFrame(rows, "k int, g string, p long"), spark.createDataFrame(rules, "g string, rule_no int, lo long, hi long, name string"), ["g"], "p", "k").collect()
    assert len(got) == len(rows)
    for r in got:
        fits = [x for x in rules if r.g == x[0] and r.p is not None and x[2] <= r.p <= x[3]]
        assert (r.rule_no, r.lo, r.hi, r["name"]) == (min(fits, key=lambda x: x[1])[1:] if fits else (None,) * 4)


def test_blocks_of_ranges(spark):
    rows = [(lo, hi) for lo in range(-9, 9) for hi in range(lo, 12)] + [(-(1 << 60), (1 << 61) + 5)]
    for lo, hi, blocks in spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", ranges.dyadic_blocks(F.col("lo"), F.col("hi"))).collect():
        spans = sorted((b.block << b.level, ((b.block + 1) << b.level) - 1) for b in blocks)
        assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(blocks) <= 2 * 63


def test_no_rules(spark):
    none = spark.createDataFrame([], "g string, rule_no int, lo long, hi long")
    rows = spark.createDataFrame([("a", 1)], "g string, p long")
    assert tuple(ranges.first_rule_by_blocks(rows, none, ["g"], "p").first()) == ("a", 1, None, None, None)


def test_a_broken_gate_leaves_no_output(spark, tmp_path):
    df = spark.range(100).withColumn("text", F.when(F.col("id") % 10 == 0, "").otherwise("x")).repartition(4)
    gates = {"empty": F.col("text") == "", "negative": F.col("id") < 0}
    with pytest.raises(quality.GateError, match="empty by 10 rows") as error:
        quality.write_checked(df, f"{tmp_path}/out", gates)
    assert error.value.counts == {"empty": 10} and os.listdir(tmp_path) == []
    with pytest.raises(quality.GateError, match="rows by 1 rows"):
        quality.write_checked(df, f"{tmp_path}/out", {}, least_rows=101)
    counts = quality.write_checked(df, f"{tmp_path}/out", {"negative": F.col("id") < 0}, {"empty": F.col("text") == "", "unknown": F.lit(None).cast("boolean")}, least_rows=100)
    assert counts == {"rows": 100, "negative": 0, "empty": 10, "unknown": 0} and os.listdir(tmp_path) == ["out"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    expected = {r.gate: r.n for r in quality.violations({name: (df, rule) for name, rule in gates.items()}).collect()}
    assert expected == {"empty": counts["empty"], "negative": counts["negative"]}
    with pytest.raises(FileExistsError):
        quality.write_checked(df, f"{tmp_path}/out", {})


VERSE = "שִׁ֣ירוּ לָכֶ֔ם ׀ עַל־פְּנֵי֙ מַ֥יִם רַבִּֽים׃"


def test_functions_in_sql(spark):
    registered.register(spark)
    df = spark.createDataFrame([(VERSE,), ("",), (None,)], "t string")
    df.createOrReplaceTempView("verses_in_sql")
    same = {"hebrew_tokens": hebrew.tokens, "content_words": hebrew.content_words, "hebrew_skeleton": hebrew.skeleton}
    for name, f in same.items():
        told = spark.sql(f"select {name}(t) as a from verses_in_sql").collect()
        assert [r.a for r in told] == [r.a for r in df.select(f(F.col("t")).alias("a")).collect()], name
    assert spark.sql("select align(array('a', 'b', 'c'), array('a', 'x', 'c')) as a").first().a == [0, 1, 2]


def test_table_function(spark):
    registered.register(spark)
    rows = [(u, side, i, w) for u, a, b in ((1, "abcd", "abd"), (2, "x", ""), (3, "", "x"), (None, "ab", "b")) for side, words in ((0, a), (1, b)) for i, w in enumerate(words)]
    spark.createDataFrame(rows, "unit int, side int, place int, word string").createOrReplaceTempView("sides_in_sql")
    found = spark.sql("select * from aligned_words(table(sides_in_sql) partition by unit order by (side, place))").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 0, 0), (1, 1, 1), (1, 2, -1), (1, 3, 2), (2, 0, -1), (None, 0, -1), (None, 1, 0)], key=str)
    with pytest.raises(Exception, match="needs the columns word"):
        spark.sql("select * from aligned_words(table(select 1 as side) partition by side)").collect()
