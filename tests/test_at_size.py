"""What larger tables bring: long numbers, large groups, joins that mustn't be broadcast, batches of bounded size."""

import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from corpuscle.functions import batches, hebrew, registered
from corpuscle.operators import alignment, compressed, ranges, spelling
from corpuscle.sources import readers

SF = "/root/testdata/sf0.001"


def test_glosses_of_numbers_beyond_six_places(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").limit(3)
    numbers = F.element_at(F.array(*[F.lit(n) for n in (7, 1_234_567, 12_345_678_901)]), F.row_number().over(readers.Window.orderBy("p_partkey"))).cast("long")
    part.withColumn("p_partkey", numbers).write.parquet(str(tmp_path / "part.parquet"))
    assert {r.id for r in __spark_entry__.queries()["read_gloss_table"](spark, str(tmp_path)).collect()} == {"G7", "G1234567", "G12345678901"}


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_by_blocks_broadcast_nothing_and_have_few_levels(spark):
    rules = spark.createDataFrame([("a", 3, 1, 9, "x"), ("a", 2, 5, 5, "y"), ("a", 2, 20, 30, "z"), ("a", 1, 9, 8, "none"), ("b", 1, -4, 2**40, "w")], "s string, rule_no long, lo long, hi long, told string")
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "a", 21), (4, "b", -4), (5, "b", 2**40), (6, "b", -5), (7, "a", None), (8, None, 5)], "id long, s string, p long")
    found = ranges.first_rule_by_blocks(rows, rules, ["s"], "p")
    assert "Broadcast" not in planned(found)
    assert {(r.id, r.told) for r in found.collect()} == {(1, "y"), (2, "x"), (3, "z"), (4, "w"), (5, "w"), (6, None), (7, None), (8, None)}
    blocks = lambda df: {(r.rule_no, r.told, *b) for r in df.collect() for b in r.b}
    plainly = {tuple(r) for r in ranges.with_blocks(rules, ["rule_no", "told"]).collect()}
    assert plainly == blocks(rules.withColumn("b", ranges.dyadic_blocks(F.col("lo"), F.col("hi"))))
    assert spark.range(1).select(F.size(F.sequence(F.lit(0), ranges._top_level(F.lit(5).cast("long"), F.lit(12).cast("long"))))).first()[0] <= 4


def test_near_pairs_broadcast_no_keys(spark):
    words = spark.createDataFrame([("spell",), ("spelt",), ("spill",)], "w string")
    found = spelling.near_pairs(words, "w", 1)
    assert "Broadcast" not in planned(found) and found.count() == 2


def test_outline_makes_a_sections_columns_once(spark, tmp_path):
    (tmp_path / "o.xml").write_text('<section id="b0"><entry id="e1" type="root"><w>x</w><def>y</def></entry><entry id="e2"><w>z</w></entry></section>')
    found = readers.outline(spark, str(tmp_path / "o.xml"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    made = re.search(r'regexp_extract\([a-z]+#\d+, id="', plan)
    assert made and plan.index("Generate posexplode") < made.start()  # below: once a section, not once an entry
    assert {(r.section, r.entry, r.is_root) for r in found.collect()} == {("b0", "e1", True), ("b0", "e2", False)}


def test_long_words_are_cut_in_linear_time(spark):
    word = "ַא" + "בָּ" * 4000
    df = spark.createDataFrame([(word, [1, 4000]), (word, [1, 3]), ("־", [0]), ("אב", [0, 2]), (None, [1])], "w string, n array<int>")
    begun = time.monotonic()
    found = [r.p for r in df.select(hebrew.split_by_letters(F.col("w"), F.col("n")).alias("p")).collect()]
    assert found == [[word[:2], word[2:]], None, None, ["", "אב"], None] and time.monotonic() - begun < 10


def test_a_batchs_values_are_not_all_python_objects_at_once():
    alive, most = set(), 0

    class Made(str):
        def __del__(self):
            alive.discard(id(self))

    def f(x):
        nonlocal most
        made = Made(x)
        alive.add(id(made))
        most = max(most, len(alive))
        return made

    assert batches.by_slices(pa.array([str(i) for i in range(5000)]), f, pa.string()).to_pylist() == [str(i) for i in range(5000)]
    assert most <= batches.SLICE + 1 and batches.by_slices(pa.array([], pa.string()), f, pa.string()).to_pylist() == []


def test_blocks_are_opened_a_few_at_a_time():
    n = 3 * compressed.OPENED + 1
    rows = pa.table([pa.array(["w"] * n * 2), pa.array([i // 2 for i in range(2 * n)]), pa.array([i % 2 for i in range(2 * n)], pa.int32())], names=["token", "doc", "place"])
    blocks = pa.RecordBatch.from_arrays([c.combine_chunks() for c in pa.Table.from_batches([b for at in range(0, 2 * n, 2) for b in compressed._cut(rows.slice(at, 2))]).columns], names=["token", "n", "first_doc", "last_doc", "data"])
    assert blocks.num_rows == n
    opened = list(compressed._open(iter([blocks.select(["token", "n", "first_doc", "data"])])))
    assert max(b.num_rows for b in opened) <= 2 * compressed.OPENED and pa.Table.from_batches(opened).equals(rows)


def test_table_function_takes_a_sides_words_in_one_row(spark):
    registered.register(spark)
    rows = [(1, 0, list("abcd")), (1, 1, list("abd")), (2, 0, list("xy")), (2, 1, None), (3, 0, []), (3, 1, ["x"]), (4, 0, ["a", None, "b"]), (4, 1, ["a", "b"])]
    spark.createDataFrame(rows, "unit int, side int, word array<string>").createOrReplaceTempView("whole_sides")
    found = spark.sql("select * from aligned_words(table(whole_sides) partition by unit order by side)").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0), (1, 1, 1), (1, 2, -1), (1, 3, 2), (2, 0, -1), (2, 1, -1), (4, 0, 0), (4, 1, -1), (4, 2, 1)]
    assert "explode" not in planned(__spark_entry__.queries()["sql_functions"](spark, SF))


def test_contained_texts_are_aligned_without_a_lattice(spark, monkeypatch):
    monkeypatch.setattr(alignment, "Lattice", None)
    base = ["a", "b", "a", "c", "b", "a"] * 20_000
    thinned = [w for i, w in enumerate(base) if i % 5 != 4]
    assert [base[i] for i, j in enumerate(alignment.common_subsequence(base, thinned)) if j >= 0] == thinned
    assert alignment.common_subsequence(["x", "a", "a"], ["a", "a"]) == [-1, 0, 1] and alignment.common_subsequence(list("ab"), list("axbb")) == [0, 2]
    assert alignment.common_subsequence([], ["a"]) == [] and alignment.common_subsequence(["a"], []) == [-1]


def test_documents_are_aligned_in_one_scan(spark, tmp_path):
    rows = [(1, "one two one three"), (1, "one two one three"), (2, None), (3, ""), (None, "a b c d e f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = __spark_entry__.queries()["align_documents"](spark, str(tmp_path))
    assert planned(found).count("FileScan") == 1
    assert sorted((r.doc_id or 0, r.n, r.n_matched, r.checksum) for r in found.collect() if r.doc_id != 2) == [(0, 6, 5, 106), (1, 4, 4, 34), (1, 4, 4, 34), (3, 0, 0, 0)]


def test_short_words_at_larger_distances_are_compared_by_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = {"s" + "".join(rng.choice("abcdeθא") for _ in range(rng.randint(0, 9))) for _ in range(900)} | {"s" + "ab" * 11 + "c" * k for k in range(5)} | {"s" + "ab" * 11 + "d" + "c" * k for k in range(5)}
    monkeypatch.setattr(spelling, "BLOCK", 50)
    monkeypatch.setattr(spelling, "AT_ONCE", 200)
    df = spark.createDataFrame([(w,) for w in [*words, *words, "", None]], "w string")
    pairs = spark.createDataFrame([(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 3], "a string, b string")
    expected = {tuple(r) for r in pairs.withColumn("distance", F.levenshtein("a", "b", 3)).where("distance >= 0").collect()}
    found = [tuple(r) for r in spelling.near_pairs(df, "w", 3).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert "MapInArrow" in planned(spelling.near_pairs(df, "w", 3)) and "MapInArrow" not in planned(spelling.near_pairs(df, "w", 2))
