import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.functions import greek, markup
from corpuscle.operators import alignment, matching, postings, quality, ranges, sanitize, search, vocabulary
from corpuscle.operators.vocabulary import Settings, fold_event


def brute_lcs(a, b):
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            d[i][j] = d[i + 1][j + 1] + 1 if a[i] == b[j] else max(d[i + 1][j], d[i][j + 1])
    out, i, j = [-1] * n, 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out[i], i, j = j, i + 1, j + 1
        elif d[i + 1][j] >= d[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_subsequence_is_the_brute_force_one():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert alignment.common_subsequence(a, b) == brute_lcs(a, b)


def test_single_gaps():
    """A gap of one word on both sides is filled if the words are alike; longer ones and other words aren't."""
    base, other = ["נחל", "גדולים", "אבן", "עמק"], ["נחל", "גדלים", "אבן", "עמק"]
    found = [0, -1, 2, 3]
    assert alignment.fill_single_gaps(found, base, other) == 1 and found == [0, 1, 2, 3]
    assert alignment.fill_single_gaps([0, -1, 2], ["נחל", "גדול", "אבן"], ["נחל", "צפור", "אבן"]) == 0
    assert alignment.fill_single_gaps([0, -1, 3], ["נחל", "גל", "אבן"], ["נחל", "גל", "עוד", "אבן"]) == 0


def test_align_frame(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["a", "x", "c"], ["a", "c"]), (3, [], []), (4, None, ["a"])], "id int, b array<string>, o array<string>")
    assert {r.id: r.alignment for r in alignment.align_frame(df, "b", "o").collect()} == {1: [0, 1], 2: [0, -1, 1], 3: [], 4: None}
    assert {r.id: r.a for r in df.select("id", alignment.align(F.col("b"), F.col("o")).alias("a")).collect()} == {1: [0, 1], 2: [0, -1, 1], 3: [], 4: None}


def test_granularity(spark):
    schema = "book string, ch int, v int, words array<string>"
    base = spark.createDataFrame([("G", 1, 1, ["a"]), ("G", 1, 2, ["b"]), ("G", 2, 1, ["c"]), ("G", 2, 2, ["d", "e"])], schema)
    other = spark.createDataFrame([("G", 1, 1, ["a"]), ("G", 1, 2, ["b"]), ("G", 2, 1, ["c", "d", "e"])], schema)
    rows = {(r.ch, r.v): (r.base, r.other, [tuple(x) for x in r.sizes]) for r in alignment.by_verse_or_chapter(base, other).collect()}
    assert rows == {(1, 1): (["a"], ["a"], [(1, 1)]), (1, 2): (["b"], ["b"], [(2, 1)]), (2, None): (["c", "d", "e"], ["c", "d", "e"], [(1, 1), (2, 2)])}


SANITIZED = [
    ('<p><sup>2</sup> <i>hot</i> or <sub>x</sub> <a data-he="44">חם</a></p><div class="note">see <span class="gr">πῦρ</span></div>', None),
    ('<em>in</em><noscript>out<b>out</b></noscript><select><option>1</option></select><math/>still', "<em>in</em>still"),
    ("<DIV CLASS='note wild' id=7 ONCLICK=go()><p class=note>text</P></DIV>", '<div class="note"><p>text</p></div>'),
    ('<a data-ref="Alpha.1.2" href="//x">r</a><a data-ref="Alpha">s</a><a data-bdb=a.b.c>t</a>', '<a data-ref="Alpha.1.2">r</a><a>s</a><a data-bdb="a.b.c">t</a>'),
    ("<table><tr><td>1<td>2</tr>3", "<table><tr><td>1<td>2</td></td></tr>3</table>"),
    ("1 << 2 <3> <b <i>x</i>", "1 &lt;&lt; 2 &lt;3&gt; &lt;b <i>x</i>"),
    ("<main><section>text</section></main><br/><br>", "text<br><br>"),
    ("<svg><svg></svg>x</svg>y<i>z", "y<i>z</i>"),
    ("a<!-- <b> -->b<![CDATA[<i>]]>c<!-- d", "abc&lt;!-- d"),
    ("&#65;&#x42;&#0;&amp;lt;&nosuch;&copy &quot;", 'AB&amp;lt;&amp;nosuch;&amp;copy "'),
    ("<b/>x</b></i><style>unclosed", "<b></b>x"),
]


def test_sanitize(spark):
    for html, expected in SANITIZED:
        assert sanitize.sanitize_text(html) == (html if expected is None else expected)
    df = spark.createDataFrame([(h,) for h, _ in SANITIZED] + [(None,)], "h string")
    assert df.select(sanitize.sanitize("h").alias("s")).where("s is null").count() == 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<b>", "</b>", "<i", ">", "<", "</", "/>", "<script>", "</script>", '<a data-he="1"', " class='n'", "=", "x", " ", "&lt;", "&amp;", "&", "<!--", "-->", '"', "<td>", "<br>", "<svg/>", "<![CDATA[", "]]>", "on", "é"]), max_size=14).map("".join))
def test_sanitized_markup_is_safe_balanced_and_stays(html):
    out = sanitize.sanitize_text(html)
    assert sanitize.sanitize_text(out) == out
    path = []
    for piece in sanitize.pieces(out):
        if isinstance(piece, str):
            assert "<" not in piece
        elif piece.ends:
            assert path.pop() == piece.name
        else:
            assert piece.name in markup.ALLOWED_TAGS and all(name in markup.ALLOWED_TAGS[piece.name] for name, _ in piece.attributes)
            path += [piece.name] * (piece.name != "br")
    assert not path


#: Entries of our own choice.
HE = [("100", "נָהָר", "nahar", "river, stream", 117), ("101", "נָהַר", "nahar", "to flow", 6), ("205", "צִפּוֹר", "tsippor", "bird", 40), ("310 b", "חוֹל", "chol", "sand", 22)]
GR = [("πῦρ", "G400", "pŷr", "fire, flame", 71), ("πυρόω", "G401", "pyróō", "I burn, am on fire", 6), ("ποταμός", "G52", "potamós", "a river", 17), ("ἐν", "G90", "en", "in", 2700)]


def lexicon(spark, he=HE, gr=GR):
    h = spark.createDataFrame([(*r, None, i) for i, r in enumerate(he)], "id string, lemma string, transliteration string, gloss string, count int, source string, ordinal long")
    g = spark.createDataFrame([(*r, None, i) for i, r in enumerate(gr)], "lemma string, strong string, transliteration string, gloss string, count int, source string, ordinal long")
    return search.search_rows(h, g)


@pytest.mark.parametrize(
    ("query", "scope", "ids"),
    [("נהר", "all", ["100", "101"]), ("צפור", "all", ["205"]), ("ποταμός", "all", ["ποταμός"]), ("πυρ", "all", ["πῦρ", "πυρόω"]), ("H205", "all", ["205"]), ("G400", "all", ["πῦρ"]), ("H400", "all", []), ("G205", "all", []), ("52", "all", ["ποταμός"]), ("310", "all", ["310 b"]), ("river", "all", ["100", "ποταμός"]), ("river", "he", ["100"]), ("river", "gr", ["ποταμός"]), ("burn", "gr", ["πυρόω"]), ("flow", "he", ["101"]), ("\t", "all", [])],
)
def test_search(spark, query, scope, ids):
    assert [r.id for r in search.search(lexicon(spark), query, scope).collect()] == ids


def test_search_ranking_and_links(spark):
    he = [("11", "גַּל", "gal", "stone", 3), ("12", "אֶבֶן", "even", "stone, weight, jewel", 270), ("13", "צוּר", "tsur", "stone", 1), ("14", "סֶלַע", "sela", "a stone, cliff", 60)]
    rows = lexicon(spark, he)
    assert [r.id for r in search.search(rows, "stone", "he").collect()] == ["11", "13", "12", "14"]
    assert [r.id for r in search.search(rows, "stone", "he", opening_ranks=True).collect()] == ["11", "13", "12", "14"]
    assert search.word_link_text("he", "310 b") == "/word/he/310%20b"
    assert spark.range(1).select(search.word_link(F.lit("gr"), F.lit("γῆ"))).first()[0] == "/word/gr/%CE%B3%E1%BF%86"


def test_reconcile(spark):
    """By equal forms, without accents, and by a deponent's ending; case counts, and what is blocked stays apart."""
    known = ["Ἀθῆναι", "ποταμός", "φῶς", "δῶρον", "ἀστήρ", "πορεύω", "ἥλιος", "Πέτρα"]
    asked = {"Αθηναι": "Ἀθῆναι", "ποταμος": "ποταμός", "πορεύομαι": "πορεύω", "δωρον": None, "πέτρα": None, "νεφέλη": None}
    lemmas = spark.createDataFrame([(x,) for x in asked], "lemma string")
    targets = spark.createDataFrame([(x, i) for i, x in enumerate(known)], "target string, ordinal int")
    blocked = spark.createDataFrame([("δωρον", "δῶρον")], "lemma string, target string")
    found = matching.reconcile(lemmas, targets, "lemma", "target", "ordinal", greek.candidate_forms, greek.fold_case_sensitive, blocked)
    assert {r.lemma: r.target for r in found.collect()} == asked


def test_pick_and_first_wins(spark):
    pool = spark.createDataFrame([("1 a", "x", "Np", 0), ("1 a", "y", "N", 1), ("1", "z", "N", 2)], "key string, w string, pos string, o int")
    wanted = spark.createDataFrame([(1, "1 a", "1"), (2, "1 b", "1"), (3, "9", "9")], "_w int, id string, num string")
    found = matching.pick(wanted, pool, by=[("id", "key"), ("num", "key")], prefer=[F.col("pos") != "Np"], ordinal="o", out=["w", "o"])
    assert {r._w: r.w for r in found.collect()} == {1: "y", 2: "z", 3: None}
    assert {r.key: r.w for r in matching.first_wins(pool, "key", "o").collect()} == {"1 a": "x", "1": "z"}


def test_ranges(spark):
    rows = spark.createDataFrame([(i, "Gen", i) for i in range(1, 6)], "k int, book string, v int")
    rules = spark.createDataFrame([("Gen", 1, 2, 3, 31), ("Gen", 2, 3, 4, 99)], "book string, rule_no int, lo int, hi int, dest int")
    found = ranges.first_rule(rows, rules, ["book"], "v", "k")
    assert {r.k: r.p for r in found.select("k", ranges.shifted(F.col("v"), F.col("lo"), F.col("dest")).alias("p")).collect()} == {1: 1, 2: 31, 3: 32, 4: 100, 5: 5}
    assert [r[0] for r in spark.range(1, 5).select(ranges.titled(F.col("id"), F.lit(2))).collect()] == [1, 1, 1, 2]
    spans = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 3, 5), ("a", 7, 8)], "g string, s int, e int")
    assert [r.island for r in ranges.islands(spans, ["g"], "s", "e").orderBy("s").collect()] == [1, 1, 1, 2]


def test_chain_tolerates_loops_and_dangling_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "nowhere"), ("y", None)], "n string, nx string")
    walked = ranges.walk_chain(links, spark.createDataFrame([("a",), ("x",)], "n string"), "n", "nx")
    assert sorted((r.start, r.step, r.node) for r in walked.collect()) == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("x", 0, "x")]


def test_postings_blocks_hold_the_concordance(spark):
    rows = spark.createDataFrame([("w", d, i) for d in range(9) for i in range(3)], "lemma string, doc int, i int")
    whole = postings.concordance(rows, "lemma", ["doc", "i"]).first()
    parts = postings.postings(rows, "lemma", ["doc", "i"], "doc", 4).collect()
    assert sorted(p for r in parts for p in r.positions) == list(whole.positions) and sum(r.n for r in parts) == whole.n == 27


def test_gates(spark):
    df = spark.createDataFrame([(10, 0, 0), (20, 5, 5), (20, 10, 2), (0, 0, 0)], "words int, own int, joint int")
    assert quality.violations({"coverage": (df, quality.low_coverage(df)), "none": (df, F.lit(False))}).orderBy("gate").collect() == [("coverage", 2), ("none", 0)]
    with pytest.raises(Exception, match="too few"):
        quality.must_hold(df, F.col("words") > 0, "too few").collect()


def test_fingerprint_is_framed(spark):
    make = lambda rows: quality.fingerprint(spark.createDataFrame(rows, "path string, content string")).first()[0]
    assert make([("a", "bc")]) != make([("ab", "c")]) != make([("a", "b"), ("c", "")])
    assert make([("a", "1"), ("b", "2")]) == make([("b", "2"), ("a", "1")]) != make([("a", "2"), ("b", "1")])


def test_vocabulary_transitions():
    on = Settings()
    event = lambda kind, at, **more: {"key": "he:1", "kind": kind, "at": at, **more}
    state = None
    for e in [event("lookup", 1, form="a", chapter="Gen:1"), event("lookup", 2, form="a", chapter="Gen:2"), event("encounter", 3)]:
        state = fold_event(state, e, on)
    assert (state["lookups"], state["encounters"], state["forms"], state["chapters"], state["status"], state["first_lookup_at"]) == (2, 1, ["a"], ["Gen:1", "Gen:2"], "recognized", 1)
    assert fold_event(None, event("status", 1, status="known"), on) is None
    once = fold_event(None, event("encounter", 1), Settings(auto_known_after=1))
    assert once["status"] == "new"  # what an encounter made waits for the next
    assert fold_event(once, event("encounter", 2), Settings(auto_known_after=1))["status"] == "automatic"
    assert fold_event(None, event("encounter", 1), Settings(auto_known_after=0)) is None
    assert fold_event(None, event("known", 1), on)["status"] == "automatic"
    looked = fold_event(None, event("lookup", 1), Settings(lookup_marks_recognized=False))
    assert looked["status"] == "new" and fold_event(looked, event("known", 2), on)["status"] == "new"


@pytest.mark.parametrize("block", [2, 3, 1024])
@pytest.mark.parametrize("settings", [Settings(), Settings(auto_known_after=0), Settings(auto_known_after=2, lookup_marks_recognized=False), Settings(auto_known_after=1)])
def test_composed_maps_are_the_fold(spark, monkeypatch, block, settings):
    """All fields of all states, for keys of one event and of hundreds, at every block size; no Python worker takes part."""
    monkeypatch.setattr(vocabulary, "BLOCK", block)
    rng = random.Random(block)
    kinds = ["lookup", "encounter", "encounter", "encounter", "status", "known", "other", None]
    rows = [(f"k{min(rng.randint(0, 40), rng.randint(0, 40)) // 2 if i % 3 else 0}", rng.choices(kinds, [1 + i % 2, 3, 3, 3, 1, 1, 1, 1])[0], rng.randint(0, 50), i, rng.choice(["a", "b", f"f{i}", "", None]), rng.choice(["c", "d", None]), rng.choice([*vocabulary.STATUSES, "odd", None]), rng.choice(["", "g", None, f"g{i}"])) for i in range(260)]
    df = spark.createDataFrame([*rows, (None, "lookup", 1, 1, "a", "c", None, "")], "key string, kind string, at long, seq long, form string, chapter string, status string, gloss string")
    expected = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if r[1] in ("lookup", "encounter", "status", "known"):
            state = fold_event(expected.get(r[0]), dict(zip(df.columns, r, strict=True)), settings)
            expected.update({r[0]: state} if state else {})
    folded = vocabulary.fold_vocabulary(df.repartition(3), settings)
    assert {r.key: r.asDict() for r in folded.collect()} == expected
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()


def test_a_key_with_many_events_is_spread(spark):
    events = spark.range(30_000).select(F.lit("hot").alias("key"), F.when(F.col("id") % 3 == 0, "lookup").otherwise("encounter").alias("kind"), F.col("id").alias("at"), F.col("id").alias("seq"))
    state = vocabulary.fold_vocabulary(events).first()
    assert (state.lookups, state.encounters, state.status, state.updated_at, state.status_changed_at) == (10_000, 20_000, "recognized", 29_999, 0)


def test_progress_is_monotone(spark):
    df = spark.createDataFrame([("Gen", 1, False, 1), ("Gen", 1, True, 2), ("Gen", 1, False, 3)], "book string, ch int, done boolean, at long")
    assert tuple(vocabulary.chapter_progress(df).first()) == ("Gen", 1, True, 2, 3)


def test_status_counts_have_zeros(spark):
    states = spark.createDataFrame([("he", "new"), ("he", "known"), ("gr", "new")], "lang string, status string")
    rows = {(r.lang, r.status): r.n for r in vocabulary.status_counts(states, "lang").collect()}
    assert rows[None, "new"] == 2 and rows["he", "known"] == 1 and rows["gr", "automatic"] == 0 and len(rows) == 15


def test_stream_is_the_batch(spark, tmp_path):
    from corpuscle.streaming.vocabulary import stream_vocabulary

    schema = "key string, kind string, at long, seq long, form string, chapter string, status string, gloss string"
    rows = [("a", "lookup", 1, 1, "f", "c", None, ""), ("a", "encounter", 2, 2, None, None, None, ""), ("b", "encounter", 3, 3, None, None, None, "")]
    spark.createDataFrame(rows[:2], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream_vocabulary(stream).writeStream.outputMode("update").format("memory").queryName("vocab").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    spark.createDataFrame(rows[2:] + [("a", "encounter", 4, 4, None, None, None, "")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    last = {r.key: (r.lookups, r.encounters) for r in spark.sql("select * from vocab").orderBy("updated_at").collect()}
    assert last == {"a": (1, 2), "b": (0, 1)}


def test_a_chain_of_any_length(spark):
    """Thousands of links take a few rounds; of two links the least counts."""
    n = 5000
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(7, 9999)], "a long, b long"))
    walked = ranges.walk_chain(links, links.where("a in (0, 4990)"), "a", "b")
    assert {r.start: (r.n, r.last) for r in walked.groupBy("start").agg(F.count("*").alias("n"), F.max("step").alias("last")).collect()} == {0: (n, n - 1), 4990: (10, 9)}
    stopped = ranges.walk_chain(links, links.where("a = 0"), "a", "b", stop=spark.createDataFrame([(5,)], "a long"))
    assert sorted(r.node for r in stopped.collect()) == [0, 1, 2, 3, 4]


def test_range_scan_is_the_join(spark):
    rng = random.Random(9)
    spans = [(g, lo, lo + rng.randint(0, 40), i) for i, (g, lo) in enumerate((rng.choice("ab"), rng.randint(0, 90)) for _ in range(30))]
    rows = [(rng.choice("ab"), rng.randint(0, 120), k) for k in range(80)]
    got = ranges.range_scan(spark.createDataFrame(spans, "g string, lo int, hi int, i int"), spark.createDataFrame(rows, "g string, p int, k int"), ["g"], "lo", "hi", "p", width=8)
    assert sorted((r.i, r.k) for r in got.collect()) == sorted((i, k) for g, lo, hi, i in spans for h, p, k in rows if g == h and lo <= p <= hi)


def test_told_only_once_written(spark, tmp_path):
    from corpuscle.streaming.vocabulary import write_then_notify

    spark.range(3).write.parquet(str(tmp_path / "in"))
    log = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = write_then_notify(stream, lambda rows: log.append(("written", rows.count())), lambda number: log.append(("told", number)), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert log == [("written", 3), ("told", 0)]
