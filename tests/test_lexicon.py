from pyspark.sql import functions as F

from corpuscle.functions import morphology
from corpuscle.operators import lexicon, rendering

VERSE = "שִׁ֣ירוּ לָכֶ֔ם ׀ עַל־פְּנֵי֙ מַ֥יִם רַבִּֽים׃"


def test_render_outline_and_tei(spark):
    outline = '<w src="a.ab.ab">אב</w> <pos>n.m</pos> <page p="1"/><status p="1">x</status><sense n="1"><def>father</def> <ref r="Gen.1.1">Gn</ref></sense>'
    tei = '<orth>λόγος</orth> <note type="occurrencesNT">330</note><foreign xml:lang="heb" n="H1697">דבר</foreign><sense><gloss>word</gloss><lb/><gramGrp><gram>x</gram></gramGrp></sense><!-- no -->'
    df = spark.createDataFrame([(outline, tei), (None, None)], "o string, t string").select(rendering.render_outline("o").alias("o"), rendering.render_tei("t").alias("t")).collect()
    assert df[0].o == '<a class="he-inline" data-bdb="a.ab.ab">אב</a><i>n.m</i><div class="sense"><span class="n">1</span><b>father</b><a data-ref="Gen.1.1">Gn</a></div>'
    assert df[0].t == '<b>λόγος</b><a class="he-inline" data-he="1697">דבר</a><div class="sense"><b>word</b><br><i><i>x</i></i></div>'
    assert df[1].o is None


def test_senses_and_links(spark):
    content = '{"senses": [{"number": "1", "definition": "<a data-ref=\\"I Kings 3:4-5\\" href=\\"/x\\">k</a> <a href=\\"/y\\">z</a>", "senses": [{"definition": "<strong>b</strong>"}]}]}'
    df = rendering.with_rendered_senses(spark.createDataFrame([(1, content), (2, None)], "id int, c string"), "c", {"I Kings": "1Kgs"}).where("id = 1")
    html = df.first().html
    assert html == '<div class="sense"><span class="n">1</span> <a data-ref="1Kgs.3.4">k</a> <span>z</span><div class="sense"><b>b</b></div></div>'
    pages = spark.createDataFrame([(1, html + '<a data-he="5">x</a><a data-bdb="a.a">y</a><a data-bdb="a.b">y</a><a data-ref="Tob.1">t</a>')], "id int, h string")
    canon = spark.createDataFrame([("1Kgs",)], "id string")
    xref = spark.createDataFrame([("a.a", ["1", "2"])], "bdb string, options array<string>")
    assert sorted(tuple(r)[1:] for r in rendering.routed(pages, "h", "id", canon, xref).collect()) == [("bdb", "a.a", "choice"), ("bdb", "a.b", "none"), ("he", "5", "word"), ("ref", "1Kgs.3.4", "read"), ("ref", "Tob.1", "none")]


def test_fits(spark):
    cases = [("<i>m</i> adj. wide", "adjective", 1), ("adj. wide", "verb", -1), ("n.pr.loc. Tel", "gentilic", 1), ("n.pr.loc. Tel", "noun", -1), ("subst. depth", "noun", 1), ("vb. flow", "proper noun", -1), ("n.f. well", "adjective", 0), ("vb. flow", "adverb", -1), ("n.f. well", "adverb", 0), ("vb. flow", "", 0), ("vb. flow", None, 0)]
    row = spark.range(1).select(*[lexicon.pos_fit(F.lit(h), F.lit(p).cast("string")).alias(f"c{i}") for i, (h, p, _) in enumerate(cases)], lexicon.hint_fit(F.lit("<b>deep</b> wells of the watery-place"), F.lit("Well, water; which is deeper")).alias("h")).first()
    assert tuple(row) == (*[x for *_, x in cases], 2)


def test_full_entries(spark):
    entries = [("r1", 0, ["1"], "דבר", False, "n.m. word", "words"), ("r2", 1, ["1", "2", "3", "4"], "אחר", False, "vb. other", "words"), ("r3", 2, [], "אהרון", False, "n.pr. Aaron", "text")]
    e = spark.createDataFrame(entries, "ref string, ordinal int, strongs array<string>, cons string, aramaic boolean, html string, source string")
    lemmas = [("1", "1", "דָּבָר", False, "noun", ""), ("2", "2", "זר", False, "noun", ""), ("175", "175", "אהרן", False, "proper noun", "")]
    ids = spark.createDataFrame(lemmas, "id string, num string, lemma string, aramaic boolean, pos string, hint string")
    assert {r.id: r.ref for r in lexicon.full_entries(ids, e).collect()} == {"1": "r1", "2": None, "175": "r3"}
    assert {r.id: r.ref for r in lexicon.full_entries(ids, e, strict=True).collect()} == {"1": "r1", "2": None, "175": None}


def test_cross_references_and_assembly(spark):
    lemmas = spark.createDataFrame([("2", "ב", "b", 1, "x"), ("1", "א", "a", 0, "x"), ("3", "ג", "c", 2, None)], "id string, lemma string, gloss string, ordinal int, bdb string")
    assert [[o.id for o in r.options] for r in lexicon.cross_references(lemmas).collect()] == [["1", "2"]]
    out = lexicon.assembled(
        spark.createDataFrame([("1", "1"), ("1 a", "1"), ("9", "9")], "id string, num string"), spark.createDataFrame([("1", "אב", "x", "noun", "a.a"), ("1 a", "גד", None, "noun", None)], "id string, w string, xlit string, pos string, bdb string"),
        spark.createDataFrame([("1", "אָב", "awb", "pron", "root")], "num string, n_lemma string, n_xlit string, pron string, derivation string"), spark.createDataFrame([("a.a", "<b>f</b>")], "bdb string, html string"), spark.createDataFrame([("1", 5), ("1 a", 2)], "id string, n int"),
    )
    assert {r.id: (r.lemma, r.xlit, r.pron, r.html, r.n) for r in out.collect()} == {"1": ("אב", "x", "pron", "<b>f</b>", 5), "1 a": ("גד", None, None, None, 2)}


def test_segments(spark):
    decoded = morphology.decode_hebrew(F.lit("c/b/1870"), F.lit("HC/R/Ncbsc/Sp3ms"))
    word = "וּבְדַרְכּוֹ"
    got, failed = spark.range(1).select(lexicon.segments(F.lit(word), F.lit("ו/ב/דרכ/ו"), decoded), lexicon.segments(F.lit(word), F.lit("ו/ב"), decoded)).first()
    assert [s.kind for s in got] == ["conjunction", "preposition", "stem", "suffix-pronoun"] and "".join(s.form for s in got) == word
    assert [(s.form, s.kind) for s in failed] == [(word, "stem")]


def test_lines(spark):
    words = spark.createDataFrame([("a", 0, "In", None, "1", ["b"]), ("a", 1, "", "", "2", []), ("a", 2, None, "", None, ["c"])], "v string, i int, context string, gloss string, lex_id string, prefixes array<string>").withColumn("printed", F.lit("x"))
    rows = [(r.shown_context, r.shown_gloss) for r in lexicon.interlinear(words).orderBy("i").collect()]
    assert rows == [("In", "no gloss"), ("‒", "no gloss"), ("·", "and")]
    assert lexicon.verse_line(words, ["v"]).first().line == "In"
    line = lambda has: [r[0] for r in words.orderBy("i").select(lexicon.gloss_line(F.lit(has), F.col("context"), F.col("gloss"), F.col("prefixes"))).collect()]
    assert line(True) == ["In", "‒", "·"] and line(False) == ["in / with", "·", "and"]
    pieces = spark.range(1).select(lexicon.verse_pieces(F.lit("א־ב ׀ ג׃"))).first()[0]
    assert [tuple(p) for p in pieces] == [("א", True, False), ("ב", False, False), ("ג", False, True)]
    assert spark.range(1).select(F.size(lexicon.verse_pieces(F.lit(VERSE)))).first()[0] == 6
