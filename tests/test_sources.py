import json

from pyspark.sql import functions as F

from corpuscle.sources import readers, writers


def test_hebrew_text(spark, tmp_path):
    (tmp_path / "Gen.json").write_text(json.dumps({"versions": [{"versionTitle": "Some Edition", "text": [["א ב", "<small>ג</small>", "<u>ד</u> x"], ["—"]]}]}))
    verses = readers.hebrew_text(spark, str(tmp_path), "Edition")
    rows = readers.parsed_verses(verses).orderBy("ch", "v").collect()
    assert [(r.book, r.ch, r.v, r.text, r.absent, r.clean) for r in rows] == [("Gen", 1, 1, "א ב", False, True), ("Gen", 1, 2, "ג", False, True), ("Gen", 1, 3, "x", False, False), ("Gen", 2, 1, "", True, True)]
    assert rows[2].problems == ["u", "character x"]


def test_hebrew_analysis(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<t><verse osisID="Gen.1.1"><w lemma="b/7225" morph="HR/Ncfsa">בְּ/רֵאשִׁית</w><w type="x-ketiv" lemma="1">x</w><w>y</w></verse></t>')
    rows = readers.hebrew_analysis(spark, str(tmp_path)).orderBy("i").collect()
    assert [(r.osis, r.i, r.lemma, r.morph) for r in rows] == [("Gen.1.1", 0, "b/7225", "HR/Ncfsa"), ("Gen.1.1", 1, "", "")]


def test_greek_text(spark, tmp_path):
    (tmp_path / "61.txt").write_text("010101 N- ----NSF- Βίβλος Βίβλος βίβλος βίβλος\n010101 C- -------- ⸀καὶ καὶ καί καί\n010102 C- -------- καὶ καὶ καί καί\n")
    rows = readers.greek_text(spark, str(tmp_path)).orderBy("v", "i").collect()
    assert [(r.book_no, r.ch, r.v, r.i, r.pos, r.parse, r.text, r.lemma) for r in rows] == [(1, 1, 1, 0, "N-", "----NSF-", "Βίβλος", "βίβλος"), (1, 1, 1, 1, "C-", None, "καὶ", "καί"), (1, 1, 2, 0, "C-", None, "καὶ", "καί")]


def test_dictionaries(spark, tmp_path):
    for name, text in {
        "index.xml": '<i><entry id="a"><w xlit="x">אב</w><pos>N</pos><def>father</def><xref strong="1" aug="a" bdb="a.aa"/></entry><entry id="b"><w>ב</w></entry></i>',
        "bdb.xml": '<l><section id="a.a"><entry id="a.a.a" type="root"><w>אב</w> <w>אבב</w> <pos>vb</pos> <w>no</w><def>be</def></entry><entry id="a.a.b"><w>ג</w><def>x</def><def>y</def></entry></section></l>',
        "s.js": 'var d = {"G1": {"lemma": "Α", "strongs_def": "x"}}; module.exports = d',
        "g.tsv": 'S\ta\tb\tc\td\n"1"\t\t\t"say ""x"""\tlong\nno\t\t\tz\tz\n',
        "t.xml": '<x><entry n="λόγος|G3056"><note type="occurrencesNT">330</note><gloss>a word</gloss><ref target="H1697">דבר</ref></entry><entry n="λόγος|G1"><gloss>z</gloss></entry></x>',
        "o.json": '{"1": "a", "2": {"g": "b", "noFull": true}, "_alias": {"x": "y"}}',
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_text(text)
    at = lambda name: str(tmp_path / name)
    assert [(r.id, r.bdb, r.w) for r in readers.lexical_index(spark, at("index.xml")).collect()] == [("1 a", "a.aa", "אב")]
    rows = readers.outline(spark, at("bdb.xml")).orderBy("ordinal").collect()
    assert [(r.section, r.entry, r.is_root, r.w, r.spellings, r.defs) for r in rows] == [("a.a", "a.a.a", True, "אב", ["אב", "אבב"], ["be"]), ("a.a", "a.a.b", False, "ג", ["ג"], ["x", "y"])]
    assert [(r.id, r.lemma) for r in readers.number_dictionary(spark, at("s.js")).collect()] == [("G1", "Α")]
    assert [tuple(r) for r in readers.gloss_table(spark, at("g.tsv")).collect()] == [("G1", 'say "x"', "long")]
    (entry,) = readers.tei_lexicon(spark, at("t.xml")).collect()
    assert (entry.lemma, entry.g, entry.nt, entry.glosses, [tuple(x) for x in entry.hebrew]) == ("λόγος", "G3056", 330, ["a word"], [(1697, "דבר")])
    assert sorted((r.key, r.g, r.no_full) for r in readers.overrides(spark, at("o.json")).collect()) == [("1", "a", None), ("2", "b", True)]


def test_crawl(spark, tmp_path):
    for folder, name, html in (("BDB", "1.json", "x"), ("BDB_Aramaic", "2.json", "y"), ("BDB", "_skip.json", "z"), ("BDB", "3.json", "")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"ref": name, "hw": "אָב²", "html": html, "next": None, "prev": None}))
    rows = readers.dictionary_crawl(spark, str(tmp_path)).orderBy("ref").collect()
    assert [(r.ref, r.hw, r.cons, r.aramaic) for r in rows] == [("1.json", "אָב", "אב", False), ("2.json", "אָב", "אב", True)]


def test_interlinear(spark):
    rows = [(1, 1.0, None, "he", "x", None, "lost"), (2, None, None, "he", None, "Gen 1:1", None), (3, 1.0, None, "he", "a", None, "g"), (4, 2.0, None, "he", "b", None, None), (5, None, None, "he", "c", None, "no place"), (6, 1.0, None, "he", "d", "Gen 1:2", "h")]
    out = readers.interlinear(spark.createDataFrame(rows, readers.INTERLINEAR)).orderBy("verse_id", "sort").collect()
    assert [(r.verse_id, r.word, r.gloss) for r in out] == [("Gen 1:1", "a", "g"), ("Gen 1:1", "b", None), ("Gen 1:2", "d", "h")]


def test_books_shards_and_back(spark, tmp_path):
    verses = spark.createDataFrame([("he", "Gen", 1, 2, "b"), ("he", "Gen", 1, 1, "a"), ("gr", "Matt", 1, 1, "c")], "lang string, book string, ch int, v int, t string")
    books = writers.nested_books(verses, ["t"])
    writers.write_books(books, str(tmp_path / "books"), "parquet")
    got = readers.book(spark, str(tmp_path / "books"), "he", "Gen").first()
    assert [(v.n, v.t) for v in got.chapters[0].verses] == [(1, "a"), (2, "b")]
    rows = spark.createDataFrame([("he", "10", "3000"), ("he", "2", "700"), ("gr", "α", "ἀγάπη")], "lang string, shard string, id string")
    manifest = writers.write_shards(rows, str(tmp_path / "lex"))
    assert [tuple(r) for r in manifest.collect()] == [("gr", "α"), ("he", "2"), ("he", "10")]
    assert readers.dictionary_entry(spark, str(tmp_path / "lex"), "he", "2", "700").count() == 1
    books_dim = spark.createDataFrame([("Gen", "he", "Genesis", "Torah", 0)], "id string, lang string, en string, section string, idx int")
    assert writers.canon(verses, books_dim).first().verses == [2]


def test_export_and_checksums(spark, tmp_path):
    states = spark.createDataFrame([("a", "new")], "key string, status string")
    (doc,) = [json.loads(r.json) for r in writers.vocabulary_export(states, spark.createDataFrame([("a", 5)], "key string, at long"), "now").collect()]
    assert doc == {"exportedAt": "now", "lexemes": [{"key": "a", "status": "new"}], "lookups": [{"key": "a", "at": 5}]}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_bytes(b"abc")
    (row,) = writers.checksum_manifest(readers.files(spark, str(tmp_path))).collect()
    assert row.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert readers.with_context(spark.createDataFrame([(1,)], "i int"), None).select(F.col("context")).first()[0] is None


def test_curated_files_and_crawls(spark, tmp_path):
    """Settings of curated files, blocked pairs, a crawl with nested senses, and side tables of a run."""
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("greek.json", '{"_note": {"why": "x"}, "\u03c0\u1fe6\u03c1": {"strong": "G400", "why": "spelling"}, "none": {"why": "a name"}}')
    assert sorted(tuple(r) for r in readers.greek_overrides(spark, str(tmp_path / "greek.json")).collect()) == [("none", None, "a name"), ("πῦρ", "G400", "spelling")]
    put("aliases.json", '{"_alias": {"a": "b"}, "c": "d"}')
    assert [tuple(r) for r in readers.aliases(spark, str(tmp_path / "aliases.json")).collect()] == [("a", "b")]
    put("blocked.json", '{"x|y": "no", "_note": "n"}')
    assert [tuple(r) for r in readers.blocked_pairs(spark, str(tmp_path / "blocked.json")).collect()] == [("x", "y")]
    (tmp_path / "crawl").mkdir()
    put("crawl/one.json", '{"rid": "r1", "headword": "חוֹל²", "content": {"senses": [{"definition": "sand", "senses": [{"definition": "fine"}]}]}}')
    put("crawl/two.json", '{"rid": "r2", "headword": "גל", "content": {"senses": []}}')
    put("crawl/_three.json", '{"rid": "r3", "headword": "גל", "content": {"senses": [{"definition": "x"}]}}')
    (row,) = readers.senses_crawl(spark, str(tmp_path / "crawl")).collect()
    assert (row.rid, row.hw, row.cons) == ("r1", "חוֹל", "חול") and "fine" in row.content
    writers.write_diagnostics({"stats": spark.range(3), "conflicts": spark.range(2)}, str(tmp_path / "side"))
    assert spark.read.parquet(str(tmp_path / "side" / "stats")).count() == 3 and spark.read.parquet(str(tmp_path / "side" / "conflicts")).count() == 2


def test_lemma_words(spark, tmp_path):
    (tmp_path / "b1.json").write_text('[{"words": [{"lemma": "x"}, {"lemma": null}]}, {"words": []}, {"words": [{"lemma": "y"}]}]')
    assert sorted((r.book, r.i, r.lemma) for r in readers.lemma_words(spark, str(tmp_path / "b1.json")).collect()) == sorted([("b1", 0, "x"), ("b1", 1, None), ("b1", 0, "y")], key=str)


def test_sheet_blocks_carry_on(spark, monkeypatch):
    """A verse runs on over blocks of the sheet, also over one that names none."""
    monkeypatch.setattr(readers, "BLOCK_ROWS", 4)
    rows = [(i, float(i), "7" if i == 2 else "9" if i == 13 else None, f"w{i}", "g") for i in range(16)]
    sheet = spark.createDataFrame(rows, "row_no int, heb_sort double, verse_id string, word string, gloss string")
    got = {r.word: r.verse_id for r in readers.interlinear(sheet).collect()}
    assert got == {f"w{i}": "7" if i < 13 else "9" for i in range(2, 16)}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Elements of one file, cut at any byte: each comes once, in order; what is empty, closed at once or outside counts as it stands."""
    entries = [f'<entry n="w{i}|G{i}"><gloss>{"x" * (i % 700)}</gloss></entry>\n' if i % 9 else f'<entry n="w{i}"/>' for i in range(3000)]
    (tmp_path / "a.xml").write_text("<tei><head>a</head>" + "".join(entries) + "<tail>z</tail></tei>")
    (tmp_path / "b.xml").write_text("<tei>none</tei>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = readers.elements(spark, str(tmp_path), "entry")
        assert found.rdd.getNumPartitions() > 10
        assert [r.body for r in found.orderBy("ordinal").collect()] == [e.strip() for e in entries]
        assert readers.tei_lexicon(spark, str(tmp_path)).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_descriptors_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "open", "u", "1"), ("b", None, "u", None)], writers.DESCRIPTOR)
    writers.write_descriptors(rows, f"{tmp_path}/d")
    assert sorted((r.name, r.licence, r.missing) for r in readers.descriptors(spark, f"{tmp_path}/d").collect()) == [("a", "open", None), ("b", None, "licence,revision")]
