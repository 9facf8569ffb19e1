"""Readers of the corpus and dictionary formats, each with a declared schema, to flat tables with an ordinal where order counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import greek, hebrew
from corpuscle.operators import verses
from corpuscle.session import broadcast_if_few
from corpuscle.sources import writers

TEXT_JSON = "versions array<struct<versionTitle:string,text:array<array<string>>>>"
VERSE_XML = "_osisID string, w array<struct<_VALUE:string,_lemma:string,_morph:string,_type:string>>"
INDEX_XML = "_id string, w struct<_VALUE:string,_xlit:string>, pos string, def string, xref struct<_strong:string,_aug:string,_bdb:string>, etym struct<_root:string>"
NUMBERS_JSON = "map<string,struct<lemma:string,xlit:string,translit:string,pron:string,derivation:string,strongs_def:string,kjv_def:string>>"
CRAWL_JSON = "ref string, hw string, html string, next string, prev string"
WORDS_JSON = "words array<struct<lemma:string>>"
GLOSS_TSV = "strong string, c1 string, c2 string, brief string, long string"
#: Rows of a sheet that are filled together.
BLOCK_ROWS = 65536
INTERLINEAR = "row_no int, heb_sort double, greek_sort double, language string, word string, verse_id string, gloss string"


def hebrew_text(spark: SparkSession, path: str, edition: str) -> DataFrame:
    """book, ch, v, html from one JSON per book; reading fails if a file isn't of the edition."""
    raw = spark.read.schema(TEXT_JSON).json(path, multiLine=True).withColumn("book", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    checked = raw.withColumn("version", F.get("versions", 0)).where(F.assert_true(F.col("version.versionTitle").contains(edition), "unexpected edition").isNull())
    chapters = checked.select("book", F.posexplode("version.text").alias("c", "verses"))
    return chapters.select("book", (F.col("c") + 1).alias("ch"), F.posexplode("verses").alias("p", "html")).select("book", "ch", (F.col("p") + 1).alias("v"), "html")


def parsed_verses(found: DataFrame) -> DataFrame:
    """book, ch, v, text, absent, annotations, problems, kq (written and read forms), pe, samekh, clean (without problems)."""
    parsed = verses.with_verses(found, "html").drop("html")
    of = lambda *kinds: F.filter("annotations", lambda a: a["kind"].isin(*kinds))
    shown = lambda a: F.substring(F.col("text"), a["start"] + 1, a["end"] - a["start"])
    forms = F.transform(of("pair", "read", "written"), lambda a: F.struct(F.nullif(a["value"], F.lit("")).alias("k"), F.nullif(shown(a), F.lit("")).alias("q")))
    return parsed.withColumns({"kq": forms, "pe": F.size(of("pe")) > 0, "samekh": F.size(of("samekh")) > 0, "clean": F.size("problems") == 0})


def elements(spark: SparkSession, path: str, name: str) -> DataFrame:
    """body, ordinal: the elements of a name in files of XML, each as its own text; ordinals are in order of file and place.

    A large file is read by many tasks: the name's opening is what parts Spark's lines, so a task's stretch of a file
    begins with the first element that opens in it. Elements of the name don't nest, and no other name begins with it.
    What lies outside of them is passed over.
    """
    lines = spark.read.text(path, lineSep=f"<{name}")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    end = f"</{name}>"
    body = F.when(F.col("value").contains(end), F.concat(F.substring_index("value", end, 1), F.lit(end))).otherwise(F.regexp_extract("value", r"^([^<>]*/>)", 1))
    found = lines.select(body.alias("body"), place.alias("ordinal")).where(r"body rlike '^[\\s>/]'")
    return found.select(F.concat(F.lit(f"<{name}"), "body").alias("body"), "ordinal")


def hebrew_analysis(spark: SparkSession, path: str) -> DataFrame:
    """osis, i (from 0), word, lemma, morph of the words that are read; missing attributes are empty."""
    verses = elements(spark, path, "verse").select(F.from_xml("body", VERSE_XML).alias("e")).select("e.*")
    kept = F.filter("w", lambda x: ~x["_type"].eqNullSafe("x-ketiv"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return verses.select(F.col("_osisID").alias("osis"), F.posexplode(kept).alias("i", "x")).select("osis", "i", text("x._VALUE").alias("word"), text("x._lemma").alias("lemma"), text("x._morph").alias("morph"))


def greek_text(spark: SparkSession, path: str) -> DataFrame:
    """file, book_no, ch, v, i (from 0), pos, parse (null if empty), text, lemma from lines of seven columns; the line order counts."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    cols = F.split(F.trim("value"), " ")
    rows = files.where(F.size(cols) >= 7).select("file", "line", *[F.substring(cols[0], lo, 2).cast("int").alias(n) for lo, n in ((1, "book_no"), (3, "ch"), (5, "v"))], cols[1].alias("pos"), F.nullif(cols[2], F.lit("--------")).alias("parse"), greek.strip_sigla(cols[3]).alias("text"), cols[6].alias("lemma"))
    from corpuscle.operators.postings import ordinals

    return ordinals(rows, ["file", "book_no", "ch", "v"], ["line"])


def lexical_index(spark: SparkSession, path: str) -> DataFrame:
    """id (number, with its letter), bdb, pos, def, xlit, w, root, ordinal; several rows may have one id. Rows without a number go."""
    raw = elements(spark, path, "entry").select("ordinal", F.from_xml("body", INDEX_XML).alias("e")).select("ordinal", "e.*")
    key = F.concat_ws(" ", F.col("xref._strong"), F.nullif(F.col("xref._aug"), F.lit("")))
    return raw.where("xref._strong is not null").select(key.alias("id"), F.col("xref._bdb").alias("bdb"), "pos", "def", F.col("w._xlit").alias("xlit"), F.col("w._VALUE").alias("w"), F.col("etym._root").alias("root"), "ordinal")


def outline(spark: SparkSession, path: str) -> DataFrame:
    """section, entry, type, is_root, w (first spelling), spellings (before the first part of speech or definition), defs, body, ordinal."""
    sections = elements(spark, path, "section").select(F.col("ordinal").alias("s"), F.col("body").alias("section"))
    # a section's own columns first: beside posexplode they would be made again, from the whole section, for each entry
    listed = sections.select("s", F.regexp_extract("section", 'id="([^"]*)"', 1).alias("section"), F.regexp_extract_all("section", F.lit(r"(?s)<entry [^>]*>.*?</entry>"), F.lit(0)).alias("entries"))
    entries = listed.select("s", "section", F.posexplode("entries").alias("e", "body"))
    attribute = lambda name: F.regexp_extract("body", f'^<entry [^>]*{name}="([^"]*)"', 1)
    before = F.regexp_extract("body", r"(?s)^(.*?)(?:<pos>|<def>|$)", 1)
    spellings = F.regexp_extract_all(before, F.lit(r"<w[^>]*>([^<]*)</w>"), F.lit(1))
    rows = entries.select("section", attribute("id").alias("entry"), attribute("type").alias("type"), F.get(F.regexp_extract_all("body", F.lit(r"<w[^>]*>([^<]*)</w>"), F.lit(1)), 0).alias("w"), spellings.alias("spellings"), F.regexp_extract_all("body", F.lit(r"<def>([^<]*)</def>"), F.lit(1)).alias("defs"), F.regexp_replace("body", r"(?s)^<entry [^>]*>|</entry>$", "").alias("body"), F.struct("s", "e").alias("ordinal"))
    from corpuscle.operators.matching import first_wins

    roots = first_wins(rows.where("type = 'root'").select("section", "ordinal", F.col("entry").alias("_root")), "section", "ordinal").select("section", "_root")
    return rows.join(roots, "section", "left").withColumn("is_root", F.coalesce(F.col("entry") == F.col("_root"), F.lit(False))).drop("_root")


def number_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id and fields of a script file that wraps one JSON object: what lies between the first and the last brace."""
    body = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_extract("value", r"(?s)(\{.*\})", 1), NUMBERS_JSON).alias("m"))
    return body.select(F.explode("m").alias("id", "e")).select("id", "e.*")


def gloss_table(spark: SparkSession, path: str) -> DataFrame:
    """id (G and number), brief, long; rows without a number go."""
    rows = spark.read.schema(GLOSS_TSV).csv(path, sep="\t", quote='"', escape='"', header=True)
    n = F.regexp_extract("strong", "([0-9]+)", 1)
    return rows.where(n != "").select(F.concat(F.lit("G"), F.regexp_replace(n, "^0+(?=.)", "")).alias("id"), "brief", "long")


def tei_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """lemma, g, nt (occurrences), glosses, hebrew (array<struct<num,w>>), body, ordinal; the first entry of a lemma counts."""
    whole = elements(spark, path, "entry").where("body rlike '^<entry n=\"'")
    name = F.split(F.regexp_extract("body", 'n="([^"]*)"', 1), "\\|")
    refs = F.regexp_extract_all("body", F.lit(r'<ref target="H?([0-9]+)"[^>]*>[^<]*</ref>'), F.lit(1))
    forms = F.regexp_extract_all("body", F.lit(r'<ref target="H?[0-9]+"[^>]*>([^<]*)</ref>'), F.lit(1))
    rows = whole.select(name[0].alias("lemma"), F.get(name, 1).alias("g"), F.regexp_extract("body", r"<note type=\"occurrencesNT\">([0-9]+)", 1).try_cast("int").alias("nt"), F.regexp_extract_all("body", F.lit("<gloss>([^<]*)</gloss>"), F.lit(1)).alias("glosses"), F.zip_with(refs, forms, lambda n, w: F.struct(n.cast("int").alias("num"), w.alias("w"))).alias("hebrew"), "body", "ordinal")
    from corpuscle.operators.matching import first_wins

    return first_wins(rows, "lemma", "ordinal")


def dictionary_crawl(spark: SparkSession, path: str) -> DataFrame:
    """ref, hw, html, next, prev, cons, bare, aramaic from one JSON per entry; the folder's name tells the language; entries without text go."""
    raw = spark.read.schema(CRAWL_JSON).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.json").json(path, multiLine=True)
    return crawl_rows(raw.select("*", F.input_file_name().rlike("Aramaic").alias("aramaic")))


def crawl_rows(raw: DataFrame) -> DataFrame:
    """Entries with text, their headwords without homograph digits, as consonants and without vowel letters."""
    head = hebrew.strip_homograph(F.col("hw"))
    return raw.where(F.coalesce("html", F.lit("")) != "").withColumns({"hw": head, "cons": hebrew.consonants(head), "bare": hebrew.bare(head)})


def interlinear(rows: DataFrame, sort: str = "heb_sort") -> DataFrame:
    """verse_id, sort, word, gloss of a sheet (row_no, verse_id on a verse's first row, word, gloss, sorts), read as CSV or Parquet.

    The verse carries on to the rows below, also from a row that has no word itself; rows before the first verse,
    without a word, or without a place go.
    """
    from corpuscle.operators.ranges import forward_fill

    told = F.nullif(F.trim("verse_id"), F.lit(""))
    blocks = rows.withColumn("_block", F.floor(F.col("row_no") / BLOCK_ROWS))
    filled = forward_fill(blocks, ["_block"], ["row_no"], told, "verse")
    # what the blocks before leave to a block: one row for each, so that window is small
    last = blocks.groupBy("_block").agg(F.max_by(told, F.when(told.isNotNull(), F.col("row_no"))).alias("_last"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    filled = filled.join(broadcast_if_few(carried), "_block").withColumn("verse", F.coalesce("verse", "_carried"))
    return filled.where(f"verse is not null and coalesce(word, '') <> '' and {sort} is not null").select(F.col("verse").alias("verse_id"), F.col(sort).alias("sort"), "word", "gloss")


def lemma_words(spark: SparkSession, path: str) -> DataFrame:
    """book, verse, i, lemma from JSON arrays of verses with words."""
    raw = spark.read.schema(WORDS_JSON).json(path, multiLine=True).withColumns({"book": F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1), "verse": F.monotonically_increasing_id()})
    return raw.select("book", "verse", F.posexplode("words").alias("i", "x")).select("book", "verse", "i", "x.lemma")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """key, g, pos, x, no_full of curated values that are texts or objects; keys with an underscore are settings and go."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("key", "value"))
    obj = F.from_json("value", "struct<g:string,pos:string,x:string,noFull:boolean>")
    is_obj = F.col("value").startswith("{")
    return whole.where(~F.col("key").startswith("_")).select("key", F.when(is_obj, obj["g"]).otherwise(F.col("value")).alias("g"), *[F.when(is_obj, obj[c]).alias(n) for c, n in (("pos", "pos"), ("x", "x"), ("noFull", "no_full"))])


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def book(spark: SparkSession, path: str, lang: str, name: str) -> DataFrame:
    """One book of a partitioned corpus: only its folder is read."""
    return spark.read.parquet(path).where((F.col("lang") == lang) & (F.col("book") == name))


def dictionary_entry(spark: SparkSession, path: str, lang: str, shard: str, key: str) -> DataFrame:
    """One entry of a sharded lexicon: only its shard's folder is read."""
    return spark.read.parquet(path).where((F.col("lang") == lang) & (F.col("shard") == shard) & (F.col("id") == key))


def dictionary_entries(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (lang, shard, id and more) with the entries of a sharded lexicon; keys that it doesn't have stay, with nulls.

    Of a bounded number of keys only their shards' folders are read.
    """
    entries = spark.read.parquet(path)
    asked = wanted.select("lang", F.col("shard").cast(entries.schema["shard"].dataType).alias("shard"), "id").distinct()
    found = entries.join(broadcast_if_few(asked), ["lang", "shard", "id"])
    more = wanted.withColumn("shard", F.col("shard").cast(entries.schema["shard"].dataType))
    return more.join(found, ["lang", "shard", "id"], "left")


def with_context(words: DataFrame, context: DataFrame | None) -> DataFrame:
    """words with context, null where there is none (or no context at all)."""
    if context is None:
        return words.withColumn("context", F.lit(None).cast("string"))
    return words.join(context, ["book", "ch", "v", "i"], "left")


def senses_crawl(spark: SparkSession, path: str) -> DataFrame:
    """rid, hw (without homograph digits), cons, content (the entry's JSON) from one JSON per entry; senses nest to any depth,
    so they stay JSON for the renderer. Files that begin with an underscore and entries without senses go."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.json").text(path, wholetext=True)
    told = raw.select("value", F.from_json("value", "rid string, headword string, content struct<senses:array<string>>").alias("e"))
    head = hebrew.strip_homograph(F.col("e.headword"))
    rows = told.where(F.size("e.content.senses") > 0)
    return rows.select(F.col("e.rid").alias("rid"), head.alias("hw"), hebrew.consonants(head).alias("cons"), F.get_json_object("value", "$.content").alias("content"))


def both_crawls(words: DataFrame, entries: DataFrame) -> DataFrame:
    """Two crawls as one table (ref, hw, source, ordinal): the first one's entries come before the other's."""
    rows = lambda df, name: df.select("ref", "hw", F.lit(name).alias("source"))
    return rows(words, "words").unionByName(rows(entries, "text"))


def greek_overrides(spark: SparkSession, path: str) -> DataFrame:
    """key, strong, why of curated numbers; a null number says that a lemma has none."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<strong:string,why:string>>")).alias("key", "e"))
    return whole.where(~F.col("key").startswith("_")).select("key", "e.strong", "e.why")


def aliases(spark: SparkSession, path: str, setting: str = "_alias") -> DataFrame:
    """lemma, alias: the aliases that a file of curated values holds under one of its settings."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return whole.where(F.col("key") == setting).select(F.explode(F.from_json("value", "map<string,string>")).alias("lemma", "alias"))


def blocked_pairs(spark: SparkSession, path: str) -> DataFrame:
    """lemma, target of a list whose keys are 'lemma|target'."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("key"))
    parts = F.split("key", "\\|")
    return whole.where(F.size(parts) == 2).select(parts[0].alias("lemma"), parts[1].alias("target"))


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """name, licence, url, revision of the sources, and missing: which of the last three aren't told (null: none)."""
    found = spark.read.schema(writers.DESCRIPTOR).json(path)
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in ("licence", "url", "revision")])
    return found.withColumn("missing", F.nullif(lacking, F.lit("")))
