"""The pipeline's stages against brute force, each on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline
from corpuscle.llm import common as C

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark):
    docs, kept = C.documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    before = {r.doc_id: r.text for r in C.documents(spark, SF).collect()}
    assert kept["language_id"] == before  # all of them have letters and are near what was learned

    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for t in before.values() for k in {key(x) for x in t.split("\n")} if k)
    first, expected = {}, {}
    for d, t in sorted(before.items()):
        lines = [x for x in t.split("\n") if not (key(x) and seen[key(x)] >= 10 and first.setdefault(key(x), d) != d)]
        if lines:
            expected[d] = "\n".join(lines)
    assert kept["line_dedup"] == expected

    sets, label = {d: shingles(t) for d, t in expected.items()}, {d: d for d in expected}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = {d: a if x == b else x for d, x in label.items()}
    assert set(kept["near_duplicates"]) == {d for d in expected if label[d] == d}

    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {d for d, t in kept["near_duplicates"].items() if any(i in " ".join(words(t)) for i in items)}
    assert whole and not whole & set(kept["decontaminate"])
    gone = set(kept["near_duplicates"]) - set(kept["decontaminate"])
    assert len(gone) <= 1.2 * len(whole)

    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(kept["decontaminate"]) and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_decide_by_row(spark, tmp_path):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"}
    spark.createDataFrame([(1, text["a"])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = lambda i, c, lang="en": (i, text[c], lang, "s", 1)
    made = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = lambda df: sorted(df.select("doc_id", "text", "lang").collect(), key=str)

    rows = [row(None, "a"), row(None, "b"), row(7, "a"), row(7, "c"), row(8, "d")]
    out = corpus_pipeline.decontaminate(spark, made(rows), str(tmp_path))
    assert plain(out) == sorted([r[:3] for r in (rows[1], rows[3], rows[4])], key=str)

    # null ids alone, null and numbered, repeated rows (one differs in a column), an id with two components, a lone row
    rows = [row(None, "a"), row(None, "a"), row(None, "b"), row(3, "b"), row(4, "c"), row(4, "c"), row(4, "c", "de"), row(5, "d"), row(6, "d"), row(5, "e"), row(9, "e"), row(None, "f")]
    out = corpus_pipeline.near_duplicates(spark, made(rows), str(tmp_path))
    assert plain(out) == sorted([row(None, "a")[:3], row(3, "b")[:3], row(4, "c", "de")[:3], row(5, "d")[:3], row(5, "e")[:3], row(None, "f")[:3]], key=str)

    # a line that only rows without an id have stays in one of them; one id with two texts is two documents
    line = lambda i, x: (i, f"common\nown {x}", "en", "s", 1)
    for ids in ([None] * 12, [5] * 12, [None] * 6 + [2] * 6):
        out = corpus_pipeline.line_dedup(spark, made([line(i, x) for x, i in enumerate(ids)]), str(tmp_path)).collect()
        assert len(out) == 12
        with_line = [r.doc_id for r in out if r.text.startswith("common")]
        assert with_line == [min((i for i in ids if i is not None), default=None)]
    out = corpus_pipeline.line_dedup(spark, made([line(None, 0)] * 12), str(tmp_path)).collect()
    assert len(out) == 12 and {r.text for r in out} == {"common\nown 0"}
