"""Language ID against the same method written plainly: n-grams as strings, dictionaries, loops over rows."""

import math
import random
import zlib

import pytest

from corpuscle.llm import language_id as L

MASK = (1 << 32) - 1


def grams(text):
    """All n-grams of one to three characters, a run of what isn't a letter being one blank; each has a letter in it."""
    out, run = [" "], True
    for c in text.lower():
        if c.isalpha():
            out.append(c)
            run = False
        elif not run:
            out.append(" ")
            run = True
    if not run:
        out.append(" ")
    found = [c for c in out if c != " "]
    found += [a + b for a, b in zip(out, out[1:], strict=False) if (a + b).strip()]
    return found + [a + b + c for a, b, c in zip(out, out[1:], out[2:], strict=False) if b != " "]


def place(gram):
    """The place of an n-gram in a vector: its characters mixed one after another."""
    code = [0 if c == " " else ord(c) for c in gram]
    h = code[0] * 0x85EBCA6B & MASK
    if len(code) > 1:
        h = ((h ^ h >> 15) * 0xC2B2AE35 + code[1] * 0x85EBCA6B) & MASK
    if len(code) > 2:
        h = ((h ^ h >> 13) * 0x27D4EB2F + code[2] * 0x85EBCA6B) & MASK
    h ^= h >> 16
    return (h * 0x9E3779B1 & MASK) >> 20


def count(text):
    out = {}
    for g in grams(text or ""):
        out[place(g)] = out.get(place(g), 0) + 1
    return out


def unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else v


def dot(a, b):
    return sum(x * b[k] for k, x in a.items() if k in b)


def mean(vectors):
    out = {}
    for v in vectors:
        for k, x in v.items():
            out[k] = out.get(k, 0.0) + x / len(vectors)
    return out


def spherical_means(vectors, k, rounds):
    centres = [mean(vectors)]
    while len(centres) < k:
        centres.append(min(vectors, key=lambda v: max(dot(v, c) for c in centres)))
    for _ in range(rounds):
        centres = [unit(c) for c in centres]
        groups = [[] for _ in centres]
        for v in vectors:
            cosines = [dot(v, c) for c in centres]
            groups[cosines.index(max(cosines))].append(v)
        centres = [mean(g) if g else c for g, c in zip(groups, centres, strict=True)]
    return [unit(c) for c in centres]


def predictions(rows):
    """lang_pred, score, cosine and rejected of (id, text, lang), learned from those with text and language."""
    train = [(i, t, lang) for i, t, lang in rows if t is not None and lang is not None]
    found = [count(t) for _, t, _ in train]
    n = len(train)
    idf = {p: math.log((1 + n) / (1 + sum(p in f for f in found))) + 1 for f in found for p in f}
    vector = lambda c: unit({p: math.log1p(x) * idf.get(p, math.log(1 + n) + 1) for p, x in c.items()})
    letters = lambda t: sum(c.isalpha() for c in t.lower())
    names, centres, least = sorted({lang for *_, lang in train}), {}, {}
    for name in names:
        mine = sorted(((zlib.crc32(t.encode()), t) for _, t, lang in train if lang == name and letters(t)), key=lambda r: r[0])
        halves = [[t for crc, t in mine if crc % 2 == side] for side in (0, 1)]
        whole = [[vector(count(t)) for t in half] for half in halves]
        centres[name] = spherical_means(whole[0] + whole[1], L.CLUSTERS, L.ROUNDS)
        for half, others in ((halves[0], whole[1]), (halves[1], whole[0])):
            fitted = spherical_means(others, L.CLUSTERS, L.ROUNDS) if others else []
            for t in half if others else ():
                for some in [t, *L.passages(t)]:
                    kind = min(max(letters(some), 1).bit_length() - 1, L.LENGTHS - 1)
                    least[kind] = min(least.get(kind, math.inf), max(dot(vector(count(some)), c) for c in fitted))
    limit, floor = {}, math.inf
    for kind in reversed(range(L.LENGTHS)):
        floor = min(floor, least.get(kind, math.inf))
        limit[kind] = L.REJECT * floor if kind in least else 0.0  # nothing is known of such short texts
    out = {}
    for i, t, _ in rows:
        if not letters(t or ""):
            out[i] = ("und", 0.0, 0.0, True)
            continue
        v = vector(count(t))
        cosines = [max(min(1.0, max(0.0, dot(v, c))) for c in centres[name]) for name in names]
        top = max(cosines)
        kind = min(letters(t).bit_length() - 1, L.LENGTHS - 1)
        out[i] = (names[cosines.index(top)], 1 / sum(math.exp((c - top) / L.TEMPERATURE) for c in cosines), top, top < limit[kind])
    return out


def documents():
    rng = random.Random(8)
    sounds = {"aa": ["ba", "ka", "tar", "mos", "li"], "bb": ["xi", "zor", "ek", "quu", "vyl"], "cc": ["été", "où", "neuf", "straß", "ñu"]}
    rows = []
    for i in range(72):
        lang = ["aa", "bb", "cc"][i % 3]
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 2, 5, 12, 30]))]
        rows.append((i, rng.choice([" ", ", ", "\n", " 12 "]).join(words) + rng.choice(["", ".", "!"]), lang))
    odd = [None, "", "12 - 3", "Ω", "𐐀𐐁 ab", "BA ka", "xi", "日本語のテキスト", "bamos ekxi"]
    return [*rows, *[(100 + i, t, None) for i, t in enumerate(odd)], (200, "bakatar", None), (201, None, "bb"), (202, "...", "aa")]


@pytest.mark.parametrize("parts", [1, 5])
def test_predictions_are_those_of_the_plain_method(spark, parts):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    found = {r.doc_id: r for r in L.identify(df, L.fit(df)).collect()}
    expected = predictions(rows)
    assert found.keys() == expected.keys()
    for i, (name, score, cosine, rejected) in expected.items():
        r = found[i]
        assert (r.lang_pred, r.rejected) == (name, rejected), i
        assert (r.score, r.cosine) == pytest.approx((score, cosine), abs=1e-9), i


def test_counts_do_not_depend_on_neighbours():
    texts = [t or "" for _, t, _ in documents()]
    together, letters = L.counts(texts)
    for i, t in enumerate(texts):
        alone, n = L.counts([t])
        assert (alone[0] == together[i]).all() and n[0] == letters[i]
        assert {int(p): int(alone[0][p]) for p in alone[0].nonzero()[0]} == count(t)
