"""Language ID by nearest centroids of normalised TF-IDF vectors of character n-grams.

Vectors have one place per hash of an n-gram (one to three letters; a blank stands for a word's edge). Document
frequencies come from all training rows. Each language's vectors, of a bounded sample (``SAMPLE`` rows per language,
the documented bound), are clustered by spherical k-means; a text gets the language of the centroid with the largest
cosine. A text is rejected if it has no letter, or if its largest cosine is below a part (``REJECT``) of the least
own-language cosine of sampled texts of about its length: of passages of each length class that are cut from the
sample, by centroids that were fitted without the passage's text. So a short clean text is held against what short
clean texts reach, and only texts far from everything learned are rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C

#: Places of a vector; sampled rows, clusters and k-means rounds per language; what a rejected cosine is below, as a
#: part of the least in the sample; temperature of the score; length classes (of 1, 2-3, 4-7 .. letters).
DIM, SAMPLE, CLUSTERS, ROUNDS, REJECT, TEMPERATURE, LENGTHS = 4096, 256, 4, 10, 0.5, 0.05, 14
NO_LANGUAGE = "und"
_LETTERS = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x10000)), np.uint8).astype(bool)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x DIM), and each text's letters."""
    folded = [t.lower() for t in texts]
    lens = np.array([len(t) + 1 for t in folded])
    # each text stands between blanks, the last one too, so what is counted of it doesn't depend on its neighbours
    codes = np.frombuffer(" ".join(["", *folded, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.append(np.repeat(np.arange(len(texts)), lens), len(texts) - 1)
    small = codes < 0x10000
    letter = np.where(small, _LETTERS[np.where(small, codes, 0)], False)
    for i in np.flatnonzero(~small):
        letter[i] = chr(codes[i]).isalpha()
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run without letters one stays
    keep[0] = True
    c, owner = np.where(letter, codes, 0)[keep].astype(np.uint32), owner[keep]
    out = np.zeros(len(texts) * DIM, np.float64)
    base = owner * DIM

    def add(grams: np.ndarray, of: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            place = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        np.add(out, np.bincount(of + place, minlength=len(out)), out=out)

    with np.errstate(over="ignore"):
        one = c * np.uint32(0x85EBCA6B)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + one[2:]
    word = c > 0
    add(one[word] ^ (one[word] >> np.uint32(16)), base[word])
    # a blank counts to the text after it; it is always the text's own, as each text starts with one
    ok = word[:-1] & word[1:] | word[1:] & ~word[:-1] | word[:-1] & ~word[1:]
    first = np.where(word[:-1], base[:-1], base[1:])
    add(two[ok] ^ (two[ok] >> np.uint32(16)), first[ok])
    ok = word[1:-1]
    add(three[ok] ^ (three[ok] >> np.uint32(16)), base[1:-1][ok])
    return out.reshape(len(texts), DIM), n_letters


def dense(rows: list[tuple]) -> np.ndarray:
    """Counts (rows x DIM) of rows that end in places and how often each occurs, as bytes."""
    out = np.zeros((len(rows), DIM))
    for x, (*_, places, times) in zip(out, rows, strict=True):
        x[np.frombuffer(places, "<u2")] = np.frombuffer(times, "<u2")
    return out


def length_class(n_letters: np.ndarray) -> np.ndarray:
    """0 for one letter (or none), 1 for up to 3, 2 for up to 7 and so on."""
    return np.minimum(np.frexp(np.maximum(n_letters, 1))[1] - 1, LENGTHS - 1)


def passages(text: str) -> list[str]:
    """From a text's middle on, passages of whole words with 2 ** class letters or more, for each class that it reaches."""
    some, out, n, want = text.split(), [], 0, 0
    some = some[len(some) // 2 :] + some[: len(some) // 2]
    for i, word in enumerate(some):
        n += sum(map(str.isalpha, word))
        if n >= 1 << want:
            out.append(" ".join(some[: i + 1]))
            want = n.bit_length()
    return out


@dataclass
class Model:
    """idf: DIM; centroids: languages x clusters, unit rows; least: by length class the cosine below which a text is rejected."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIM))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, CLUSTERS, DIM)))
    least: np.ndarray = field(default_factory=lambda: np.zeros(LENGTHS))

    def vectors(self, found: np.ndarray) -> np.ndarray:
        v = np.log1p(found) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def cosines(self, v: np.ndarray) -> np.ndarray:
        """texts x languages: the largest over a language's centroids."""
        return np.clip(v @ self.centroids.reshape(-1, DIM).T, 0, 1).reshape(len(v), len(self.languages), -1).max(2)


def clustered(v: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit vectors: spherical k-means from a start that takes the farthest vector each time."""
    start = [v.mean(0)]
    while len(start) < k:
        near = np.max(v @ np.array(start).T, axis=1)
        start.append(v[int(np.argmin(near))])
    c = np.array(start)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        mine = np.argmax(v @ c.T, axis=1)
        c = np.array([v[mine == j].mean(0) if (mine == j).any() else c[j] for j in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def sampled(train: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, text) of at most ``sample`` rows per language: those of least hash in each of 16 parts.

    First the hashes alone tell how far each part goes; then rows up to there are read with their texts, and where equal
    rows make them too many, as many as are wanted.
    """
    order = F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(7))
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), order.alias("_order"), F.pmod(order, F.lit(16)).alias("_salt"), F.col(text_col).alias("_text"))
    first = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy("_order"))).where(F.col("_n") <= max(1, sample // 16))
    upto = first(rows.drop("_text")).groupBy("lang", "_salt").agg(F.max("_order").alias("_upto"))
    return first(rows.join(F.broadcast(upto), ["lang", "_salt"]).where("_order <= _upto")).select("lang", "_text")


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows of train with a language. Reads document frequencies over all of them; sends to the driver
    DIM sums and the n-gram counts of at most ``sample`` rows per language (and of passages of these).

    Defined cases: rows without a text or a language aren't learned from; repeated rows and ids count as rows, but no
    more than ``sample`` of them are sampled; ties of hashes go either way; an empty table gives a model without
    languages; other columns aren't read.
    """
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in C.slices(batches, text_col, 1 << 20, 128):
            found, _ = counts(batch.column(0).to_pylist())
            seen += (found > 0).sum(0)
            n += len(found)
        places = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, DIM), pa.int32()), pa.array(np.append(seen[places], n), pa.int64())], names=["place", "n"])

    summed = train.select(text_col).mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1)
    for place, n in summed:
        df[place] = n
    if not df[DIM]:
        return Model()
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "_text", 1 << 18, 16):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, n = counts([text, *passages(text)])
                if not n[0]:
                    continue
                places = [np.flatnonzero(x) for x in found]
                times = [np.minimum(x[p], 65535) for x, p in zip(found, places, strict=True)]
                rows = [pa.array([x.astype("<u2").tobytes() for x in some], pa.binary()) for some in (places, times)]
                same = pa.array([lang] * len(n), pa.string())
                text_of = pa.array([zlib.crc32(text.encode())] * len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([same, text_of, pa.array(n, pa.int64()), pa.array(np.arange(len(n)) == 0), *rows], names=["lang", "of", "n", "whole", "places", "times"])

    vectors = sampled(train, id_col, text_col, lang_col, sample).mapInArrow(vectorise, "lang string, of long, n long, whole boolean, places binary, times binary")
    by_lang: dict[str, list[tuple]] = {}
    for lang, *row in sorted((tuple(r[:4]) + (bytes(r[4]), bytes(r[5])) for r in vectors.collect())):
        by_lang.setdefault(lang, []).append(row)
    if not by_lang:
        return Model()
    model, least = Model(sorted(by_lang), idf), np.full(LENGTHS, np.inf)
    for lang in model.languages:
        halves = [[r for r in by_lang[lang] if r[0] % 2 == side] for side in (0, 1)]
        whole = [model.vectors(dense([r for r in half if r[2]])) for half in halves]
        model.centroids = np.array([*model.centroids, clustered(np.concatenate(whole))])
        for half, others in zip(halves, reversed(whole), strict=True):  # what each half reaches by the other's centroids
            fitted = clustered(others) if len(others) else others
            for lo in range(0, len(half) if len(others) else 0, 256):
                some = half[lo : lo + 256]
                own = (model.vectors(dense(some)) @ fitted.T).max(1)
                np.minimum.at(least, length_class(np.array([r[1] for r in some])), own)
    # a class is held against no more than any longer one; one without a passage rejects nothing
    model.least = REJECT * np.where(np.isinf(least), 0.0, np.minimum.accumulate(least[::-1])[::-1])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """The columns ``keep`` of docs, and lang_pred (NO_LANGUAGE for texts without a letter, or if nothing was learned),
    score (0 to 1: the share of the language's exponentiated cosine), cosine (the largest), rejected; with keep_text the
    text too.

    Only the text decides. Defined cases: null and empty texts have no letter: NO_LANGUAGE, score 0, rejected; equal
    texts get equal results; ties go to the language first in order; an empty table gives an empty table.
    """
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, *T._parse_datatype_string("lang_pred string, score double, cosine double, rejected boolean").fields])
    kinds = [to_arrow_type(f.dataType) for f in kept]
    if keep_text:
        schema = T.StructType([*schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "_text", 1 << 20, 128):
            texts = batch.column(0).to_pylist()
            found, n_letters = counts([t or "" for t in texts])
            has = n_letters > 0
            if model.languages:
                cosines = model.cosines(model.vectors(found))
                best = cosines.argmax(1)
                top = cosines.max(1)
                score = 1 / np.exp((cosines - top[:, None]) / TEMPERATURE).sum(1)
            else:
                best, top, score, has = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [model.languages[b] if h else NO_LANGUAGE for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i + 1).cast(k) for i, k in enumerate(kinds)), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, top, 0.0)), pa.array(~has | (top < model.least[length_class(n_letters)])), *[batch.column(0).cast(pa.string())] * keep_text],
                names=schema.names,
            )

    return docs.select(F.col(text_col).alias("_text"), *keep).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: a fifth, by its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model from the rows of documents that aren't held out, applied to all."""
    docs = C.documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "cosine", "rejected")
