"""License scan by diagonal voting: rolling word k-gram hashes joined to template positions, votes by offset diagonal.

1. Where the texts lie, every k-gram of words is hashed; those whose hash is in some template (a binary search among
   the templates' few hundred) are kept as (position, hash), one narrow row per document, written once.
2. Spark joins them to the templates' positions (broadcast; the size of the template table is checked) and counts
   votes by (document, template, diagonal), diagonal = position in the text - position in the template.
3. Neighbouring diagonals merge, so a few inserted or missing words don't break a match; a merged span is verified by
   the part of the template's k-grams that it holds and by its length. An exact phrase is one full diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C

#: Words of a k-gram; a template may not be shorter.
K = 3
#: Phrases that count where all their words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that count by diagonal voting: label, words. From the licenses' public texts.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Bytes of words: digits, letters, and all bytes of characters beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Positions in all templates that may be broadcast.
MOST_POSITIONS = 1_000_000


def _grams(texts: list[str], k: int) -> list[np.ndarray]:
    data, offsets = C.utf8(pa.array(texts, pa.string()))
    hashes, firsts, _ = C.words(data, offsets, WORD_BYTES, C.LOWER)
    rolled, at = C.windows(hashes, firsts, k)
    cut = np.searchsorted(at, firsts)
    return [rolled[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def license_votes(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, k: int = K, coverage: float = 0.8, drift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find phrases and license notices in whole texts.

    Returns per row of docs: id_col, n_words, places (array<struct<start,label>>: where a phrase's words stand
    consecutively, by start), spans (array<struct<label,start,end,coverage>>: merged spans that hold at least
    ``coverage`` of a template's k-grams; words from 0, end exclusive). Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

    Defined cases: null or empty text has no words, places or spans; texts shorter than a k-gram have no places; equal
    rows each have their own; a null or repeated id is carried through; an empty table gives an empty table; other
    columns aren't read.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    rows = _template_rows(phrases, templates, k)
    known = np.unique(np.array([r[0] for r in rows], np.int64).view(C.U64))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(id_col, id_type), *T._parse_datatype_string("n_words long, hits array<struct<pos:long,gram:long>>").fields])
    arrow_id, arrow_hits = to_arrow_type(id_type), pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in C.slices(batches, text_col, 1 << 20):
            data, offsets = C.utf8(batch.column(1))
            hashes, firsts, _ = C.words(data, offsets, WORD_BYTES, C.LOWER)
            rolled, at = C.windows(hashes, firsts, k)
            place = np.minimum(np.searchsorted(known, rolled), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[place] == rolled) if len(known) else np.zeros(0, np.int64)
            cut = np.searchsorted(at[hit], firsts)
            pos = at[hit] - np.repeat(firsts[:-1], np.diff(cut))
            hits = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(pos, pa.int64()), pa.array(rolled[hit].view(np.int64))], names=["pos", "gram"]))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0).cast(arrow_id), pa.array(np.diff(firsts), pa.int64()), hits.cast(arrow_hits)], names=schema.names)
            row += n

    scanned = C.written(docs.select(id_col, text_col).mapInArrow(scan, schema), "license-hits")
    positions = spark.createDataFrame(rows, "gram long, template int, label string, exact boolean, t long, n long")
    votes = scanned.select("row", F.inline("hits")).join(F.broadcast(positions) if len(rows) <= MOST_POSITIONS else positions, "gram").withColumn("diagonal", F.col("pos") - F.col("t"))
    places = (
        votes.where("exact").groupBy("row", "template", "label", "n", "diagonal").agg(F.countDistinct("t").alias("votes")).where("votes = n")
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("diagonal").alias("start"), "label"))).alias("places"))
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    spans = (
        votes.where("not exact")
        .withColumn("far", (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > drift).cast("int"))
        .withColumn("island", F.coalesce(F.sum("far").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        .groupBy("row", "template", "label", "n", "island").agg(F.countDistinct("t").alias("held"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
        .withColumn("coverage", F.col("held") / F.col("n"))
        .where((F.col("coverage") >= coverage) & (F.col("end") - F.col("start") <= 1.5 * (F.col("n") + k - 1) + drift))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "start", "end", "coverage"))).alias("spans"))
    )
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return scanned.select("row", id_col, "n_words").join(places, "row", "left").join(spans, "row", "left").select(id_col, "n_words", none("places", "array<struct<start:bigint,label:string>>"), none("spans", "array<struct<label:string,start:bigint,end:bigint,coverage:double>>"))


def _template_rows(phrases: dict[str, str], templates: list[tuple[str, str]], k: int) -> list[tuple]:
    """(gram, template, label, exact, place, number of grams) for each k-gram of each phrase and template."""
    texts = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in templates]
    for _, text, _ in texts:
        if len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())) < k:
            raise ValueError(f"a template has fewer than {k} words: {text!r}")
    return [(int(g), i, label, exact, t, len(grams)) for i, ((label, _, exact), grams) in enumerate(zip(texts, _grams([x[1] for x in texts], k), strict=True)) for t, g in enumerate(grams.view(np.int64))]


def op10_license_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_votes over the whole of documents; score is 1 where a phrase stands, else the best span's coverage, or 0."""
    found = license_votes(C.documents(spark, sf_dir))
    labels = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.transform("places", lambda p: p["label"])).alias("base_labels"),
        labels(F.concat(F.transform("places", lambda p: p["label"]), F.transform("spans", lambda p: p["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda p: p["coverage"])), F.lit(0.0))).alias("score"),
    )
