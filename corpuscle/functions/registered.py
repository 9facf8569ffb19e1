"""This package's functions for use in SQL: native ones as SQL functions, alignment as a function and as a table function.

``register`` makes them known to a session. The table function takes the rows of each partition in order, and any columns:

    select * from aligned_words(table(words) partition by (book, chapter) order by (side, place))

A row has one word, or the array of a side's words: a row costs more than the words in it, so whole sides are far faster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpuscle.functions.hebrew import CANTILLATION, MAQAF, PASEQ, POINTS, SOF_PASUQ
from corpuscle.operators import alignment

#: Name, parameter, type and body of the native functions; they are the same as the column functions of that name.
NATIVE = {
    "hebrew_tokens": ("array<string>", "filter(split(text, ' +'), w -> w <> '')"),
    "content_words": ("array<string>", f"filter(transform(split(text, '[ {MAQAF}]+'), w -> replace(replace(w, '{SOF_PASUQ}', ''), '{PASEQ}', '')), w -> w <> '')"),
    "without_cantillation": ("string", f"trim(regexp_replace(regexp_replace(text, '{CANTILLATION}', ''), ' +', ' '))"),
    "hebrew_skeleton": ("string", f"regexp_replace(text, '{POINTS}|[{SOF_PASUQ}{PASEQ}{MAQAF} ]', '')"),
}


@dataclass
class AlignedSchema(AnalyzeResult):
    """What aligned_words returns, and whether a row's word is an array of words."""

    lists: bool = False


class AlignedWords:
    """Rows (side: 0 or 1, word, and the partition's columns) to base_place and other_place, both from 0, -1 for none.

    word is a word, or an array of words that follow each other; a null array has none. A partition is a unit that is aligned as a whole, such as a verse or a chapter. All columns but side, word and place
    are the unit's own and are handed on, as the last row has them.
    """

    OWN = ("side", "word", "place")

    @staticmethod
    def analyze(words: AnalyzeArgument) -> AnalyzeResult:
        if not words.isTable:
            raise ValueError("aligned_words takes a table: aligned_words(table(..) partition by ..)")
        missing = {"side", "word"} - {f.name for f in words.dataType.fields}
        if missing:
            raise ValueError(f"aligned_words needs the columns {', '.join(sorted(missing))}")
        unit = [f for f in words.dataType.fields if f.name not in AlignedWords.OWN]
        places = [T.StructField("base_place", T.IntegerType()), T.StructField("other_place", T.IntegerType())]
        return AlignedSchema(T.StructType([*unit, *places]), lists=isinstance(words.dataType["word"].dataType, T.ArrayType))

    def __init__(self, schema: AlignedSchema) -> None:
        self.lists = schema.lists
        self.sides: tuple[list[str], list[str]] = ([], [])
        self.unit: tuple = ()
        self.last: Any = None

    def eval(self, row: Any) -> None:
        if self.last is None:  # places of the columns, once a unit
            names = list(row.__fields__)
            self.at = names.index("side"), names.index("word")
        self.last = row
        side, word = self.at
        words = self.sides[1 if row[side] else 0]
        if self.lists:
            words.extend(row[word] or ())
        else:
            words.append(row[word])

    def terminate(self) -> Iterator[tuple]:
        base, other = self.sides
        if self.last is not None:
            self.unit = tuple(v for k, v in zip(self.last.__fields__, self.last, strict=True) if k not in self.OWN)
        found = alignment.common_subsequence(base, other)
        alignment.fill_single_gaps(found, base, other)
        for place, partner in enumerate(found):
            yield (*self.unit, place, partner)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (kind, body) in NATIVE.items():
        spark.sql(f"create or replace temporary function {name}(text string) returns {kind} return {body}")
    spark.udf.register("align", alignment._align)
    # not by Arrow: it writes an empty batch for each row that eval takes
    spark.udtf.register("aligned_words", F.udtf(AlignedWords, useArrow=False))
