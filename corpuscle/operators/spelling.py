"""Near spellings: all pairs of words with one initial within an edit distance.

Distances up to NEIGHBOURHOOD, and words that are long (``long_from``), go by keys, without comparing all words of an initial.
A pair within distance d has a common subsequence d letters shorter than the longer word. So of words that are short
enough, the longer one is indexed by what is left when d letters go, and the other by what is left when as many go as
lead to the same length. Of longer words one of d + 1 segments stands unchanged in the other word, moved by d places at
most. Either way a word has a bounded number of keys (``keys_of`` says how many), however long it is; candidates are
words that share a key and the longer word's length, and ``candidates`` counts them without making them.

Of short words at larger distances so few letters are left that most words share keys, by the hundred. These words lie in
blocks of one initial and length; of each two blocks whose lengths are near, a task compares all words with all: first by
one number of 64 bits a word, which tells how many letters aren't shared, then by as many diagonals of the table of
distances as the distance can reach. Each pair is found once, and memory is that of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import broadcast_if_few, kept

#: The largest distance at which short words go by deletions.
NEIGHBOURHOOD = 2
#: Words of a block at about most, pairs that are compared at once, pairs of blocks of a task.
BLOCK, AT_ONCE, A_TASK = 4096, 1 << 18, 16


def long_from(distance: int) -> int:
    """Letters after the initial from which words always go by segments: each has six then."""
    return 6 * (distance + 1)


def _segment_from(distance: int) -> int:
    """Letters after the initial from which segments are used: each has three then."""
    return 3 * (distance + 1)


def keys_of(distance: int) -> int:
    """The most keys that a word has as the longer one and as the shorter one together."""
    short = _segment_from(distance) - 1
    by_deletion = comb(short, distance) + sum(comb(short, k) for k in range(distance + 1))
    by_segment = (distance + 1) * (1 + (distance + 1) * (2 * distance + 1))
    return by_deletion + by_segment


def without(word: Column, k: int) -> Column:
    """array<string>: all that is left of a word when k of its letters go (all of them, if it has fewer), each once."""
    out = F.array(word)
    for _ in range(k):
        one_less = lambda x: F.when(F.length(x) == 0, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))
        out = F.array_distinct(F.flatten(F.transform(out, one_less)))
    return out


def _key(n: Column, place: int, piece: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), F.lit(place).alias("place"), piece.alias("piece"))


def _left_keys(n: Column, rest: Column, k: int) -> Column:
    return F.transform(without(rest, k), lambda x: _key(n, -1, x))


def _bounds(n: Column, part: int, parts: int) -> tuple[Column, Column]:
    """First place (from 1) and length of a segment of a word of n letters."""
    first = F.floor(n * part / parts)
    return (first + 1).cast("int"), (F.floor(n * (part + 1) / parts) - first).cast("int")


def longer_keys(rest: Column, distance: int) -> Column:
    """Keys of a word (without its initial) as the longer one of a pair, or the first of two as long."""
    n, parts = F.length(rest), distance + 1
    segments = [_key(n, p, F.substring(rest, *_bounds(n, p, parts))) for p in range(parts)]
    left = _left_keys(n, F.when(n < _segment_from(distance), rest), distance)
    return F.when(n < _segment_from(distance), left).otherwise(F.array(*segments))


def shorter_keys(rest: Column, distance: int) -> Column:
    """Keys of a word (without its initial) under which any word that is no shorter, and near, has one as well."""
    n, parts, out = F.length(rest), distance + 1, []
    for more in range(distance + 1):
        longer = n + more
        short = longer < _segment_from(distance)
        left = _left_keys(longer, F.when(short, rest), distance - more)
        pieces = []
        for p in range(parts):
            first, length = _bounds(longer, p, parts)
            for move in range(-distance, distance + 1):
                at = first + move
                pieces.append(F.when((at >= 1) & (at + length - 1 <= n), _key(longer, p, F.substring(rest, F.greatest(at, F.lit(1)), length))))
        out.append(F.when(short, left).otherwise(F.array_distinct(F.array_compact(F.array(*pieces)))))
    return F.concat(*out)


def _sides(words: DataFrame, word: str, distance: int) -> tuple[DataFrame, DataFrame]:
    w = words.select(F.col(word).alias("w")).where("w <> ''").distinct()
    initial, rest = F.substring("w", 1, 1).alias("initial"), F.substring("w", 2, 1 << 30)
    return tuple(w.select(F.col("w").alias(name), initial, F.explode(keys(rest, distance)).alias("key")) for name, keys in (("x", longer_keys), ("y", shorter_keys)))


def candidates(words: DataFrame, word: str, distance: int) -> DataFrame:
    """One row: keys, and the candidate pairs (a word with itself and repeats among them) that near_pairs would look at."""
    x, y = _sides(words, word, distance)
    both = x.groupBy("initial", "key").agg(F.count("*").alias("n")).join(y.groupBy("initial", "key").agg(F.count("*").alias("m")), ["initial", "key"])
    return both.agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))


def letters_of(words: list[str]) -> np.ndarray:
    """The letters of words of one length, a row each, without the initial."""
    found = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)[:, 1:]
    most = int(found.max(initial=0))
    return found.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def bags_of(letters: np.ndarray) -> np.ndarray:
    """A number for each row: one bit for each of 32 kinds of letters that it has, another if it has two.

    An edit changes one bit by the letter that comes and one by the letter that goes, at most.
    """
    out = np.zeros(len(letters), np.uint64)
    for column in letters.T:
        bit = np.uint64(1) << (column % 32).astype(np.uint64)
        out |= bit | (out & bit) << np.uint64(32)
    return out


def distances(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Edit distances of the columns of x and y (letters of words, those of x being no longer), too large ones as more than limit.

    Only the diagonals of the table are made that a path of limit edits can reach.
    """
    n, m, far, kind = len(x), len(y), limit + 1, np.int8 if limit < 100 else np.int32
    spare = (limit - (m - n)) // 2
    reach = range(-spare, m - n + spare + 1)
    row = {k: np.full(x.shape[1], k if 0 <= k <= m else far, kind) for k in reach}
    for i in range(1, n + 1):
        last, row = row, {}
        for k in reach:
            j = i + k
            if not 1 <= j <= m:
                row[k] = np.full(x.shape[1], min(i, far) if j == 0 else far, kind)
                continue
            cell = last[k] + (x[i - 1] != y[j - 1]).view(np.int8)
            for beside in (last.get(k + 1), row.get(k - 1)):
                if beside is not None:
                    np.minimum(cell, beside + kind(1), out=cell)
            row[k] = np.minimum(cell, kind(far), out=cell)
    return row[m - n]


def compared(x: list[str], y: list[str], distance: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y, and distances, of all near pairs of two blocks; of a block with itself (same) each pair once.

    Words of a block have one length, x's being no longer than y's.
    """
    (a, b), more = (letters_of(x), letters_of(y)), len(y[0]) - len(x[0])
    of_a, of_b = bags_of(a), bags_of(b)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    step = max(1, AT_ONCE // len(y))
    for at in range(0, len(x), step):
        alike = np.bitwise_count(of_a[at : at + step, None] ^ of_b[None, :]) <= 2 * distance - more
        i, j = np.divmod(np.flatnonzero(alike), len(y))
        i += at
        if same:
            once = i < j
            i, j = i[once], j[once]
        if len(i):
            found = distances(a[:, i], b[:, j], distance)
            near = np.flatnonzero(found <= distance)
            if len(near):
                yield i[near], j[near], found[near]


def _near_of_blocks(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y, same = (batch.column(name)[at] for name in ("x_words", "y_words", "same"))
                for i, j, found in compared(x.as_py(), y.as_py(), distance, same.as_py()):
                    columns = [x.values.take(pa.array(i)), y.values.take(pa.array(j)), pa.array(found, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["x", "y", "distance"])

    return run


def _near_short(w: DataFrame, distance: int) -> DataFrame:
    """x, y, distance: all near pairs of different words, each once, by blocks."""
    w = w.select("w", F.substring("w", 1, 1).alias("initial"), F.length("w").alias("n"))
    parts = w.groupBy("initial", "n").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = w.join(broadcast_if_few(parts), ["initial", "n"]).withColumn("part", F.expr("pmod(xxhash64(w), parts)"))
    blocks = kept(dealt.groupBy("initial", "n", "part").agg(F.collect_list("w").alias("x_words")), "near-blocks")
    others = blocks.toDF("initial", "m", "other", "y_words")
    near = F.col("m").between(F.col("n"), F.col("n") + distance) & ((F.col("m") > F.col("n")) | (F.col("other") >= F.col("part")))
    pairs = blocks.drop("x_words").join(others.drop("y_words"), "initial").where(near).withColumn("same", (F.col("m") == F.col("n")) & (F.col("other") == F.col("part")))
    tasks = max(1, ceil(pairs.count() / A_TASK))
    whole = pairs.join(blocks.hint("merge"), ["initial", "n", "part"]).join(others.hint("merge"), ["initial", "m", "other"])
    return whole.select("x_words", "y_words", "same").repartition(tasks).mapInArrow(_near_of_blocks(distance), "x string, y string, distance int")


def near_pairs(words: DataFrame, word: str, distance: int) -> DataFrame:
    """a, b, distance: all pairs a < b of different words with the same first letter within the edit distance.

    Null and empty words have no partner; repeated words count once.
    """
    by_keys, long = words, F.length(word) > long_from(distance)
    if distance > NEIGHBOURHOOD:
        by_keys = words.where(F.length(word) > long_from(distance) - distance)
    x, y = _sides(by_keys, word, distance)
    if distance > NEIGHBOURHOOD:
        x = x.where(F.length("x") > long_from(distance))
    # not broadcast: Spark guesses the sides' sizes by the words', which have some hundred keys each
    near = x.hint("merge").join(y.hint("merge"), ["initial", "key"]).where("x <> y").withColumn("distance", F.levenshtein("x", "y", distance)).where("distance >= 0")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct()
    if distance <= NEIGHBOURHOOD:
        return near
    short = words.where(~long).select(F.col(word).alias("w")).where("w <> ''").distinct()
    return near.unionByName(_near_short(short, distance).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance"))


def same_words(words: DataFrame, word: str) -> DataFrame:
    """a, b: pairs that may be one word in two spellings: distance 1 where the shorter one has up to 5 letters, else 3."""
    words = kept(words.select(word).distinct(), "spelled-words")
    short = F.least(F.length("a"), F.length("b")) <= 5
    few = near_pairs(words.where(F.length(word) <= 6), word, 1).where(short)
    return few.unionByName(near_pairs(words.where(F.length(word) >= 6), word, 3).where(~short)).select("a", "b")
