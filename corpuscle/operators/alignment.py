"""Sequence alignment of two word arrays: equal arrays natively, the rest by an Arrow function.

align() gives for each word of the base array the place of its partner in the other, or -1. Equal arrays are the
identity and never reach Python. The rest goes by a longest common subsequence (ties advance the base side first) in
linear memory, so whole chapters and books can be aligned at once, and then single gaps are filled where the one word
left over on the other side is spelled nearly alike. Words are compared as numbers; where one side has all of the
other's words in order, one walk in linear time finds what the lattice would, else the lattice is made of what lies
between the equal words at both ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.batches import SLICE

#: Rows of a lattice that are kept when a stretch of it is cut, and rows of a stretch that is walked at once.
CUTS, STRETCH = 16, 64
#: Bits of the masks that a lattice keeps, beside those of words with very many places.
MASK_BITS = 16_000_000


class Lattice:
    """Lengths of longest common subsequences of all suffixes of two word lists, a row as one integer.

    Along a row (one base word's suffixes) lengths fall by 0 or 1 at each place of the other list; bit k of a row is 0
    where they fall at the k-th place from the end. A row follows from the one below by an addition, which carries
    through as many places at once as the machine's words hold.
    """

    def __init__(self, base: list[str], other: list[str]):
        self.base, self.m = base, len(other)
        self.all = (1 << self.m) - 1
        self.places: dict[str, list[int]] = {}
        for k, word in enumerate(reversed(other)):
            self.places.setdefault(word, []).append(k)
        self.common = max(8, self.m // 256)
        self.masks: dict[str, int] = {}
        self.room = MASK_BITS

    def mask(self, word: str) -> int:
        """The places of a word as bits. Words with very many places are kept, and others while there is room: linear memory."""
        found = self.masks.get(word)
        if found is None:
            places = self.places.get(word, ())
            if len(places) < 4:
                return sum(1 << k for k in places)
            bits = bytearray(self.m // 8 + 1)
            for k in places:
                bits[k >> 3] |= 1 << (k & 7)
            found = int.from_bytes(bits, "little")
            if len(places) >= self.common:
                self.masks[word] = found
            elif self.room >= self.m:
                self.masks[word] = found
                self.room -= self.m
        return found

    def above(self, row: int, word: str) -> int:
        hits = self.mask(word)
        return ((row + (row & hits)) | (row & ~hits)) & self.all if hits else row

    def length(self, row: int, j: int) -> int:
        """The length for the suffix of other from place j."""
        low = (1 << (self.m - j)) - 1
        return (~row & low).bit_count()

    def partner(self, word: str, j: int) -> int:
        """The first place from j on that has the word, or -1."""
        hit = self.mask(word) & ((1 << (self.m - j)) - 1)
        return self.m - hit.bit_length() if hit else -1

    def walk(self, lo: int, hi: int, below: int, j: int, out: list[int]) -> int:
        """Partners of base[lo:hi], given row hi and the place reached; returns the place reached then.

        A long stretch is cut: rows at the cuts are kept, rows between are computed again when the walk gets there.
        """
        step = 1 if hi - lo <= STRETCH else -(-(hi - lo) // CUTS)
        kept, row = {hi: below}, below
        for i in range(hi - 1, lo - 1, -1):
            row = self.above(row, self.base[i])
            if (i - lo) % step == 0:
                kept[i] = row
        for i in range(lo, hi, step):
            end = min(i + step, hi)
            if step > 1:
                j = self.walk(i, end, kept[end], j, out)
            elif j < self.m:
                word = self.base[i]
                at = self.partner(word, j)
                # the word here, or further on where leaving this base word out would cost a match
                if at == j or at > j and self.length(kept[i], j) > self.length(kept[end], j):
                    out[i], j = at, at + 1
            kept.pop(i, None)
        return j


def in_order(few: list, many: list, at: int = 0) -> list[int] | None:
    """The first places in many, from at on, where few's words stand one after the other; None where they don't."""
    at, index = at - 1, many.index
    try:
        return [at := index(word, at + 1) for word in few]
    except ValueError:
        return None


def common_subsequence(base: list, other: list) -> list[int]:
    """Partners by a longest common subsequence, -1 where there is none; of several the one that a walk from the start
    finds which takes equal words at once, and else leaves out the base word if no match is lost by it.

    Where one side is contained in the other, such a walk takes each of its words at the first place. So it does with
    the equal words at the end, from where it is through with either side before them.

    Memory is linear: some hundred rows of one bit a word are kept at once, however long the lists are.
    """
    n, m = len(base), len(other)
    out = [-1] * n
    if n <= m and (places := in_order(base, other)) is not None:
        return places
    if m <= n and (places := in_order(other, base)) is not None:
        for j, i in enumerate(places):
            out[i] = j
        return out
    least, head, tail = min(n, m), 0, 0
    while base[head] == other[head]:  # neither side is the other's start, or it would be contained
        head += 1
    while tail < least - head and base[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    lattice = Lattice(base[head : n - tail], other[head : m - tail])
    core = [-1] * len(lattice.base)
    reached = lattice.walk(0, len(core), lattice.all, 0, core)
    out[:head] = range(head)
    out[head : n - tail] = [j + head if j >= 0 else -1 for j in core]
    if reached < lattice.m:
        out[n - tail :] = in_order(base[n - tail :], other, head + reached)
    else:
        past = next((i + 1 for i in range(n - tail - 1, head - 1, -1) if out[i] >= 0), head)
        for j, i in enumerate(in_order(other[m - tail :], base, past)):
            out[i] = m - tail + j
    return out


def edit_distance(a: str, b: str, limit: int) -> int:
    """Unit-cost edit distance, or limit + 1 if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > limit:
            return limit + 1
    return row[-1]


def fill_single_gaps(found: list[int], base: list[str], other: list[str]) -> int:
    """Give lone unmatched words the one free word between their neighbours' partners (or beside one, at an end).

    Works from the left, on what it has filled so far. Returns how many it filled; found is changed.
    """
    taken, filled, last = None, 0, len(found) - 1
    for i, now in enumerate(found):
        if now >= 0:
            continue
        left = found[i - 1] if i else None
        right = found[i + 1] if i < last else None
        free = None
        if left is not None and left >= 0:
            # at the end the text itself closes the gap: two beyond the neighbour when one word is left, else beside it
            closing = len(other) if i == last else right
            if closing >= 0 and closing - left == 2 or i == last and left + 1 < len(other):
                free = left + 1
        elif i == 0:
            closing = len(other) if i == last else right
            free = closing - 1 if closing >= 1 else None
        if free is None:
            continue
        if taken is None:
            taken = {j for j in found if j >= 0}
        if free in taken or not base[i] or not other[free]:
            continue
        limit = max(1, max(len(base[i]), len(other[free])) // 3)
        if edit_distance(base[i], other[free], limit) <= limit:
            found[i] = free
            taken.add(free)
            filled += 1
    return filled


class Spelled:
    """Words that are kept as numbers, -1 for null."""

    def __init__(self, codes: list[int], spellings: list[str | None]):
        self.codes, self.spellings = codes, spellings

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, i: int) -> str | None:
        return self.spellings[self.codes[i]]


def _align_some(base: pa.ListArray, other: pa.ListArray) -> tuple[list[int], np.ndarray]:
    """Partners of all words of some rows, one after the other, and how many words each row has (none for a null one)."""
    ends = [x.offsets.to_numpy() for x in (base, other)]
    words = [x.values.slice(e[0], e[-1] - e[0]) for x, e in zip((base, other), ends, strict=True)]
    coded = pa.concat_arrays(words).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    spellings = [*coded.dictionary.to_pylist(), None]  # the last one is -1's
    sides = [codes[: len(words[0])], codes[len(words[0]) :]]
    (b_ends, o_ends), known = [e - e[0] for e in ends], base.is_valid().to_numpy(zero_copy_only=False) & other.is_valid().to_numpy(zero_copy_only=False)
    out: list[int] = []
    for row in known.nonzero()[0]:
        a, b = sides[0][b_ends[row] : b_ends[row + 1]].tolist(), sides[1][o_ends[row] : o_ends[row + 1]].tolist()
        found = common_subsequence(a, b)
        fill_single_gaps(found, Spelled(a, spellings), Spelled(b, spellings))
        out += found
    return out, np.where(known, np.diff(b_ends), 0)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _align(base: pa.Array, other: pa.Array) -> pa.Array:
    made = []
    for at in range(0, len(base), SLICE):
        b, o = base.slice(at, SLICE), other.slice(at, SLICE)
        found, sizes = _align_some(b, o)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.int32()), mask=pc.or_(b.is_null(), o.is_null())))
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))


def align(base: Column, other: Column) -> Column:
    """array<int>: the partner of each base word in other, -1 where there is none; null if either is null."""
    same = F.when(F.size(base) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(base) - 1))
    return F.when(base == other, same).otherwise(_align(F.when(base != other, base), F.when(base != other, other)))


def align_frame(df: DataFrame, base: str, other: str, out: str = "alignment") -> DataFrame:
    """df with out; of rows whose arrays are equal Python gets nulls only. df is read once."""
    return df.withColumn(out, align(F.col(base), F.col(other)))


def rejected(alignment: Column, other_size: Column, floor: float = 0.4, other_floor: float = 0.8, least: int = 4) -> Column:
    """Whether an alignment is too thin to be used: of 4 base words or more under 40 % matched, and of the other side under 80 %."""
    matched = F.size(F.filter(alignment, lambda j: j >= 0))
    return (F.size(alignment) >= least) & (matched < floor * F.size(alignment)) & ~(matched >= other_floor * other_size)


def by_verse_or_chapter(base: DataFrame, other: DataFrame, keys: tuple[str, str] = ("book", "ch")) -> DataFrame:
    """Word arrays to align: verse by verse where both sides have as many verses in the chapter, else the chapter as a whole.

    Both sides have keys, v, words. Returns keys, v (null for a chapter), base, other, sizes (array<struct<v,n>>: the base
    words of each verse in order, by which a chapter's alignment is cut again).
    """
    whole = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.array_sort(F.collect_list(F.struct("v", "words"))).alias(name))
    both = whole(base, "base").join(whole(other, "other"), list(keys))
    same = F.col("n_base") == F.col("n_other")
    verses = both.where(same).select(*keys, F.inline(F.arrays_zip("base", "other"))).select(*keys, F.col("base.v").alias("v"), F.col("base.words").alias("base"), F.col("other.words").alias("other"), F.array(F.struct(F.col("base.v").alias("v"), F.size("base.words").alias("n"))).alias("sizes"))
    flat = lambda name: F.flatten(F.transform(name, lambda x: x["words"]))
    chapters = both.where(~same).select(*keys, F.lit(None).cast("int").alias("v"), flat("base").alias("base"), flat("other").alias("other"), F.transform("base", lambda x: F.struct(x["v"].alias("v"), F.size(x["words"]).alias("n"))).alias("sizes"))
    return verses.unionByName(chapters)
