"""Benchmark decontamination by SimHash windows and exact weighted-shingle similarity. DataFrame functions only.

1. Which windows can count. Texts become arrays of 5-word shingle hashes. Those that some item of a size has (one row
   for each hash and size; broadcast if there are at most ``MOST_BROADCAST`` of them, else a shuffled join) are hits of
   that size. Of a text, every window of an item's size that holds enough hits for the wanted similarity is a window in
   question: a condition that any similar window meets, whichever item it is similar to.
2. Fingerprints. A shingle that occurs c times counts as c different elements (the shingle with 0 .. c - 1), so weighted
   shingles are plain sets and no shingle can outvote the rest. Each different window content and each item gets a
   64-bit SimHash of its elements.
3. Candidates. The bits are cut into 6 blocks; the items' blocks are indexed by size with all values within 3 bits.
   Fingerprints within 23 bits agree within 3 bits in some block (6 * 4 - 1 = 23), so the join on (size, block, value)
   finds every window and item within the radius, and nothing else decides which item a window is compared with. At
   similarity 0.8 fingerprints differ in 9.7 bits in the mean; the chance of more than 23 is 1e-5.
4. Candidates are verified by the weighted Jaccard similarity of their shingles, which is that of the sets of elements.

A content that many documents share is fingerprinted, looked up and verified once. Texts aren't shuffled if the
documents in question are few enough to broadcast their ids; beyond that, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import common as C

#: Words of a shingle; blocks of a fingerprint, bits in which an indexed block may differ; the radius that they guarantee.
K, BLOCKS, BLOCK_RADIUS = 5, 6, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: First bit and width of each block.
CUTS = [(64 * b // BLOCKS, 64 * (b + 1) // BLOCKS - 64 * b // BLOCKS) for b in range(BLOCKS)]
#: Rows (shingles of items by size; blocks of the index; ids of documents; verified contents) that may be broadcast.
MOST_BROADCAST = 1_000_000


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; of null none."""
    return F.filter(F.split(C.ascii_lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_shingles(df: DataFrame, text_col: str, k: int = K) -> DataFrame:
    """df without the text, with _n (words) and _sh (hashes of k consecutive words, by place)."""
    rest = [c for c in df.columns if c != text_col]
    hashed = df.select(*rest, F.transform(word_array(F.col(text_col)), lambda w: F.xxhash64(w)).alias("_wh"))
    # _wh is named more than once, so Spark doesn't compute it anew for each element; but a filter on _sh (and explode,
    # which makes one) would be pushed below it and do just that: use explode_outer, and filter on _n
    n = F.size("_wh")
    places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return hashed.select(*rest, n.alias("_n"), F.transform(places, lambda i: F.xxhash64(*[F.get("_wh", i + j) for j in range(k)])).alias("_sh"))


def elements(shingles: Column) -> Column:
    """The elements of a weighted set of shingles: of equal hashes the first, second and so on are told apart."""
    return F.transform(shingles, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(shingles, h)))


def simhash(rows: DataFrame, by: list[str], element: str) -> DataFrame:
    """by, _print: the SimHash of the elements of each group."""
    votes = [F.expr(f"sum(if(getbit({element}, {b}) = 1, 1, -1))").alias(f"_b{b}") for b in range(64)]
    bits = " | ".join(f"shiftleft(if(_b{b} > 0, 1L, 0L), {b})" for b in range(64))
    return rows.groupBy(*by).agg(*votes).select(*by, F.expr(bits).alias("_print"))


def _block(print_col: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(print_col, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def probed_blocks(print_col: Column) -> Column:
    """The blocks of a fingerprint, as array<struct<block, value>>."""
    found = [F.struct(F.lit(b).alias("block"), _block(print_col, *cut).alias("value")) for b, cut in enumerate(CUTS)]
    return F.array(*found)


def indexed_blocks(print_col: Column) -> Column:
    """The blocks of a fingerprint with all values within BLOCK_RADIUS bits, as array<struct<block, value>>."""

    def near(b: int, first: int, width: int) -> Column:
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= BLOCK_RADIUS)
        value = _block(print_col, first, width)
        return F.transform(masks, lambda m: F.struct(F.lit(b).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*[near(b, *cut) for b, cut in enumerate(CUTS)])


def within_radius(windows: DataFrame, items: DataFrame, broadcast: bool) -> DataFrame:
    """Multi-index join of fingerprints: (_content, _ikey, distance) for all with equal _m within RADIUS bits, each once.

    windows: _m, _content, _print. items: _m, _ikey, _iprint.
    """
    index = items.select("_m", "_ikey", "_iprint", F.inline(indexed_blocks(F.col("_iprint"))))
    probes = windows.select("_m", "_content", "_print", F.inline(probed_blocks(F.col("_print"))))
    met = probes.join(F.broadcast(index) if broadcast else index, ["_m", "block", "value"])
    distance = F.bit_count(F.col("_print").bitwiseXOR(F.col("_iprint")))
    near = met.select("_content", "_ikey", distance.alias("distance")).where(F.col("distance") <= RADIUS)
    return near.groupBy("_content", "_ikey").agg(F.first("distance").alias("distance"))


def _starts(similarity: float) -> Column:
    """Of a text of _n words and a size _m, with the places _held of hits (sorted): the starts of windows with enough hits.

    A window of z shingles shares at most its hits with an item of _m - K + 1, so it needs similarity / (1 + similarity)
    of both together. Windows with the hits j .. j + need - 1 begin at held[j + need - 1] - (z - 1) .. held[j]; starts up
    to held[j - 1] have come before. A text shorter than the item is one window.
    """
    z = F.least("_n", "_m") - K + 1
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (z + F.col("_m") - K + 1) - F.lit(1e-9)).cast("int")
    last = F.greatest(F.col("_n") - F.col("_m"), F.lit(0))
    low = lambda j: F.greatest(F.get("_held", j + need - 1) - z + 1, F.coalesce(F.get("_held", j - 1) + 1, F.lit(0)), F.lit(0))
    high = lambda j: F.least(F.get("_held", j), last)
    none = F.array().cast("array<int>")
    some = lambda j: F.when(low(j) <= high(j), F.sequence(low(j), high(j))).otherwise(none)
    return F.when(F.size("_held") >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size("_held") - need), some))).otherwise(none)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    by_text: bool = False,
) -> DataFrame:
    """Item-sized windows of documents that are as similar to the item as ``similarity`` or more.

    Returns one row per document and item: id_col, item_col, start_word, n_words (of the window), distance (of the
    fingerprints), similarity; the best window, of equal ones the first. With by_text also of (the text's hash), and
    texts of one id have rows of their own.

    Defined cases: null or empty texts match nothing, nor do items of fewer than 5 words; items or documents that are
    equal each match for themselves, rows with one id and one text are one document; null ids are carried; with an empty
    table on either side the result is empty; other columns aren't read.
    """
    # ids of any type are carried; texts of one id are told apart by a hash
    docs = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_of"), F.col(text_col).alias("_text"))
    items = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_itext"))
    items = with_shingles(items, "_itext").where(F.col("_n") >= K).withColumn("_ikey", F.xxhash64("_item", "_sh"))
    items = items.dropDuplicates(["_ikey"]).select("_ikey", "_item", F.col("_n").alias("_m"), "_sh")
    items = C.written(items.withColumn("_ie", elements(F.col("_sh"))), "decontaminate-items")

    places = items.select("_m", F.explode("_sh").alias("_h")).distinct()
    places = F.broadcast(places) if places.count() <= MOST_BROADCAST else places
    hits = with_shingles(docs, "_text").select("_id", "_of", "_n", F.posexplode_outer("_sh").alias("_pos", "_h")).join(places, "_h")
    by_size = hits.groupBy("_id", "_of", "_n", "_m").agg(F.sort_array(F.collect_set("_pos")).alias("_held"))
    found = C.written(by_size.select("_id", "_of", "_m", F.explode(_starts(similarity)).alias("_at")), "decontaminate-starts")

    ids = found.select(F.col("_id").alias("_wid"), F.col("_of").alias("_wof")).distinct()
    few = ids.count() <= MOST_BROADCAST
    same = F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_of") == F.col("_wof"))
    asked = with_shingles(docs.join(F.broadcast(ids) if few else ids, same, "left_semi"), "_text").dropDuplicates(["_id", "_of"])
    asked = asked.select(F.col("_id").alias("_wid"), F.col("_of").alias("_wof"), "_sh")
    held = found.join(asked, same).select("_id", "_of", "_m", "_at", F.slice("_sh", F.col("_at") + 1, F.col("_m") - K + 1).alias("_ws"))
    windows = C.written(held.withColumn("_content", F.xxhash64("_m", "_ws")), "decontaminate-windows")

    # what many documents share is looked at once
    contents = windows.groupBy("_m", "_content").agg(F.first("_ws").alias("_ws")).withColumn("_we", elements(F.col("_ws")))
    contents = C.written(contents.drop("_ws"), "decontaminate-contents")
    prints = simhash(contents.select("_m", "_content", F.explode("_we").alias("_e")), ["_m", "_content"], "_e")
    item_prints = simhash(items.select("_m", "_ikey", F.explode("_ie").alias("_e")), ["_m", "_ikey"], "_e").withColumnRenamed("_print", "_iprint")
    per_item = sum(1 for _, width in CUTS for m in range(1 << width) if m.bit_count() <= BLOCK_RADIUS)
    candidates = within_radius(prints, item_prints, broadcast=items.count() * per_item <= MOST_BROADCAST)

    judged = candidates.join(contents.drop("_m"), "_content").join(items.drop("_sh"), "_ikey")
    both = F.size(F.array_intersect("_we", "_ie"))
    judged = judged.withColumn("similarity", both / (F.size("_we") + F.size("_ie") - both)).where(F.col("similarity") >= similarity)
    n_words = (F.size("_we") + K - 1).cast("long").alias("n_words")
    judged = C.written(judged.select("_content", "_item", "_ikey", n_words, "distance", "similarity"), "decontaminate-judged")
    judged = F.broadcast(judged) if judged.count() <= MOST_BROADCAST else judged
    window = F.struct(F.col("_at").cast("long").alias("start_word"), "n_words", "distance", "similarity")
    best = windows.drop("_ws", "_m").join(judged, "_content").groupBy("_id", *["_of"] * by_text, "_item")
    best = best.agg(F.max_by(window, F.struct("similarity", -F.col("_at"))).alias("w"))
    return best.select(F.col("_id").alias(id_col), *[F.col("_of").alias("of")] * by_text, F.col("_item").alias(item_col), "w.*")


def op6_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated over the whole of documents and benchmark."""
    found = contaminated(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 9).alias("similarity"))
