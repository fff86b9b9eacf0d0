"""Benchmark decontamination (2), on DataFrame functions alone.

1. Item-sized windows: a document's window is as many words as an item has. A window that is similar to an item shares a shingle
   with it, so windows are laid for an item where a shared shingle puts it: at its place in the document less its place in the
   item. Documents are found first by an item's heaviest shingles: those that together weigh more than 1 - threshold of it, of
   which a similar window must have one. Only the documents found are read again.
2. Windows and items get SimHash fingerprints of their weighted shingles.
3. A multi-index over the items' fingerprints: eight blocks of eight bits, each listed with all its neighbours within two bits.
   Fingerprints within radius 23 have a block that differs in two bits at most, so none is missed. A window looks up the items
   that it was laid for, so that its candidates are no more than these.
4. Exact weighted-shingle similarity, sum of minima over sum of maxima, decides.

A shingle weighs one more for each halving of the share of items that hold it, so that what many items share says less.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hunkwise.llm import common

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Tables about items, or keys of documents, of up to so many rows are sent to all executors (about 40 bytes each); others are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, ASCII digits and other characters beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-@\[-`{-\x7f]+"), "")


def hashes_of(words: Column, size: int) -> Column:
    """The hash of each run of `size` words."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))


def _sized(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def simhash(df: DataFrame, key: str) -> DataFrame:
    """(key, print) of rows (key, h, weight): a bit is 1 if the hashes that have it weigh over half."""
    sums = [F.sum(F.when(F.getbit("h", F.lit(i)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"s{i}") for i in range(64)]
    bits = F.lit(0).cast("bigint")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"s{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return df.groupBy(key).agg(*sums).select(key, bits.alias("print"))


def _block_keys(print_: Column) -> list[Column]:
    return [F.shiftrightunsigned(print_, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for i in range(BLOCKS)]


def _blocks(print_: str) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), k.alias("key")) for i, k in enumerate(_block_keys(F.col(print_)))])


def index_of(items: DataFrame) -> DataFrame:
    """(item, block, key, item_print) of items (item, print): each item's blocks with all neighbours within BLOCK_RADIUS bits."""
    flips = [sum(1 << b for b in c) for n in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), n)]
    out = items.select("item", F.col("print").alias("item_print"), F.explode(_blocks("print")).alias("b"))
    return out.select("item", "item_print", "b.block", F.explode(F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.col("b.key").bitwiseXOR(f))).alias("key"))


def candidates(prints: DataFrame, laid: DataFrame, index: DataFrame) -> DataFrame:
    """(window, item) of windows laid (window, item) whose print (window, print) is within RADIUS of the item's, by the index."""
    near = laid.join(prints, "window").select("window", "item", "print", F.explode(_blocks("print")).alias("b")).select("window", "item", "print", "b.*")
    near = near.join(index, ["item", "block", "key"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    return near.select("window", "item").distinct()


def heaviest(of_item: DataFrame, threshold: float) -> DataFrame:
    """(h, item, size) of the heaviest shingles of each item in of_item (item, h, size, weight, item_weight), up to 1 - threshold and one more."""
    order = Window.partitionBy("item").orderBy(F.desc("weight"), "h")
    before = F.coalesce(F.sum("item_weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("item_weight").over(Window.partitionBy("item"))
    return of_item.select("h", "item", "size", before.alias("before"), whole.alias("whole")).filter(F.col("before") <= (1 - threshold) * F.col("whole") + 1e-9).select("h", "item", "size")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, start, length, similarity): for each document and item of threshold similarity or more, its best window.

    start and length count words; of equally good windows the first is given. A document that is shorter than an item is one
    window. Items of fewer than `size` words have one shingle, the whole sequence; null and empty items and texts match nothing.
    Rows that share a doc_id are one document, whose rows are looked at apart; a null id is an id. Of items that share an
    item_id any may match. Other columns are left out; an empty table on either side gives an empty result.
    """
    own = items.select("item_id", words_of(F.col("text")).alias("words")).filter("size(words) > 0").distinct()
    own = own.withColumn("length", F.size("words")).withColumn("size", F.least(F.lit(size), "length")).withColumn("item", F.xxhash64("item_id", "words"))
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # `size` values at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start int, length int, similarity double")
    each = lambda words, of: reduce(lambda got, k: F.when(F.col(of) == k, hashes_of(F.col(words), k)).otherwise(got), sizes, F.lit(None).cast("array<bigint>"))
    shingles = common.stored(own.select("item", "item_id", "length", "size", F.posexplode(each("words", "size")).alias("place", "h")), "item-shingles")
    n_items = shingles.agg(F.count_distinct("item")).first()[0]
    weights = _sized(common.stored(shingles.groupBy("h").agg((1 + F.floor(F.log2(n_items / F.count_distinct("item")) + 1e-9)).cast("bigint").alias("weight")), "item-weights"))
    most = int(1 + (n_items.bit_length() - 1))  # of a shingle that no item or one item has
    of_item = shingles.groupBy("item", "item_id", "length", "size", "h").agg(F.count("*").alias("own")).join(weights, "h").withColumn("item_weight", F.col("own") * F.col("weight"))
    of_item = common.stored(of_item, "items")

    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words_of(F.col("text")).alias("words"))
    heavy = _sized(common.stored(heaviest(of_item, threshold), "item-prefixes"))
    found = [texts.select("row", F.explode(hashes_of(F.col("words"), k)).alias("h")).join(heavy.filter(F.col("size") == k), "h").select("row", "item") for k in sizes]
    found = common.stored(reduce(DataFrame.union, found).groupBy("row").agg(F.collect_set("item").alias("items")), "found")
    hit = common.stored(texts.join(_sized(found), "row").withColumn("n", F.size("words")).dropDuplicates(["row"]), "found-texts")

    placed = _sized(shingles.select("h", "item", "length", "size", "place"))
    laid = []
    for k in sizes:
        run = hit.select("row", "n", "items", F.posexplode(hashes_of(F.col("words"), k)).alias("at", "h"))
        run = run.join(placed.filter(F.col("size") == k), "h").filter(F.array_contains("items", F.col("item")))
        laid.append(run.select("row", F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), F.col("n") - F.col("length"))).alias("start"), "length", "size", "item"))
    laid = reduce(DataFrame.union, laid).distinct().withColumn("window", F.xxhash64("row", "start", "length"))
    laid = common.stored(laid, "windows")
    part = hit.join(laid.select("row", "start", "length", "size", "window").distinct(), "row")
    part = part.select("window", "doc_id", "start", "size", F.slice("words", F.col("start") + 1, F.col("length")).alias("part")).filter(F.size("part") >= F.col("size"))
    part = common.stored(part.select("window", "doc_id", "start", F.size("part").alias("n"), each("part", "size").alias("hashes")), "window-hashes")

    weighed = part.select("window", F.explode("hashes").alias("h")).groupBy("window", "h").agg(F.count("*").alias("count"))
    weighed = weighed.join(weights, "h", "left").select("window", "h", "count", F.coalesce("weight", F.lit(most)).alias("one"))
    weighed = common.stored(weighed.withColumn("weight", F.col("count") * F.col("one")), "window-shingles")
    prints = simhash(weighed, "window")
    listed = simhash(of_item.select("item", "h", F.col("item_weight").alias("weight")), "item")
    near = candidates(prints, laid.select("window", "item"), _sized(common.stored(index_of(listed), "item-index")))

    totals = weighed.groupBy("window").agg(F.sum("weight").alias("total"))
    mine = _sized(of_item.select("item", "h", "own"))
    shared = near.join(weighed, "window").join(mine, ["item", "h"]).groupBy("window", "item").agg(F.sum(F.least("count", "own") * F.col("one")).alias("shared"))
    names = of_item.groupBy("item", "item_id").agg(F.sum("item_weight").alias("item_total"))
    judged = shared.join(totals, "window").join(names, "item").withColumn("similarity", F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared")))
    judged = judged.filter(F.col("similarity") >= threshold).join(part.select("window", "doc_id", "start", "n"), "window")
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.before")).alias("start"), F.col("best.n").alias("length"), "best.similarity")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold an item (see contaminated); a document goes with all rows of its id, a null id among them.

    Other columns and repeated rows of clean documents are handed on; an empty table on either side leaves docs as they are.
    """
    bad = common.stored(contaminated(docs, items, threshold).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple], items: list[tuple], threshold: float = THRESHOLD) -> set[tuple]:
    """(doc_id, item_id) by comparing every window of every document with every item, for tests."""
    import math
    import re
    from collections import Counter

    words = lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) if w]
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own = {(i, tuple(words(t))) for i, t in items if words(t)}
    shingled = [(i, w, min(SHINGLE, len(w)), grams(list(w), min(SHINGLE, len(w)))) for i, w in own]
    held = Counter(g for *_, c in shingled for g in c)
    weight = lambda g: 1 + math.floor(math.log2(len(own) / held.get(g, 1)) + 1e-9)
    found = set()
    for d, t in docs:
        w = words(t)
        for i, iw, k, grams_i in shingled:
            n = min(len(iw), len(w))
            for s in range(len(w) - n + 1):
                c = grams(w[s : s + n], k)
                if c.keys() & grams_i.keys():
                    both = c.keys() | grams_i.keys()
                    if sum(min(c[g], grams_i[g]) * weight(g) for g in both) >= threshold * sum(max(c[g], grams_i[g]) * weight(g) for g in both):
                        found.add((d, i))
    return found
