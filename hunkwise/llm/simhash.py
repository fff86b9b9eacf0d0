"""SimHash near-dedup (3): covering locality-sensitive hashing.

Bit i of a fingerprint gets a non-zero vector m(i) of radius + 1 bits. Table v, for each non-zero v, keeps the bits with odd
parity of m(i) & v. Any `radius` bits span less than the whole space, so some v is orthogonal to all of them: there the bits in
which a pair within the radius differs are all masked out, and the pair meets in that table. No pair within the radius is missed.

Buckets are never expanded into pairs. Equal fingerprints are one class. Classes of a bucket are first linked to its smallest and
largest fingerprint where those are near; a bucket that lies in one component then needs no more. The others are compared in
blocks of bounded size, and a block hands on no more than a spanning forest of its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.llm import common
from hunkwise.llm.common import mix64
from hunkwise.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Classes of a block; a bucket of more is compared block by block.
BLOCK = 16_384
#: Texts, or fingerprints, of a block of near-dedup, where pairs between components are compared.
PAIR_BLOCK = 2_048
#: Pairs between two components of a block that the first round of near-dedup looks at; each round looks at as many times more.
PAIRS, MORE = 4, 16


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of the whole text, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    starts = [0, *[e + 1 for e in ends[:-size]]]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; as a signed number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """docs with simhash (bigint). A null text, or one without words, has fingerprint 0."""
    schema = T.StructType([T.StructField("simhash", T.LongType())])
    return common.map_columns(docs, schema, ["text"], lambda texts: [[fingerprint(shingle_hashes(t, size)) for t in texts]], keep=keep)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of the tables, as signed numbers. Every set of `radius` bits is outside of one of them at least."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The value columns of each run of equal keys (the first `keys` columns) of sorted batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        turn = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:keys]])) + 1
        for a, b in zip([0, *turn[:-1]], turn):
            yield tuple(c[a:b] for c in cols[keys:])
        last = turn[-1] if len(turn) else 0
        held = [c[last:] for c in cols]
    if held is not None:
        yield tuple(held[keys:])


def _distances(prints: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits of signed fingerprints; of a signed number NumPy would count the bits of its absolute value."""
    return np.bitwise_count((prints ^ other).view(np.uint64))


def _forest(fps: np.ndarray, comps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of near fingerprints that join the components of a block; stops once all are one."""
    names, of = np.unique(comps, return_inverse=True)
    links, left = [], len(names)
    for i in range(len(fps)):
        if left == 1:
            break
        hit = (_distances(fps, fps[i]) <= radius) & (of != of[i])
        while hit.any():
            j = int(np.flatnonzero(hit)[0])
            links.append((int(fps[i]), int(fps[j])))
            other = of[j]
            of[of == other] = of[i]
            left -= 1
            hit &= of != of[i]
    return links


def link_components(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(simhash, component) of distinct fingerprints in `classes` that have a near other; component is the smallest simhash reached.

    Spark takes rows of all tables for as large as classes, and would broadcast millions of them from the driver: they are merged.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("simhash").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(covering_masks(radius))])
    rows = classes.select("simhash", F.explode(tables).alias("b")).select("simhash", "b.t", "b.key")
    ends = rows.groupBy("t", "key").agg(F.min("simhash").alias("low"), F.max("simhash").alias("high")).filter("low <> high")
    members = common.stored(rows.hint("merge").join(ends, ["t", "key"]), "buckets")
    stars = [members.filter(near(F.col("simhash"), F.col(c), radius)).select(F.col("simhash").alias("a"), F.col(c).alias("b")) for c in ("low", "high")]
    first = common.stored(connected_components(stars[0].union(stars[1])), "components")
    told = members.select("t", "key", "simhash").join(first, members.simhash == first.node, "left").select("t", "key", "simhash", F.coalesce("component", "simhash").alias("component"))
    mixed = told.groupBy("t", "key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).filter("least <> most")
    parts = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("simhash"), parts).cast("int")
    blocks = told.join(mixed, ["t", "key"]).select("t", "key", "simhash", "component", part.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q"))
    blocks = blocks.select("t", "key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "simhash", "component")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("none")
        for fps, comps in _groups(batches, 4):
            if links := _forest(fps, comps, radius):
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    more = blocks.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", "simhash").mapInArrow(compare, "a bigint, b bigint")
    both = first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    return connected_components(both).withColumnsRenamed({"node": "simhash"})


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, id_column: str = "doc_id") -> DataFrame:
    """(id, simhash, component_id), one row for each row of docs; component_id is the smallest id that links reach.

    Links join fingerprints that differ in `radius` bits at most. Texts without words (null, empty) have fingerprint 0 and are
    linked like others. Null ids are passed over as component_id unless a component has no other; repeated rows are rows of
    one class; other columns are left out; an empty table gives an empty result.
    """
    prints = common.stored(with_fingerprint(docs.select(F.col(id_column).alias("__id"), "text"), size, keep=["__id"]), "simhashes")
    classes = prints.groupBy("simhash").agg(F.min("__id").alias("least"))
    linked = link_components(classes.select("simhash"), radius)
    of = classes.join(linked, "simhash", "left").select("simhash", "least", F.coalesce("component", "simhash").alias("component"))
    first = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = common.stored(of.join(first, "component").select("simhash", "component_id"), "classes")
    return prints.join(named, "simhash").select(F.col("__id").alias(id_column), "simhash", "component_id")


def word_prints(text: str | None, seeds: int) -> list[int]:
    """A text's fingerprints over its distinct words, one for each seed; 0 for a text without words."""
    words = np.unique(shingle_hashes(text, 1))
    return [fingerprint(mix64(words + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))) if len(words) else 0 for s in range(seeds)]


def leader_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within buckets of rows (bucket, node, print) sorted by bucket: b leads a.

    A print that is within the radius of no earlier leader of its bucket leads from there on; any other is linked to the first
    such leader. Each round settles one leader in all buckets of a batch at once; only the last bucket's leaders are held.
    """
    common.held("none")
    last, leaders = None, []
    for batch in batches:
        bucket, node, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(bucket):
            continue
        if bucket[0] != last:
            leaders = []
        a, b, left, last = [], [], np.arange(len(bucket)), bucket[-1]
        head = int(np.searchsorted(bucket != bucket[0], True)) if leaders else 0
        for who, led in leaders:
            near = (left < head) & (_distances(prints[left], led) <= radius)
            a.append(node[left[near]])
            b.append(np.full(int(near.sum()), who))
            left = left[~near]
        if bucket[0] != last:
            leaders = []
        while len(left):
            starts = np.flatnonzero(np.append(True, bucket[left[1:]] != bucket[left[:-1]]))
            lead = np.repeat(left[starts], np.diff(np.append(starts, len(left))))
            if bucket[left[starts[-1]]] == last:
                leaders.append((node[left[starts[-1]]], prints[left[starts[-1]]]))
            near = _distances(prints[left], prints[lead]) <= radius
            pairs = near & (left != lead)
            a.append(node[left[pairs]])
            b.append(node[lead[pairs]])
            left = left[~near]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """A stored table of keys, to be broadcast if it has no more than limit rows."""
    return F.broadcast(df) if df.count() <= limit else df


def similar_links(links: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) of texts (node, shingles) whose shingle sets have a Jaccard similarity of the threshold or more."""
    a, b = (texts.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("none")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return links.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(judge, "a bigint, b bigint")


def print_buckets(prints: DataFrame, seeds: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of nodes in prints (node, p0, p1, ...): (node, seed, print), the classes of equal prints, and the buckets that classes share.

    A class (seed, print, low, high) has its least and greatest node; a bucket (bucket, t, node, seed, print) of covering table t
    has a row a class, that of its least node. Buckets of one class are left out.
    """
    each = prints.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.col(f"p{i}").alias("print")) for i in range(seeds)])).alias("x")).select("node", "x.seed", "x.print")
    classes = common.stored(each.groupBy("seed", "print").agg(F.min("node").alias("low"), F.max("node").alias("high")), "classes")
    keys = F.array(*[F.xxhash64(F.col("seed"), F.lit(k), F.col("print").bitwiseAND(F.lit(m))) for k, m in enumerate(covering_masks(radius))])
    tables = classes.select(F.posexplode(keys).alias("t", "bucket"), F.col("low").alias("node"), "seed", "print")
    met = tables.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1").drop("n")
    return each, classes, common.stored(met, "buckets")


def candidate_links(each: DataFrame, classes: DataFrame, buckets: DataFrame, radius: int) -> DataFrame:
    """First links (a, b): nodes of one print to the least and the greatest of them, classes of a bucket to the first leader within the radius."""
    inside = each.join(classes.filter("low <> high"), ["seed", "print"])
    same = inside.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    tables = buckets.select("bucket", "node", "print").repartition("bucket").sortWithinPartitions("bucket", "node")
    met = tables.mapInArrow(lambda batches: leader_links(batches, radius), "a bigint, b bigint")
    return same.union(met).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _blocks(rows: DataFrame, key: str, n: str, block: int) -> DataFrame:
    """rows with (p, q) in which each pair of a bucket's rows meets: buckets of n rows are dealt to blocks of `block` rows by a key."""
    parts = F.ceil(F.col(n) / block).cast("int")
    part = F.pmod(F.xxhash64(key), parts).cast("int")
    out = rows.select("*", part.alias("p0"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q0"))
    return out.withColumns({"p": F.least("p0", "q0"), "q": F.greatest("p0", "q0")}).drop("p0", "q0", n)


def first_tables(differ: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The first table in which pairs that differ in these bits meet; the number of tables, if in none."""
    out = np.full(len(differ), len(masks))
    for k in range(len(masks) - 1, -1, -1):
        out[(differ & masks[k]) == 0] = k
    return out


def active_classes(rows: DataFrame, radius: int, block: int = PAIR_BLOCK) -> DataFrame:
    """(bucket, seed, print) of the classes in rows (bucket, t, seed, print, least, most, classes) that some near class of another component meets.

    least and most are the least and greatest component of a class. A pair of classes counts in the first of its tables alone.
    """
    masks = np.array(covering_masks(radius), np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("none")
        for tables, seeds, prints, least, most in _groups(batches, 3):
            hit = np.zeros(len(prints), bool)
            for i in range(len(prints) - 1):
                j = np.flatnonzero((_distances(prints[i + 1 :], prints[i]) <= radius) & ((least[i + 1 :] != least[i]) | (most[i + 1 :] != least[i]) | (most[i] != least[i]))) + i + 1
                if len(j) and len(j := j[first_tables(prints[j] ^ prints[i], masks) == tables[0]]):
                    hit[i] = hit[j] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hit.sum()), tables[0])), pa.array(seeds[hit]), pa.array(prints[hit])], names=["t", "seed", "print"])

    dealt = _blocks(rows, "print", "classes", block).select("bucket", "p", "q", F.col("t").cast("bigint"), F.col("seed").cast("bigint"), "print", "least", "most")
    found = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "print").mapInArrow(find, "t bigint, seed bigint, print bigint").distinct()
    table = F.get(F.array(*[F.lit(m) for m in covering_masks(radius)]), F.col("t").cast("int"))
    return found.select(F.xxhash64(F.col("seed").cast("int"), F.col("t").cast("int"), F.col("print").bitwiseAND(table)).alias("bucket"), F.col("seed").cast("int").alias("seed"), "print")


def mixed_buckets(each: DataFrame, classes: DataFrame, buckets: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    """(bucket, node, print, was, n) of the nodes of classes that hold, or meet, near nodes of other components; n is a bucket's size.

    Classes are compared first, so that only those come with their nodes that have something to compare.
    """
    mine = common.stored(each.join(known, "node", "left").select("node", "seed", "print", F.coalesce("component", "node").alias("was")), "members")
    sums = common.stored(mine.groupBy("seed", "print").agg(F.min("was").alias("least"), F.max("was").alias("most"), F.count("*").alias("n")), "class-components")
    rows = buckets.drop("node").join(sums.drop("n"), ["seed", "print"])
    several = rows.groupBy("bucket").agg(F.min("least").alias("c0"), F.max("most").alias("c1"), F.count("*").alias("classes"), F.min("print").alias("low"), F.max("print").alias("high"))
    several = several.filter("c0 <> c1").filter((F.col("classes") > 2) | near(F.col("low"), F.col("high"), radius)).select("bucket", "classes")
    met = active_classes(rows.join(several, "bucket"), radius)
    own = sums.filter("least <> most").select(F.xxhash64("seed", F.lit(-1), "print").alias("bucket"), "seed", "print")
    active = common.stored(met.union(own).join(sums.select("seed", "print", "n"), ["seed", "print"]), "active")
    sizes = active.groupBy("bucket").agg(F.sum("n").alias("n"))
    return active.drop("n").join(sizes, "bucket").join(mine, ["seed", "print"]).select("bucket", "node", "print", "was", "n")


def parity(shingles: np.ndarray) -> bytes:
    """1,024 bits: of how many shingles, odd or even, each remainder is. Those of two sets differ in no more bits than the sets in shingles."""
    return np.packbits((np.bincount(shingles % 1024, minlength=1024) & 1).astype(np.uint8)).tobytes()


def sketches(texts: DataFrame) -> DataFrame:
    """(node, size, odd) of texts (node, shingles): the number of shingles and their parity."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("none")
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(parity, sets), pa.binary())], names=["node", "size", "odd"])

    return texts.select("node", "shingles").mapInArrow(sketch, "node bigint, size bigint, odd binary")


def cross_links(rows: DataFrame, radius: int, threshold: float, begin: int, end: int, block: int = PAIR_BLOCK) -> DataFrame:
    """Links (a, b) between components within the buckets of rows, of prints within the radius, that may have the threshold's similarity.

    rows: (bucket, node, print, was, component, n, size, odd). Buckets are compared in blocks of bounded size. Of the pairs between
    the same two components at first (was), in order of likeness, those from place `begin` up to `end` are given, unless they are
    in one component by now; a row (0, 0) says that there are pairs beyond. Only pairs that cannot have the similarity, by the sizes
    of their shingle sets or by a lower bound of their difference, are passed over.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("none")
        for nodes, prints, was, comps, sizes, odd in _groups(batches, 3):
            if (comps == comps[0]).all():
                continue
            bits, found = np.frombuffer(b"".join(odd), np.uint64).reshape(len(nodes), -1), []
            for i in range(len(nodes) - 1):
                j = np.flatnonzero((was[i + 1 :] != was[i]) & (_distances(prints[i + 1 :], prints[i]) <= radius)) + i + 1
                j = j[np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i]) - 1e-6]
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                may = (1 + threshold) * apart <= (1 - threshold) * (sizes[j] + sizes[i]) + 1e-6
                if may.any():
                    j, apart = j[may], apart[may]
                    found.append((np.full(len(j), i), j, apart / np.maximum(1, sizes[j] + sizes[i])))
            if not found:
                continue
            i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
            low, high = np.minimum(was[i], was[j]), np.maximum(was[i], was[j])
            order = np.lexsort((nodes[j], nodes[i], far, high, low))
            new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
            place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            left = comps[i[order]] != comps[j[order]]
            pick = order[left & (place >= begin) & (place < end)]
            a, b = np.maximum(nodes[i[pick]], nodes[j[pick]]), np.minimum(nodes[i[pick]], nodes[j[pick]])
            if (left & (place >= end)).any():
                a, b = np.append(a, 0), np.append(b, 0)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = _blocks(rows, "node", "n", block).select("bucket", "p", "q", "node", "print", "was", "component", "size", "odd")
    return dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "node").mapInArrow(compare, "a bigint, b bigint").distinct()


def across_components(met: DataFrame, groups: DataFrame, mixed: DataFrame, texts: DataFrame, radius: int, threshold: float, block: int = PAIR_BLOCK) -> DataFrame:
    """(node, component) by the links met (a, b), of which groups are the components, and all similar pairs in mixed buckets.

    Rounds look at the likeliest pairs of two components first and at more each time, so that components that are linked by one
    pair hand on no others; the last round leaves no pair between components.
    """
    rows = common.stored(mixed.join(sketches(texts), "node"), "mixed")
    begin, end = 0, PAIRS
    while True:
        now = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "was"))
        found = common.stored(cross_links(now, radius, threshold, begin, end, block), "cross-links")
        similar = common.stored(similar_links(found.filter("a <> b"), texts, threshold), "links")
        if not similar.isEmpty():
            met = met.union(similar)
            groups = common.stored(connected_components(met), "components")
        if found.filter("a = b").isEmpty():
            return groups
        begin, end = end, end * MORE


def _any_kind(df: DataFrame, column: str) -> Column:
    """A column to be hashed: as it is, or as text where its type cannot be hashed."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{column}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{column}`")


def deduplicate(docs: DataFrame, radius: int = 3, seeds: int = 8, size: int = 5, threshold: float = 0.8, id_column: str = "doc_id", broadcast_rows: int = 1_000_000, block: int = PAIR_BLOCK) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id (nulls last), then of the smallest row hash.

    Near copies differ in a few words, which touch five shingles each, so candidates come from fingerprints over distinct words,
    which such edits move little: texts meet in a covering table if any of `seeds` independent fingerprints differs in `radius`
    bits at most. A link needs the similarity of their word shingles, compared as sets of 32-bit hashes. A text's link to the
    least candidate is verified first, then other links to leaders that span two components, then all pairs of texts in buckets
    that still hold several: no two groups are left with a pair that meets and is similar. Shingles are made of such texts only.
    Up to `broadcast_rows` keys, linked and dropped rows are found by a broadcast join, beyond that by a shuffled one. Texts
    without words are copies of each other, nulls among them; of equal rows one stays; further columns of any type are handed on;
    an empty table gives an empty result.
    """
    whole = F.xxhash64(*[_any_kind(docs, c) for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns])
    rows = common.drop_clashes(docs, ["__row"]).withColumn("__row", whole)
    sent = rows.select(F.col(id_column).alias("__id"), "__row", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    schema = T.StructType([T.StructField(f"p{i}", T.LongType()) for i in range(seeds)])
    sketch = lambda texts: list(zip(*[word_prints(t, seeds) for t in texts], strict=True)) or [[]] * seeds
    prints = common.stored(common.map_columns(sent, schema, ["text"], sketch, keep=["__id", "__row", "node"]), "prints")
    head = F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__row")).alias("head")
    nodes = common.stored(prints.groupBy("node").agg(*[F.min(f"p{i}").alias(f"p{i}") for i in range(seeds)], head), "nodes")
    each, classes, buckets = print_buckets(nodes, seeds, radius)
    links = common.stored(candidate_links(each, classes, buckets, radius), "candidates")
    of = T.StructType([T.StructField("shingles", T.BinaryType())])
    packed = lambda texts: [[np.unique(shingle_hashes(t, size).astype("<u4")).tobytes() for t in texts]]

    def with_shingles(some: DataFrame) -> DataFrame:
        needed = common.stored(nodes.join(some.select("node").distinct(), "node", "left_semi").select("head.__row"), "needed")
        found = sent.select("__row", "node", "text").join(_sized(needed, broadcast_rows), "__row", "left_semi")
        return common.stored(common.map_columns(found, of, ["text"], packed, keep=["node"]).dropDuplicates(["node"]), "texts")

    texts = with_shingles(links.select(F.explode(F.array("a", "b")).alias("node")))
    least = links.groupBy("a").agg(F.min("b").alias("b"))
    first = common.stored(similar_links(least, texts, threshold), "links")
    known = common.stored(connected_components(first), "components")
    mine, theirs = (known.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    apart = links.join(least, ["a", "b"], "left_anti").join(mine, "a", "left").join(theirs, "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    more = common.stored(similar_links(apart, texts, threshold), "links")
    met = first.union(more)
    known = known if more.isEmpty() else common.stored(connected_components(met), "components")
    mixed = common.stored(mixed_buckets(each, classes, buckets, known, radius), "mixed-nodes")
    groups = across_components(met, known, mixed, with_shingles(mixed), radius, threshold, block).withColumnRenamed("component", "group")
    named = nodes.select("node", "head").join(groups, "node", "left").groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("head").alias("head"))
    kept = common.stored(named.select(F.col("head.__row").alias("__row")).distinct(), "heads")
    dropped = common.stored(prints.select("__row").join(kept, "__row", "left_anti"), "dropped")
    out = rows.join(_sized(dropped, broadcast_rows), "__row", "left_anti")
    if prints.count() - dropped.count() > kept.count():  # some row is there twice
        out = out.dropDuplicates(["__row"])
    return out.drop("__row")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(texts: list[str | None], radius: int = RADIUS) -> list[tuple[str, int]]:
    """Fingerprints bit by bit, and components by comparing all pairs; for tests. Ids are positions."""
    prints = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [(f"{p:016x}", g) for p, g in zip(prints, group, strict=True)]
