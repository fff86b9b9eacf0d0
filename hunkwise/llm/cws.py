"""Document fingerprints (1): consistent weighted sampling.

A text is a weighted set: its five-word shingles at their counts, where the first four words also stand behind an empty start, so
that every text with a word has a shingle for each. For term x with weight S and sample k, r and c are Gamma(2, 1), b is uniform,
all three fixed by (x, k); then

    t = floor(ln S / r + b),   ln a = ln c - r (t - b) - r,

and sample k is the (x, t) of least a. Two texts agree in a sample with a probability of their generalised Jaccard similarity,
sum of minima over sum of maxima of the weights. The triples come from a pool that a hash of (x, k) indexes. The pool is sorted by
ln a at weight 1, so that terms of weight 1, which most are, compare by that hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.llm import common
from hunkwise.llm.common import mix64

SAMPLES, SHINGLE = 64, 5
_POOL, _CHUNK = 1 << 16, 2048


def _uniform(stream: int, n: int) -> np.ndarray:
    at = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream << 32)
    return ((mix64(at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


class Words(dict):
    """Hashes of words met so far; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Sampler:
    """Signatures of `samples` 16-bit values each."""

    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE):
        self.samples, self.shingle = samples, shingle
        gamma = lambda s: -np.log(_uniform(s, _POOL)) - np.log(_uniform(s + 1, _POOL))
        r, b, ln_c = gamma(1), _uniform(5, _POOL), np.log(gamma(3))
        by = np.argsort(ln_c + r * b - r)
        self.r, self.b, self.ln_c = (x[by].astype(np.float32) for x in (r, b, ln_c))
        self.unit = self.ln_c + self.r * self.b - self.r
        odd = (_uniform(7, 2 * samples) * 2**32).astype(np.uint32) | np.uint32(1)
        self.mul, self.add = odd[:samples, None], odd[samples:, None]
        self.powers = (_uniform(8, shingle) * 2**64).astype(np.uint64) | np.uint64(1)
        self.words = Words()
        self.rows = np.arange(samples)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term hashes and their counts. Words are ASCII-white-space separated, A-Z lower-cased."""
        words = text.encode().lower().split()
        n = self.shingle - 1
        hashes = np.zeros(len(words) + n, np.uint64)
        hashes[n:] = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        runs = sum(hashes[i : i + len(words)] * p for i, p in enumerate(self.powers))
        return np.unique(mix64(runs), return_counts=True)

    def _hash(self, terms: np.ndarray) -> np.ndarray:
        h = terms.astype(np.uint32) * self.mul
        h += self.add
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        return h

    def sign(self, text: str) -> np.ndarray:
        """The signature; that of a text without words is all zero."""
        out = np.zeros(self.samples, np.uint16)
        terms, counts = self.terms(text)
        if not len(terms):
            return out
        best = np.full(self.samples, np.inf, np.float32)
        plain = counts == 1
        for own, weights in ((terms[plain], None), (terms[~plain], counts[~plain])):
            for at in range(0, len(own), _CHUNK):
                x = own[at : at + _CHUNK]
                h = self._hash(x)
                if weights is None:
                    least = h.argmin(axis=1)
                    value = self.unit[h[self.rows, least] >> np.uint32(16)]
                    level = np.zeros(self.samples, np.uint64)
                else:
                    i = (h >> np.uint32(16)).astype(np.int64)
                    r, b = self.r.take(i), self.b.take(i)
                    t = np.floor(np.log(weights[at : at + _CHUNK]).astype(np.float32) / r + b)
                    ln_a = self.ln_c.take(i) - r * (t - b) - r
                    least = ln_a.argmin(axis=1)
                    value, level = ln_a[self.rows, least], t[self.rows, least].astype(np.int64).astype(np.uint64)
                better = value < best
                code = (mix64(x[least] + level * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
                out[better], best[better] = code[better], value[better]
        return out


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints of this module: an estimate of generalised Jaccard similarity."""
    n = F.length(a) / 4
    same = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: (F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4))).cast("int"))
    return F.aggregate(same, F.lit(0), lambda x, y: x + y) / n


def sampler(samples: int = SAMPLES, shingle: int = SHINGLE) -> Sampler:
    """One sampler for a worker process."""
    return common.held(f"sampler {samples} {shingle}", lambda: Sampler(samples, shingle))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """docs with fingerprint: the whole text's signature in hex, 4 digits a sample.

    A null text is an empty one, whose fingerprint is all zero; equal texts have equal fingerprints. A column named fingerprint is
    replaced, others pass; repeated rows are kept; an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("fingerprint", T.StringType())])
    return common.map_columns(docs, schema, [text], lambda own, texts: [[text_of(own.sign(t or "")) for t in texts]], model=(f"sampler {samples} {shingle}", lambda: Sampler(samples, shingle)))


def with_next(docs: DataFrame, blocks: int, id_column: str = "doc_id") -> tuple[DataFrame, int]:
    """Rows dealt to blocks of descending id (nulls last, ties by text), each block followed by the head row of the next.

    Adds __block and __halo (1 for a head row of the next block). Block bounds are approximate quantiles of the ids; heads are one
    id for each block. After the last row comes the first one again.
    """
    spark = docs.sparkSession
    key = -F.col("id")
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted(set(rows.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)] or [1.0], 100 * blocks)).first()[0] or [])) if blocks > 1 else []
    sized = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # Binary search: the number of bounds below the key.
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    search = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(sized, lo + s - 1) < key), lo + s).otherwise(lo))
    rows = rows.withColumn("block", F.coalesce(F.when(key.isNotNull(), search if bounds else F.lit(0)), F.lit(len(bounds))))
    heads = {r.block: r.head for r in rows.groupBy("block").agg(F.max("id").alias("head")).collect()}
    full = sorted(heads)
    before = dict(zip(full, [full[-1], *full[:-1]])) if full else {}
    head = F.get(F.array(*[F.lit(heads.get(b)).cast("bigint") for b in range(len(bounds) + 1)]), F.col("block"))
    prior = F.get(F.array(*[F.lit(before.get(b)).cast("int") for b in range(len(bounds) + 1)]), F.col("block"))
    own = F.struct(F.col("block").alias("__block"), F.lit(0).alias("__halo"))
    send = F.when(F.col("id").eqNullSafe(head), F.array(own, F.struct(prior.alias("__block"), F.lit(1).alias("__halo")))).otherwise(F.array(own))
    out = rows.select("id", "text", F.explode(send).alias("to")).select("to.*", "id", "text")
    out = out.repartitionById(len(bounds) + 1, F.col("__block"))
    return out.sortWithinPartitions("__block", "__halo", F.col("id").desc_nulls_last(), "text"), len(bounds) + 1


_EDITED = common.fields("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES, shingle: int = SHINGLE) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document; see op1_fingerprints.

    Nulls, ties and repeated rows: null texts are empty, null ids come last, equal ids are ordered by text, equal rows follow each
    other. A table of one row is its own next. Other columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    dealt, _ = with_next(docs, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        sign, schema = sampler(samples, shingle).sign, to_arrow_schema(_EDITED)
        rows, last, block, over = [], None, None, False
        for batch in batches:
            for b, halo, key, text in zip(*[c for c in batch.columns], strict=True):
                b, halo, key, text = b.as_py(), halo.as_py(), key.as_py(), text.as_py()
                if b != block:
                    block, last, over = b, None, False
                if halo and over:
                    continue
                print_ = sign(text)
                if last is not None:
                    old_key, old, old_print = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    edited_print = sign(edited)
                    rows.append((old_key, len(old), hashlib.sha256(edited.encode()).hexdigest(), text_of(old_print), text_of(edited_print), float(np.mean(old_print == edited_print)), float(np.mean(old_print == print_))))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                last, over = (key, text, print_), bool(halo)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return common.bounded(dealt).mapInArrow(run, _EDITED)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(common.table(spark, sf_dir, "documents"))


def jaccard(a: str, b: str) -> float:
    """Generalised Jaccard similarity of two texts' weighted terms, for tests."""
    x, y = (dict(zip(*[c.tolist() for c in sampler().terms(t)])) for t in (a, b))
    terms = x.keys() | y.keys()
    most = sum(max(x.get(t, 0), y.get(t, 0)) for t in terms)
    return sum(min(x.get(t, 0), y.get(t, 0)) for t in terms) / most if most else 1.0
