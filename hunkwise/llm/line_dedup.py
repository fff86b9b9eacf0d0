"""Line dedup (7): levelled sorted runs of line hashes.

A batch of documents becomes one run: (key, n) rows, where key is the 128-bit hash of a line's normal form and n the number of the
batch's documents that hold it. Runs are tables bucketed by key and sorted within buckets. Each new batch is merge-anti-joined with
the runs' settled keys (those that already reached min_docs), which need no more counting, and adds only its other keys. When a level
has two runs, they are merged into one run of the next level. All of this goes bucket by bucket, without an exchange of what the
runs hold. The keys of min_docs documents or more lose all their lines.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.llm import common

#: Settled keys up to this number (16 bytes each) are sent to all executors; beyond it they are joined.
BROADCAST_KEYS = 200_000
BATCHES = 4


def line_keys(text: str | None) -> list[bytes]:
    """The normal form of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip().lower() for line in (text or "").encode().split(b"\n")]


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_counts(docs: DataFrame, batches: int = 1, text: str = "text", min_length: int = 1, most: int = 100_000) -> DataFrame:
    """(batch, key, n): documents of a task and batch that hold a line; a task sums up to `most` keys before it hands them on.

    Documents are dealt to batches by their text.
    """

    def run(parts):
        schema = pa.schema([("batch", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])
        counts: dict[tuple[int, bytes], int] = {}
        common.held("none")

        def flush():
            own, which = list(counts), list(counts.values())
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int32()), pa.array([k for _, k in own], pa.binary()), pa.array(which, pa.int64())], schema=schema)

        for part in parts:
            for batch, value in zip(part.column(0).to_pylist(), part.column(1)):
                for key in {k for k in line_keys(value.as_py()) if len(k) >= min_length and len(k.decode(errors="replace")) >= min_length}:
                    d = batch, digest(key)
                    counts[d] = counts.get(d, 0) + 1
                if len(counts) > most:
                    yield flush()
                    counts.clear()
        yield flush()

    return common.bounded(docs.select(F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch"), text)).mapInArrow(run, "batch int, key binary, n bigint")


class LineRuns:
    """The runs, by level. Each is an immutable table in the shared folder, so a lost executor costs only its tasks."""

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: DataFrame | None = None  # a run as well: the keys of min_docs documents or more

    def _written(self, counts: DataFrame) -> DataFrame:
        """counts as a bucketed table at a scratch path; the catalogue needs its name for no longer than it takes to read it."""
        name = f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", common.scratch(self.spark, name)).saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # of an outer path: the files stay
        return run

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, runs).groupBy("key").agg(F.sum("n").alias("n"))  # a union of equal buckets keeps them

    def merged(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return self._merge(runs) if runs else None

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's (key, n), of which a key may have several rows."""
        new = counts.select("key", "n").repartition(self.buckets, "key").groupBy("key").agg(F.sum("n").alias("n"))
        if self.settled is not None:
            # An anti-join, but in a form that isn't pushed below the sums, where the new rows would be dealt out twice.
            new = new.hint("merge").join(self.settled.select("key", F.lit(True).alias("known")), "key", "left").filter("known is null").drop("known")
        self.levels[0].append(self._written(new))
        level = 0
        while len(self.levels[level]) >= 2:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._written(self._merge(old)))
            level += 1
        self.settled = self._written(self.merged().filter(F.col("n") >= self.min_docs))


def _kept(text: str | None, dropped) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    stay = [line for line, key in zip(lines, line_keys(text), strict=True) if digest(key) not in dropped]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All documents, with `text` less every line whose key min_docs documents or more hold; adds n_lines and n_dropped.

    A null text counts as empty: one empty line. Keys shorter than min_length code points never go. A document that loses
    all its lines keeps its row with an empty text. Each row is a document; repeated rows count apart. Columns named n_lines
    or n_dropped are replaced; others pass. An empty table gives an empty result.

    Documents are read twice, to count and to drop. Up to broadcast_keys settled keys are sent to all executors; beyond that
    hashes of rows and lines are joined with them, and texts are shuffled once, to their rows' keys.
    """
    spark = docs.sparkSession
    path = common.scratch(spark, "line-batches")
    line_counts(docs, batches, min_length=min_length).write.partitionBy("batch").parquet(path)
    counts = spark.read.schema("batch int, key binary, n bigint").parquet(path)
    runs = LineRuns(spark, min_docs)
    for i in range(batches):
        runs.add(counts.filter(F.col("batch") == i))
    settled = runs.settled.select("key")
    if settled.count() <= broadcast_keys:
        sent = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in settled.collect()))

        def drop(texts):
            return list(zip(*[_kept(t, sent.value) for t in texts], strict=True)) or [[], [], []]

        return common.map_columns(docs, _OUT, ["text"], drop)
    row, own = common.fresh(docs, "row"), common.fresh(docs, "keys")
    keyed = docs.withColumn(row, common.row_key("text"))

    def keys(texts):
        return [[sorted({digest(k) for k in line_keys(t)}) for t in texts]]

    held = common.map_columns(keyed.select(row, "text"), T.StructType([T.StructField("key", T.ArrayType(T.BinaryType()))]), ["text"], keys, keep=[row])
    held = held.select(row, F.explode("key").alias("key")).join(settled, "key").groupBy(row).agg(F.collect_set("key").alias(own))
    joined = keyed.join(held, row, "left").drop(row)

    def drop_own(texts, own):
        return list(zip(*[_kept(t, frozenset(k or ())) for t, k in zip(texts, own, strict=True)], strict=True)) or [[], [], []]

    return common.map_columns(joined, _OUT, ["text", own], drop_own, keep=docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_length=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], min_docs: int = 10) -> list[tuple[int, int, str]]:
    """The same by counting plainly, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in set(line_keys(t)):
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, line_keys(t), strict=True) if not k or seen[k] < min_docs]
        out.append((len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, g.i AS i, list_extract(parts, g.i) AS line,
         translate(trim(list_extract(parts, g.i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS g(i)
), hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot ON lines.k = hot.k GROUP BY doc_id
"""
