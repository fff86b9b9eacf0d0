"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows that Spark sends to a Python worker at once, where the session has Spark's own 10,000: so many long texts take much memory
#: of the JVM and of the worker, and no operator gains by them.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session sends no more than ARROW_ROWS says."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS[0]) == ARROW_ROWS[1]:
        conf.set(ARROW_ROWS[0], ARROW_ROWS[2])
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if where := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        sc.getCheckpointDir() or sc.setCheckpointDir(where)
        return where
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="hunkwise-"))
    return sc.getCheckpointDir()


_scratch: dict[str, tuple] = {}  # folders made, with what it takes to delete them once the session has stopped


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when `tidied` ends or else the driver does, even after the session's own stop."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(delete_scratch)
    _scratch[path] = (spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration())
    return path


def delete_scratch(paths: list[str] | None = None) -> None:
    """Deletes these scratch folders, or all."""
    for path in list(_scratch) if paths is None else paths:
        where, conf = _scratch.pop(path)
        with suppress(Exception):  # the JVM may be gone, and the folder with it
            where.getFileSystem(conf).delete(where, True)


@contextmanager
def tidied() -> Iterator[None]:
    """Deletes at its end the scratch folders that were made in it: for steps whose result has been written elsewhere."""
    before = set(_scratch)
    try:
        yield
    finally:
        delete_scratch([p for p in _scratch if p not in before])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut and its size is known."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add; names are compared as Spark does, without regard to case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object] = bool) -> object:
    """What a worker process keeps from task to task under a name: one thing, so that workers don't gather all operators' tables."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    """Hands freed memory back to the system, which else stays with the worker process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of text that a worker takes from a batch at once, but for a single longer text.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, columns: list[int], rows: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows and so many bytes of text (in `columns`) at most."""
    sizes = np.ones(batch.num_rows, np.int64)
    for c in columns:
        if pa.types.is_string(batch.column(c).type) or pa.types.is_binary(batch.column(c).type):
            sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right"))
        stop = min(at + rows, max(at + 1, fit))
        yield batch.slice(at, stop - at)
        at = stop


def map_columns(df: DataFrame, schema: T.StructType, inputs: list[str], fn: Callable[..., list], rows: int = 512, keep: list[str] | None = None, model: tuple[str, Callable[[], object]] | None = None) -> DataFrame:
    """Adds or replaces columns in Arrow batches, and keeps the others.

    fn gets the inputs' values as lists, of `rows` rows at most, and returns one list for each field of schema. keep
    names the columns to hand on besides (all, if None). model (name, make) is made once a worker process and given to fn first.
    """
    new = [f.name for f in schema]
    rest = [c for c in df.columns if (keep is None or c in keep) and c.lower() not in {n.lower() for n in new}]
    sent = df.select(*[df[f"`{c}`"] for c in rest], *[df[f"`{c}`"].alias(f"__in{i}") for i, c in enumerate(inputs)])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema]
    n_rest, n_in = len(rest), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [held(*model)] if model else [held("none")][1:]
        for batch in batches:
            for part in slices(batch, list(range(n_rest, n_rest + n_in)), rows):
                out = fn(*first, *[part.column(n_rest + i).to_pylist() for i in range(n_in)])
                arrays = [pa.array(v, type=t) for v, (_, t) in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_rest)] + arrays, names=rest + [n for n, _ in kinds])
        pa.default_memory_pool().release_unused()

    return bounded(sent).mapInArrow(run, T.StructType([df.schema[c] for c in rest] + list(schema)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name += "_"
    return name


def row_key(text: str, *more: str) -> "F.Column":
    """A key of rows that equal rows share: identical rows then get identical results."""
    return F.xxhash64(*[F.col(c) for c in more], F.coalesce(F.col(text), F.lit("")), F.length(F.col(text)))


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(ddl: str) -> T.StructType:
    """A schema of plain types, made without a session, so that modules and executors can have it."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
