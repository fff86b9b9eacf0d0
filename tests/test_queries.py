"""Every registered query of the engine against DuckDB, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from hunkwise import queries
from hunkwise.plans.passages import locate_passages

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(map(whole, r))) for r in plain.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, small, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_passages_in_blocks(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(locate_passages(docs, items).collect())
    assert sorted(locate_passages(docs, items, block=2000).collect()) == whole and len(whole) == 21
    assert locate_passages(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 10, 10_000])
def test_passages_that_share_a_key(spark, block):
    docs = spark.createDataFrame([(1, "first line\nsecond line\nother")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "first line"), (8, "other"), (7, "second line"), (None, "other")], "item_id bigint, text string")
    got = {(r.item_id, r.n_lines, r.first_line, r.outcome) for r in locate_passages(docs, items, block=block).collect()}
    assert got == {(7, 2, 0, "ambiguous"), (8, 1, 2, "unique"), (None, 1, 2, "unique")}


def test_entry(spark):
    assert entry.entry(spark).count() == 21
    assert set(entry.oracle_sql()) <= set(entry.queries())
