"""Log files by name, and pages put together."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dated_pattern(stem: str, suffix: str) -> str:
    return rf"^\Q{stem}\E\.[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\Q{suffix}\E$"


def rotated_name(name: Column) -> Column:
    """a.log.2026-01-02 becomes a.2026-01-02.log."""
    return F.regexp_replace(name, r"^(.*)(\.[^.]+)\.([^.]*)$", "$1.$3$2")


def is_dated(name: Column, stem: str, suffix: str) -> Column:
    return name.rlike(dated_pattern(stem, suffix))


def to_delete(files: DataFrame, group: list[str], keep: int, name: str = "name") -> DataFrame:
    """The files of each group but the `keep` last by name; none if keep is 0 or less.

    The newest are found by a partial top-k: Spark keeps `keep` rows of a group in each task before the exchange, so that a large
    group isn't sorted whole. What is left is an anti-join.
    """
    if keep <= 0:
        return files.limit(0)
    newest = files.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(name)))).filter(F.col("__n") <= keep)
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*group, name)]  # a null is a group, too
    return files.alias("f").join(newest.select(*group, name).alias("k"), reduce(and_, same), "left_anti")


def in_page_order(pages: DataFrame, group: list[str]) -> DataFrame:
    """The items of pages (page, items array, next_page) as rows with their place: pages go on up to one that is empty or names no next."""
    ends = F.when((F.size("items") < 1) | F.coalesce(F.col("next_page").cast("string"), F.lit("")).isin("", "0"), F.col("page"))
    last = pages.groupBy(*group).agg(F.min(ends).alias("__last"))
    same = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in group])
    rows = pages.alias("p").join(last.alias("l"), same).filter(F.col("__last").isNull() | (F.col("page") <= F.col("__last")))
    return rows.select(*[F.col(f"p.{c}").alias(c) for c in group], "page", F.posexplode("items").alias("pos", "item"))


def first_version(versions: Column) -> Column:
    """The version that the server lists first; null if there is none, which is an error 404."""
    return F.get(versions, F.lit(0))


