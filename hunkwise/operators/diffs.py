"""Unified diffs: their text, their added lines and the lines around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.functions.text import split_lines, text_or

#: Raw lines of context before and after a line.
AROUND = 10


def unified_diff_text(diffs: Column) -> Column:
    """The files of an array (old_path, new_path, diff) as one diff, in order. A missing path is the other one; a null body is empty."""

    def one(d: Column) -> Column:
        old, new = text_or(d["old_path"], text_or(d["new_path"], "unknown")), text_or(d["new_path"], text_or(d["old_path"], "unknown"))
        return F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), new, F.lit("\n--- a/"), old, F.lit("\n+++ b/"), new, F.lit("\n"), F.coalesce(d["diff"], F.lit("")))

    return F.array_join(F.transform(diffs, one), "\n")


def numbered_lines(diffs: DataFrame, keys: list[str], diff: str = "diff", keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Every raw line: keys, keep, raw_index, line, hunk, new_line (null before a hunk or under a header without +N) and added.

    Diffs are dealt out by key while whole, unless they are dealt so already; lines then stay where they are, so that the windows
    need no further exchange. In a hunk, the counter passes over deleted lines and notes; a deleted line that looks like a file header moves it, and an added
    one that does is no added line.
    """
    rows = diffs.select(*keys, *keep, diff)
    rows = (rows if dealt else rows.repartition(*keys)).select(*keys, *keep, F.posexplode(split_lines(F.coalesce(F.col(diff), F.lit("")))).alias("raw_index", "line"))
    line = F.col("line")
    header = line.startswith("@@")
    added = line.startswith("+") & ~line.startswith("+++")
    still = header | (line.startswith("-") & ~line.startswith("---")) | line.startswith("\\")
    start = F.when(header, F.expr(r"try_cast(nullif(regexp_extract(line, '\\+([0-9]+)', 1), '') AS INT)"))
    rows = rows.select("*", header.alias("is_header"), added.alias("added"), F.when(still, 0).otherwise(1).alias("moves"), start.alias("start"))
    rows = rows.withColumn("hunk", F.sum(F.col("is_header").cast("int")).over(Window.partitionBy(*keys).orderBy("raw_index")).cast("int"))
    hunk = Window.partitionBy(*keys, "hunk")
    before = hunk.orderBy("raw_index").rowsBetween(Window.unboundedPreceding, -1)
    first = F.max("start").over(hunk.orderBy("raw_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.when((F.col("hunk") > 0) & ~F.col("is_header"), first + F.coalesce(F.sum("moves").over(before), F.lit(0)))
    return rows.withColumn("new_line", number.cast("int")).drop("is_header", "moves", "start")


def added_lines(diffs: DataFrame, keys: list[str], diff: str = "diff", keep: tuple[str, ...] = ()) -> DataFrame:
    """keys, keep, new_line, text (without its +), raw_index of the added lines."""
    rows = numbered_lines(diffs, keys, diff, keep).filter("added AND new_line IS NOT NULL")
    return rows.select(*keys, *keep, "new_line", F.substring("line", F.lit(2), F.length("line")).alias("text"), "raw_index")


def hunks(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """keys, hunk, first_line, lines, added: what each hunk with a number holds."""
    rows = numbered_lines(diffs, keys, diff).filter("new_line IS NOT NULL")
    return rows.groupBy(*keys, "hunk").agg(F.min("new_line").alias("first_line"), F.count("*").alias("lines"), F.count_if("added").alias("added"))


def lines_before(lines: Column, at: Column) -> Column:
    begin = F.greatest(F.lit(0), at - AROUND)
    return F.slice(lines, begin + 1, at - begin)


def lines_after(lines: Column, at: Column) -> Column:
    return F.slice(lines, at + 2, F.lit(AROUND))


def window_before(lines: Column, at: Column) -> Column:
    """The raw lines before line `at`, joined."""
    return F.array_join(lines_before(lines, at), "\n")


def window_after(lines: Column, at: Column) -> Column:
    return F.array_join(lines_after(lines, at), "\n")
