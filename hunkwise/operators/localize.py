"""Where a finding's anchor stands among the added lines of a diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import compact, forms, list_text, matches, normalize, rendered
from hunkwise.operators.diffs import lines_after, lines_before, numbered_lines

# The reasons that a result gives.
NO_PATH = "file_path is required for line localization"
NO_ANCHOR = "anchor_text is required for line localization"
NOT_FOUND = "anchor_text was not found on added lines in MR diff"
UNIQUE = "anchor_text matched uniquely on added line in MR diff"
RESOLVED = "anchor_text was ambiguous, context anchors resolved it"
UNRESOLVED = "anchor_text is ambiguous and context anchors did not resolve it, candidates: "
STILL_AMBIGUOUS = "anchor_text is still ambiguous after context matching, candidates: "


def searchable(files: DataFrame, keys: list[str], keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """files (keys, keep, diff) with __norms and __packs, the two forms of each raw line, and __added, (raw_index, new_line) of added ones.

    Each line is brought to its forms once, however many findings its file has. Those of an added line's text and of a window
    follow from them: no break is part of an escape, nor is the + in front. An empty diff is a blank line here, so that its file stays.
    """
    some = F.coalesce(F.when(F.col("diff") != "", F.col("diff")), F.lit("\n"))
    rows = numbered_lines(files.withColumn("diff", some), keys, keep=keep, dealt=dealt)
    spot = F.when(F.col("added"), F.col("new_line"))
    lines = F.sort_array(F.collect_list(F.struct("raw_index", normalize(F.col("line")).alias("norm"), compact(F.col("line")).alias("packed"), spot.alias("new_line"))))
    out = rows.groupBy(*keys, *keep).agg(lines.alias("__all"))
    added = F.filter("__all", lambda x: x["new_line"].isNotNull())
    return out.select(*keys, *keep, F.col("__all.norm").alias("__norms"), F.col("__all.packed").alias("__packs"), F.transform(added, lambda x: F.struct(x["raw_index"], x["new_line"])).alias("__added"))


def with_forms(rows: DataFrame) -> DataFrame:
    """rows with the forms of their anchors, null or empty ones aside, made ahead of the join with the files, so that no line makes them again."""
    own = lambda c: forms(F.when((F.col(c) != "") & (F.coalesce(F.col("file_path"), F.lit("")) != "") & (F.col("anchor_text") != ""), F.col(c)))
    return rows.withColumns({f"__{c}": own(c) for c in ("anchor_text", "before_anchor", "after_anchor")})


def _near(anchor: str, norms: Column, packs: Column) -> Column:
    """An empty or missing context anchor asks for nothing; a blank one is never found."""
    norm = F.array_join(F.filter(norms, lambda x: x != ""), " ")
    return F.when(F.coalesce(F.col(anchor), F.lit("")) == "", F.lit(True)).otherwise(matches(F.col(f"__{anchor}"), norm, F.array_join(packs, "")))


def asked(rows: DataFrame) -> Column:
    """Whether a finding names an anchor and the file that it is given."""
    path = rows["file_path"]
    return (F.coalesce(path, F.lit("")) != "") & (F.coalesce(rows["anchor_text"], F.lit("")) != "") & path.eqNullSafe(rows["new_path"])


def judged(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns of rows (with_forms, and what searchable gives of their file, or nulls) with ok, new_line, reason."""
    path, anchor, at = F.col("file_path"), F.col("anchor_text"), lambda xs, i: F.get(xs, i)
    text = lambda xs, s: F.substring(at(xs, s["raw_index"]), 2, 2**31 - 1)  # noqa: E731  without its +
    hit = F.filter("__added", lambda s: matches(F.col("__anchor_text"), F.ltrim(text("__norms", s)), text("__packs", s)))
    out = rows.withColumn("__spots", F.when(asked(rows), hit))
    out = out.withColumn("__lines", F.sort_array(F.array_distinct(F.transform("__spots", lambda s: s["new_line"]))))
    norms, packs = F.col("__norms"), F.col("__packs")
    before = lambda s: _near("before_anchor", lines_before(norms, s["raw_index"]), lines_before(packs, s["raw_index"]))
    after = lambda s: _near("after_anchor", lines_after(norms, s["raw_index"]), lines_after(packs, s["raw_index"]))
    stays = F.filter("__spots", lambda s: before(s) & after(s))
    out = out.withColumn("__left", F.when(F.size("__lines") > 1, F.sort_array(F.array_distinct(F.transform(stays, lambda s: s["new_line"])))))
    n, left = F.coalesce(F.size("__lines"), F.lit(0)), F.size("__left")
    reason = F.when(F.coalesce(path, F.lit("")) == "", NO_PATH).when(F.coalesce(anchor, F.lit("")) == "", NO_ANCHOR)
    reason = reason.when(~path.eqNullSafe(F.col("new_path")), F.concat(F.lit("file_path '"), path, F.lit("' does not match diff new_path '"), rendered(F.col("new_path")), F.lit("'")))
    reason = reason.when(n < 1, NOT_FOUND).when(n == 1, UNIQUE).when(left == 1, RESOLVED)
    reason = reason.when(left == 0, F.concat(F.lit(UNRESOLVED), list_text(F.col("__lines")))).otherwise(F.concat(F.lit(STILL_AMBIGUOUS), list_text(F.col("__left"))))
    line = F.when(n == 1, F.get("__lines", F.lit(0))).when((n > 1) & (left == 1), F.get("__left", F.lit(0)))
    return out.select(*columns, line.isNotNull().alias("ok"), line.alias("new_line"), reason.alias("reason"))


def locate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ok, new_line, reason: for (file_path, anchor_text, before_anchor, after_anchor, new_path, diff) per unique keys.

    The anchor is looked for in the added lines; if it stands on several, those stay in whose ten raw lines before and after the
    context anchors are found. A null diff is empty. Findings meet the lines of their diff by its digest, so equal diffs are
    searched as one; those that ask for nothing are spread by their keys.
    """
    digest = F.sha2(F.coalesce(F.col("diff"), F.lit("")).cast("binary"), 256)
    rows_of = with_forms(rows).withColumn("__file", F.when(asked(rows), digest).otherwise(F.xxhash64(*keys).cast("string")))
    files = rows_of.filter(asked(rows)).groupBy("__file").agg(F.first("diff").alias("diff"))
    return judged(rows_of.join(searchable(files, ["__file"], dealt=True), "__file", "left"), rows.columns)
