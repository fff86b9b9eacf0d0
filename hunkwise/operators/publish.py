"""Where each finding goes: a line, the whole request, a fallback, or nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import text_or
from hunkwise.operators.localize import judged, searchable, with_forms

# Publication modes, and the reason of a finding whose file isn't in the diff.
INLINE, NOTE, FALLBACK, FAILED = "inline", "mr_note", "mr_note_fallback", "failed"
NO_FILE = "file_path was not found in MR diff"


def first_files(files: DataFrame, keys: list[str], pos: str = "file_pos") -> DataFrame:
    """The first file of each new_path of a review, by its place; one row for a path, so that a join stays one to one."""
    rest = [c for c in files.columns if c not in (*keys, pos, "new_path")]
    first = files.filter("new_path IS NOT NULL").groupBy(*keys, "new_path").agg(F.min_by(F.struct(*rest), pos).alias("__file"), F.min(pos).alias(pos))
    return first.select(*keys, "new_path", pos, "__file.*")


def _joined(issues: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    on = [F.col(f"i.{k}") == F.col(f"f.{k}") for k in keys] + [F.when(F.col("i.file_path") != "", F.col("i.file_path")) == F.col("f.new_path")]
    return issues.alias("i").join(first.alias("f"), on, "left").select("i.*", *[f"f.{c}" for c in first.columns if c not in keys])


def with_file(issues: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """issues with new_path, old_path and diff of the first file that has their path; nulls if none, or if the path is null or empty."""
    return _joined(issues, first_files(files, keys).select(*keys, "new_path", "old_path", "diff"), keys)


def old_path_of(new_path: Column, found_old: Column) -> Column:
    return text_or(found_old, new_path)


def note_body(scope: Column, problem_type: Column, severity: Column, confidence: Column, comment: Column, file_path: Column, anchor: Column) -> Column:
    head = F.concat(F.lit("AI review: "), problem_type, F.lit(", severity "), severity.cast("string"), F.lit("/10, confidence "), confidence.cast("string"), F.lit("/10\n\n"))
    file = F.concat(F.lit("File: `"), file_path, F.lit("`\n\n"))
    has_path = F.coalesce(file_path, F.lit("")) != ""
    body = F.when((scope == "file") & has_path, F.concat(head, file, comment))
    return body.when((scope == "line") & has_path, F.concat(head, file, F.lit("Anchor: `"), F.coalesce(anchor, F.lit("None")), F.lit("`\n\n"), comment)).otherwise(F.concat(head, comment))


def publication_plan(issues: DataFrame, files: DataFrame, review: list[str], pos: str = "issue_pos") -> DataFrame:
    """issues with publication_mode, new_line, old_path, body: nothing is written; see sources.sinks for that.

    issues are normal (see issues.normal_scope) and unique by review and pos. A line that can't be found becomes a note whose
    body says why.
    """
    keys = [*review, pos]
    lines = issues.filter("scope = 'line'").select(*keys, "file_path", "anchor_text", "before_anchor", "after_anchor", *[c for c in review if c not in keys])
    first = searchable(first_files(files, review), [*review, "new_path"], keep=("old_path",))
    found = judged(_joined(with_forms(lines), first, review), [*keys, "new_path", F.col("old_path").alias("__old")])
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    out = issues.alias("i").join(found.alias("l"), same, "left").select("i.*", "l.new_path", "l.__old", "l.ok", "l.new_line", "l.reason")
    line = F.col("scope") == "line"
    mode = F.when(~line, NOTE).when(F.col("new_path").isNull() | ~F.coalesce("ok", F.lit(False)), FALLBACK).otherwise(INLINE)
    reason = F.when(mode == FALLBACK, F.when(F.col("new_path").isNull(), NO_FILE).otherwise(F.col("reason")))
    body = note_body(*[F.col(c) for c in ("scope", "problem_type", "severity_score", "confidence_score", "comment", "file_path", "anchor_text")])
    out = out.withColumns({"publication_mode": mode, "fallback_reason": reason, "body": F.concat(body, F.when(reason.isNotNull(), F.concat(F.lit("\n\nPublication fallback: "), reason)).otherwise(""))})
    out = out.withColumn("old_path", F.when(mode == INLINE, old_path_of(F.col("new_path"), F.col("__old"))))
    return out.withColumn("new_line", F.when(mode == INLINE, F.col("new_line"))).drop("__old", "ok", "reason")


def inline_position(body: Column, version: Column, old_path: Column, new_path: Column, new_line: Column) -> Column:
    """The form fields of an inline comment, by the latest version of a request."""
    at = {"position_type": F.lit("text"), "base_sha": version["base_commit_sha"], "start_sha": version["start_commit_sha"], "head_sha": version["head_commit_sha"], "old_path": old_path, "new_path": new_path, "new_line": new_line.cast("string")}
    return F.create_map(F.lit("body"), body, *[x for k, v in at.items() for x in (F.lit(f"position[{k}]"), v)])


def outcome(plan: DataFrame, status: Column, error: Column) -> DataFrame:
    """The plan after writing: a write that failed (a status that is an error) has mode failed, no discussion and the error's text."""
    bad = status.isNotNull()
    return plan.withColumns({"publication_mode": F.when(bad, FAILED).otherwise(F.col("publication_mode")), "publish_error": F.when(bad, error)})
