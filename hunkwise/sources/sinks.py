"""Addresses of outer services, and writing what was planned. Plans are pure; only these calls reach outer services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import percent_encode
from hunkwise.operators.projections import TASK_FIELDS, discussion, note
from hunkwise.operators.publish import INLINE, outcome
from hunkwise.sources import captured
from hunkwise.sources.rest import answers


def request_path(project: Column, mr_iid: Column, part: str = "") -> Column:
    """Of a merge request, or of its /versions, /diffs or /discussions."""
    return F.concat(F.lit("/projects/"), percent_encode(project), F.lit("/merge_requests/"), mr_iid.cast("string"), F.lit(part))


def discussions_path(project: Column, mr_iid: Column) -> Column:
    return request_path(project, mr_iid, "/discussions")


def raw_file_path(project: Column, path: Column, ref: Column) -> Column:
    return F.concat(F.lit("/projects/"), percent_encode(project), F.lit("/repository/files/"), percent_encode(path), F.lit("/raw?ref="), F.url_encode(ref))


def task_path(key: Column) -> Column:
    """Of a task, of which the tracker is asked for the fields that are read and no others."""
    return F.concat(F.lit("/issue/"), key, F.lit("?fields=" + "%2C".join(TASK_FIELDS)))


def form(fields: Column) -> Column:
    """A map as a form body."""
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(F.coalesce(e["value"], F.lit(""))))), "&")


def _form(position: Column | None) -> Column:
    plain = F.create_map(F.lit("body"), F.col("body"))
    return form(plain if position is None else F.when(F.col("publication_mode") == INLINE, position).otherwise(plain))


def posts(plan: DataFrame, project: str, mr_iid: str = "mr_iid", position: Column | None = None) -> DataFrame:
    """(path, body) of a publication plan: a position for inline comments, the text alone for notes."""
    return plan.select(discussions_path(F.lit(project), F.col(mr_iid)).alias("path"), _form(position).alias("body"))


def published(plan: DataFrame, project: str, url: str, mr_url: Column, keys: list[str], mr_iid: str = "mr_iid", position: Column | None = None, **options) -> DataFrame:
    """The plan as it went: publication_mode (failed if its post did), publish_error, and the discussion or the note that came back.

    A discussion has (id, individual_note, notes_count, web_url), a note (id, body, web_url); the other is null, and both are where
    a post failed. keys tell the plan's rows apart. Each evaluation posts: store the result once. See `rest.answers`.
    """
    sent = plan.withColumns({"__path": discussions_path(F.lit(project), F.col(mr_iid)), "__form": _form(position), "__mr_url": mr_url})
    went = answers(sent, url, path="__path", body="__form", key=keys, **options)
    d = F.from_json("answer", captured.DISCUSSION)
    counted = discussion(d["notes"], F.col("__mr_url"))
    ident = F.coalesce(d["id"], F.lit("None"))
    inline = F.struct(ident.alias("id"), F.coalesce(d["individual_note"], F.lit(False)).alias("individual_note"), counted["notes_count"].alias("notes_count"), counted["web_url"].alias("web_url"))
    fine, is_inline = F.col("error_status").isNull(), F.col("publication_mode") == INLINE
    told = went.withColumns({"discussion": F.when(fine & is_inline, inline), "note": F.when(fine & ~is_inline, note(d["id"], d["notes"], F.col("body")))})
    return outcome(told, F.col("error_status"), F.col("error")).drop("__path", "__form", "__mr_url", "status", "answer", "error_status", "error")


def chat_posts(messages: DataFrame) -> DataFrame:
    return messages.select(F.lit("/posts").alias("path"), F.to_json(F.struct("channel_id", "message")).alias("body"))


def write(rows: DataFrame, url: str, headers: str = "{}", **options: str) -> None:
    rows.write.format("paged_rest").mode("append").options(url=url, headers=headers, **options).save()
