"""Shapes that records get on their way: tasks, requests, discussions, prompts, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import rendered, text_or

# The tracker's own fields for a request's address, its reviewers and a task's type.
MR_URL, REVIEWERS, TASK_TYPE = "customfield_10040", "customfield_10039", "customfield_10041"
TASK_FIELDS = ["summary", "description", "status", MR_URL, REVIEWERS, TASK_TYPE]


def reviewers(value: Column) -> Column:
    """Reviewers renamed, in order; none for a null or empty list."""
    one = lambda u: F.struct(F.coalesce(u["accountId"], F.lit("")).alias("account_id"), F.coalesce(u["displayName"], F.lit("")).alias("display_name"), u["emailAddress"].alias("email"), F.coalesce(u["active"], F.lit(False)).alias("active"))
    return F.coalesce(F.transform(value, one), F.transform(F.array().cast("array<struct<accountId:string,displayName:string,emailAddress:string,active:boolean>>"), one))


def task(raw: DataFrame, description: Column, requested: str = "requested_key") -> DataFrame:
    """(id, type, title, description, status, mr_url, reviewers) of raw (requested_key, key, fields); missing texts are empty."""
    f = lambda path: F.coalesce(F.col(f"fields.{path}"), F.lit(""))
    return raw.select(F.coalesce("key", requested).alias("id"), f(f"{TASK_TYPE}.value").alias("type"), f("summary").alias("title"), description.alias("description"), f("status.name").alias("status"), F.col(f"fields.{MR_URL}").alias("mr_url"), reviewers(F.col(f"fields.{REVIEWERS}")).alias("reviewers"))


def task_info(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", "type", "title", "description")


def merge_request(raw: DataFrame, diff: Column) -> DataFrame:
    """A request with its author nested, its files and their diff as one text; missing texts are empty."""
    a = lambda c: F.col(f"author.{c}")
    author = F.struct(a("id").alias("id"), F.coalesce(a("username"), F.lit("")).alias("username"), F.coalesce(a("name"), F.lit("")).alias("name"), a("web_url").alias("web_url"))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description")]
    rest = [F.coalesce(c, F.lit("")).alias(c) for c in ("created_at", "source_branch", "target_branch")]
    return raw.select("id", "iid", *texts, author.alias("author"), *rest, diff.alias("diff"), "diffs")


def merge_request_answer(requests: DataFrame) -> DataFrame:
    """What a caller gets: all but the files."""
    return requests.drop("diffs")


def discussion(notes: Column, mr_url: Column) -> Column:
    """Counts, and the address of the first note, which only a note that belongs to a request has."""
    first = F.get(notes, F.lit(0))
    number = first["noteable_iid"]
    url = F.when(number != 0, F.concat(rendered(mr_url), F.lit("#note_"), rendered(first["id"].cast("string")))).otherwise(number.cast("string"))
    return F.struct(F.greatest(F.lit(0), F.coalesce(F.size(notes), F.lit(0))).alias("notes_count"), url.alias("web_url"))


def note(ident: Column, notes: Column, body: Column) -> Column:
    """A new note: its discussion's id as text, and the first note's body, or the body that was sent if there is none."""
    first = F.get(notes, F.lit(0))
    return F.struct(rendered(ident.cast("string")).alias("id"), F.coalesce(first["body"], body).alias("body"), first["web_url"].alias("web_url"))


def prompt(context: Column, task_: dict[str, Column], request: dict[str, Column]) -> Column:
    """The message for the model; a null is rendered as None."""
    parts = [("PROJECT CONTEXT:\n", context), ("\n\nTASK:\nID: ", task_["id"]), ("\nType: ", task_["type"]), ("\nTitle: ", task_["title"]), ("\nDescription:\n", task_["description"])]
    parts += [("\n\nMERGE REQUEST:\nTitle: ", request["title"]), ("\nDescription:\n", request["description"]), ("\n\nDIFF:\n", request["diff"])]
    return F.concat(*[x for text, value in parts for x in (F.lit(text), rendered(value))], F.lit("\n"))


def review_inputs(requests: DataFrame, tasks: DataFrame, merge_requests: DataFrame, files: DataFrame, context_path: str) -> DataFrame:
    """Requests (issue_key, mr_iid) with their task, their merge request and the context file at its target branch.

    A request of which one is missing has no row; see `missing_inputs`.
    """
    out = requests.join(tasks.withColumnsRenamed({c: f"task_{c}" for c in tasks.columns}), F.col("issue_key") == F.col("task_id"))
    out = out.join(merge_requests.withColumnsRenamed({c: f"mr_{c}" for c in merge_requests.columns if c != "iid"}), F.col("mr_iid") == F.col("iid")).drop("iid")
    context = files.filter(F.col("path") == context_path).select(F.col("ref").alias("__ref"), F.col("content").alias("agent_context"))
    return out.join(context, F.col("mr_target_branch") == F.col("__ref")).drop("__ref")


def missing_inputs(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requests that some input of is missing."""
    return requests.join(found.select("issue_key", "mr_iid").distinct(), ["issue_key", "mr_iid"], "left_anti")


def context_path(asked: Column, default: str = "AGENT.md") -> Column:
    return text_or(asked, default)


def chat_post(post: Column, channel_id: Column, message: Column) -> Column:
    """A chat's answer, with the request's values where it has none; create_at counts milliseconds."""
    return F.struct(F.coalesce(post["id"], F.lit("")).alias("id"), F.coalesce(post["channel_id"], channel_id).alias("channel_id"), F.coalesce(post["message"], message).alias("message"), post["user_id"].alias("user_id"), post["create_at"].alias("create_at"))


def model_check(model: str, message: Column, output: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), F.lit(model).alias("model"), message.alias("input"), output.alias("output"))


def consultation(question: Column) -> Column:
    """The answer of the consultation that isn't there yet: constants and the question."""
    answer = "Codebase consultation endpoint is available, but the real code search implementation is not added yet."
    return F.struct(question.alias("question"), F.lit(answer).alias("answer"), F.array().cast("array<string>").alias("search_queries"), F.array().cast("array<struct<file_path:string,line_start:int,line_end:int,snippet:string,reason:string>>").alias("sources"))


def health() -> Column:
    """Of /health and /ready alike."""
    return F.struct(F.lit("ok").alias("status"))
