"""The whole review, as plans: inputs to prompts, responses to a publication plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.operators import issues, publish
from hunkwise.operators.projections import prompt


def prompts(inputs: DataFrame) -> DataFrame:
    """inputs of operators.projections.review_inputs with their prompt."""
    task = {c: F.col(f"task_{c}") for c in ("id", "type", "title", "description")}
    request = {c: F.col(f"mr_{c}") for c in ("title", "description", "diff")}
    return inputs.withColumn("prompt", prompt(F.col("agent_context"), task, request))


def valid_issues(responses: DataFrame, review: list[str], raw: str = "raw_response") -> DataFrame:
    """Normal findings (review, issue_pos, fields) of responses of which every finding is valid."""
    rows = issues.validate(issues.issues_of(responses, review, raw))
    return issues.normal_scope(issues.all_or_nothing(rows, review).drop("reject_reason"))


def plan_review(responses: DataFrame, requests: DataFrame, review: list[str], raw: str = "raw_response") -> DataFrame:
    """Responses (review, raw_response) and requests (review, diffs) to a publication plan."""
    files = requests.select(*review, F.posexplode("diffs").alias("file_pos", "file")).select(*review, "file_pos", "file.*")
    return publish.publication_plan(valid_issues(responses, review, raw), files, review)
