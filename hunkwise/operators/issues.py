"""Findings as a model returns them: parsing, validation and normal scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.functions.text import SPACES

# The closed sets of a finding, and its fields.
SCOPES = ["line", "file", "mr"]
PROBLEM_TYPES = ["bug", "regression", "task_mismatch", "security", "performance", "reliability", "compatibility", "maintainability", "other"]
SCORES = ["severity_score", "confidence_score"]
OPTIONAL = ["file_path", "anchor_text", "before_anchor", "after_anchor"]
MODEL_OUTPUT_LIMIT = 5000


def parse_response(raw: Column) -> Column:
    """The JSON of a response as a variant; null if it is none."""
    return F.try_parse_json(raw)


def _kind(issue: Column, field: str) -> Column:
    """The type of a field: null if it is missing, VOID if it is null."""
    return F.schema_of_variant(F.try_variant_get(issue, f"$.{field}", "variant"))


def whole_number(issue: Column, field: str) -> Column:
    """A field as a number by lax rules: 8, 8.0, "8", "8.0", " 8 ", "1_0" (10) and true (1) pass, all else is null."""
    kind = _kind(issue, field)
    text = F.try_variant_get(issue, f"$.{field}", "string")
    number = F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
    plain = F.regexp_replace(text, rf"^{SPACES}+|{SPACES}+$", "")
    digits = F.replace(F.regexp_extract(plain, r"^([+-]?[0-9]+(?:_[0-9]+)*)(\.0+)?$", 1), F.lit("_"), F.lit(""))
    real = F.try_variant_get(issue, f"$.{field}", "double")
    number = number.when(kind == "STRING", F.when(digits != "", digits.try_cast("int")))
    return number.when(kind.isNotNull() & (kind != "VOID"), F.when(real == F.floor(real), real.try_cast("int")))


def _text(issue: Column, field: str) -> Column:
    return F.when(_kind(issue, field) == "STRING", F.try_variant_get(issue, f"$.{field}", "string"))


def issues_of(responses: DataFrame, keys: list[str], raw: str = "raw_response") -> DataFrame:
    """Rows (keys, issue_pos, issue as a variant), in order; a response without findings, or that is none, has no row."""
    v = responses.select(*keys, parse_response(F.col(raw)).alias("v"))
    return v.select(*keys, F.posexplode(F.try_variant_get("v", "$.issues", "array<variant>")).alias("issue_pos", "issue"))


def reject_reason(issue: Column) -> Column:
    """Why a finding is invalid, by the first field that is; null if it isn't."""
    reason = F.when(~_text(issue, "scope").isin(SCOPES) | _text(issue, "scope").isNull(), "scope")
    for field in SCORES:
        value = whole_number(issue, field)
        reason = reason.when(value.isNull() | ~value.between(1, 10), field)
    reason = reason.when(~_text(issue, "problem_type").isin(PROBLEM_TYPES) | _text(issue, "problem_type").isNull(), "problem_type")
    for field in OPTIONAL:
        reason = reason.when(~F.coalesce(_kind(issue, field).isin("STRING", "VOID"), F.lit(True)), field)
    return reason.when(_text(issue, "comment").isNull(), "comment")


def validate(rows: DataFrame, issue: str = "issue") -> DataFrame:
    """rows with the finding's fields in place of the variant, and reject_reason. Unknown keys are passed over."""
    v = F.col(issue)
    fields = [_text(v, "scope").alias("scope"), *[whole_number(v, f).alias(f) for f in SCORES], *[_text(v, f).alias(f) for f in ("problem_type", "comment", *OPTIONAL)]]
    return rows.select(*[c for c in rows.columns if c != issue], *fields, reject_reason(v).alias("reject_reason"))


def normal_scope(rows: DataFrame) -> DataFrame:
    """rows (scope, file_path and the anchors) in normal form: a line needs a file and an anchor, a file needs a path; what a scope
    doesn't use is null. Applying it again changes nothing."""
    path, anchor = F.coalesce(F.col("file_path"), F.lit("")) != "", F.coalesce(F.col("anchor_text"), F.lit("")) != ""
    scope = F.when((F.col("scope") == "line") & path & anchor, "line").when(F.col("scope").isin("line", "file") & path, "file").otherwise("mr")
    scope = F.when(F.col("scope").isNotNull(), scope)
    out = rows.withColumn("__scope", scope)
    cleared = {a: F.when(F.col("__scope") == "line", F.col(a)) for a in OPTIONAL[1:]}
    return out.withColumns(cleared | {"file_path": F.when(F.col("__scope") != "mr", F.col("file_path")), "scope": F.col("__scope")}).drop("__scope")


def response_validity(responses: DataFrame, keys: list[str], raw: str = "raw_response") -> DataFrame:
    """(keys, valid, n_issues): one invalid finding rejects its response. {} is valid and empty; null issues are invalid."""
    v = responses.select(*keys, parse_response(F.col(raw)).alias("v"))
    issues = F.try_variant_get("v", "$.issues", "variant")
    listed = F.try_variant_get("v", "$.issues", "array<variant>")
    whole = F.schema_of_variant("v").startswith("OBJECT")
    shape = F.coalesce(whole & (F.schema_of_variant(issues).isNull() | (F.schema_of_variant(issues).startswith("ARRAY") & listed.isNotNull())), F.lit(False))
    good = F.coalesce(F.forall(listed, lambda i: reject_reason(i).isNull()), F.lit(True))
    return v.select(*keys, (shape & good).alias("valid"), F.greatest(F.lit(0), F.coalesce(F.size(listed), F.lit(0))).alias("n_issues"))


def all_or_nothing(rows: DataFrame, response: list[str]) -> DataFrame:
    """Validated rows of responses of which every row is valid."""
    return rows.withColumn("__good", F.bool_and(F.col("reject_reason").isNull()).over(Window.partitionBy(*response))).filter("__good").drop("__good")


def request_reasons(channel_id: Column, message: Column, max_results: Column) -> Column:
    """Why a request's body is invalid: texts have a character at least, results number 1 to 50 (10 by default)."""
    reason = F.when(F.coalesce(F.length(channel_id), F.lit(0)) < 1, "channel_id").when(F.coalesce(F.length(message), F.lit(0)) < 1, "message")
    return reason.when(~F.coalesce(max_results, F.lit(10)).between(1, 50), "max_results")


def model_answer_error(choices: Column, content: Column) -> Column:
    """Why a model's answer can't be read: no choices, or no content."""
    return F.when(F.coalesce(choices, F.lit(0)) < 1, "empty completion").when(F.coalesce(content, F.lit("")) == "", "empty content")
