"""The model as an outer table function: prompts in, JSON texts out, behind a provider that is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from hunkwise.operators.issues import MODEL_OUTPUT_LIMIT, OPTIONAL, PROBLEM_TYPES, SCOPES, SCORES

# Fixed value: the schema's name.
SCHEMA_NAME = "structured_response_schema"

Provider = Callable[[str, str, dict], str]


def response_schema() -> dict:
    """The JSON schema that a provider is asked to follow."""
    text = {"anyOf": [{"type": "string"}, {"type": "null"}]}
    fields = {"scope": {"enum": SCOPES}, "problem_type": {"enum": PROBLEM_TYPES}, "comment": {"type": "string"}}
    fields |= {s: {"type": "integer", "minimum": 1, "maximum": 10} for s in SCORES} | {o: text for o in OPTIONAL}
    issue = {"type": "object", "properties": fields, "required": ["scope", *SCORES, "problem_type", "comment"]}
    return {"type": "object", "properties": {"issues": {"type": "array", "items": issue}}}


def response_format() -> dict:
    """The schema as a provider of structured answers takes it: named, and to be followed strictly."""
    return {"type": "json_schema", "json_schema": {"name": SCHEMA_NAME, "schema": response_schema(), "strict": True}}


def respond(prompts: DataFrame, provider: Provider, system: str, prompt: str = "prompt", max_tokens: int = MODEL_OUTPUT_LIMIT) -> DataFrame:
    """prompts with raw_response and error. A provider's failure is an error of its row alone; an empty answer is one too."""
    options = {"max_tokens": max_tokens, "schema": response_schema(), "response_format": response_format()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for text in batch[prompt]:
                try:
                    raw = provider(system, text, options)
                    answers.append((raw, None) if raw else (None, "500: empty content"))
                except Exception as e:  # noqa: BLE001  the provider is outer code
                    answers.append((None, f"500: {e}"))
            yield batch.assign(raw_response=[a for a, _ in answers], error=[b for _, b in answers])

    return prompts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", raw_response string, error string")
