"""Rich-text documents: trees of {type, text, content} as JSON, flattened to plain text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.functions.text import BREAKS, rstrip, split_lines, strip

# The node types that end in a line break, and the one that is a break.
BLOCKS = ["paragraph", "heading", "bulletList", "orderedList", "listItem"]
BREAK = "hardBreak"
_BREAKS = re.compile(BREAKS.replace(r"\x{85}", "\x85").replace(r"\x{2028}", " ").replace(r"\x{2029}", " "))


def raw_text(tree: object) -> str:
    """A tree's text in document order, with a break after the children of each block. Trees are walked with a stack."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):  # a break that waits for its block's children
            out.append(node)
        elif isinstance(node, list):
            todo.extend(n for n in reversed(node) if isinstance(n, (dict, list)))
        elif isinstance(node, dict):
            kind = node.get("type")
            if kind == "text":
                out.append(str(node.get("text") or ""))
            if kind == BREAK:
                out.append("\n")
            if kind in BLOCKS:
                todo.append("\n")
            todo.append(node.get("content") or [])
    return "".join(out)


def plain_text(value: str | None) -> str:
    """null gives an empty text, a JSON string itself, a tree its non-blank lines without trailing white space.

    What is no JSON, or nests deeper than Python's reader goes (some thousand levels), gives null.
    """
    try:
        tree = None if value is None else json.loads(value)
    except (ValueError, RecursionError):
        return None
    if tree is None or isinstance(tree, str):
        return tree or ""
    lines = _BREAKS.split(raw_text(tree))
    return "\n".join(line.rstrip() for line in lines if line.strip())


@F.pandas_udf(T.StringType())
def flatten(trees: pd.Series) -> pd.Series:
    """Trees are recursive, which no struct can hold; so they are walked in Arrow batches; see plain_text."""
    return trees.map(plain_text)


def without_blank_lines(text: Column) -> Column:
    """Non-blank lines of a text, without trailing white space."""
    return F.array_join(F.transform(F.filter(split_lines(text), lambda x: strip(x) != ""), rstrip), "\n")


def flatten_by_recursion(spark: SparkSession, trees: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, raw) of trees by a recursive query, as a check of `flatten`: at most 100 levels, and a million nodes in all."""
    trees.select(F.col(key).alias("k"), F.parse_json(tree).alias("v")).createOrReplaceTempView("__trees")
    blocks = ", ".join(f"'{b}'" for b in BLOCKS)
    return spark.sql(f"""
        WITH RECURSIVE nodes(k, v, path) AS (
          SELECT k, v, cast(array() AS array<int>) FROM __trees
          UNION ALL
          SELECT n.k, c.value, concat(n.path, array(c.pos)) FROM nodes n, LATERAL variant_explode(variant_get(n.v, '$.content', 'variant')) c
        ), tokens AS (
          SELECT k, path, CASE variant_get(v, '$.type', 'string') WHEN 'text' THEN variant_get(v, '$.text', 'string') WHEN '{BREAK}' THEN '\\n' END AS token FROM nodes
          UNION ALL
          SELECT k, concat(path, array(2147483647)), '\\n' FROM nodes WHERE variant_get(v, '$.type', 'string') IN ({blocks})
        )
        SELECT k AS {key}, array_join(transform(array_sort(collect_list(struct(path, token))), x -> x.token), '') AS raw FROM tokens WHERE token IS NOT NULL GROUP BY k""")
