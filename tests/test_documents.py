import json
import random

from hunkwise.operators import documents

TREE = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Hello "}, {"type": "text", "text": "w"}, {"type": "hardBreak"}, {"type": "text", "text": "x  "}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "i1"}]}]}]}, {"type": "codeBlock", "content": [{"type": "text", "text": "code"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "tail"}]}]}


def test_by_hand():
    assert documents.raw_text(TREE) == "Hello w\nx  \ni1\n\n\ncodetail\n"
    assert documents.plain_text(json.dumps(TREE)) == "Hello w\nx\ni1\ncodetail"
    assert documents.plain_text(None) == "" and documents.plain_text("null") == "" and documents.plain_text('"a\\n\\nb"') == "a\n\nb"


def test_depth_has_no_limit():
    tree = {"type": "text", "text": "deep"}
    for _ in range(3000):
        tree = {"type": "listItem", "content": [tree]}
    assert documents.raw_text(tree) == "deep" + "\n" * 3000


def test_recursive_query_agrees(spark):
    rng = random.Random(3)

    def grow(depth):
        kind = rng.choice(["paragraph", "heading", "codeBlock", "text", "hardBreak", "mention"])
        return {"type": kind} | ({"text": rng.choice("abc")} if kind == "text" else {"content": [grow(depth - 1) for _ in range(rng.randrange(3))]} if depth else {})

    trees = [{"type": "doc", "content": [grow(4) for _ in range(3)] + [{"type": "text", "text": "z"}]} for _ in range(20)]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, tree string")
    got = {r.i: r.raw for r in documents.flatten_by_recursion(spark, df, "i", "tree").collect()}
    assert [got[i] for i in range(len(trees))] == [documents.raw_text(t) for t in trees]
    flat = {r.i: r.d for r in df.select("i", documents.flatten("tree").alias("d")).collect()}
    assert [flat[i] for i in range(len(trees))] == [documents.plain_text(json.dumps(t)) for t in trees]


def test_what_is_no_tree_is_null(spark):
    deep = '{"content":[' * 50_000
    rows = spark.createDataFrame([(0, "{"), (1, deep + '{"type":"text","text":"x"}' + "]}" * 50_000), (2, '"plain"'), (3, None)], "i int, t string")
    assert [r.d for r in rows.select("i", documents.flatten("t").alias("d")).orderBy("i").collect()] == [None, None, "plain", ""]
