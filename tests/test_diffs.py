import random
import re

from pyspark.sql import functions as F

from hunkwise.operators import diffs, localize, publish

F1 = "@@ -1,4 +10,6 @@ def f(+99)\n ctx\n-old\n--- sql\n+new1\n+++x\n\\ No newline at end of file\n+new2\n@@ broken @@\n+skip\n@@ -50 +60 @@\n+z"


def plain_added(text: str) -> list[tuple[int, str, int]]:
    """What a line's number is, told by counting: an independent statement of the rules."""
    out, number = [], None
    for i, line in enumerate(text.splitlines()):
        if line[:2] == "@@":
            m = re.search(r"\+(\d+)", line)
            number = int(m[1]) if m else None
        elif number is not None:
            is_added = line[:1] == "+" and line[:3] != "+++"
            if is_added:
                out.append((number, line[1:], i))
            if not (line[:1] == "-" and line[:3] != "---") and line[:1] != "\\":
                number += 1
    return out


def added(spark, texts):
    rows = diffs.added_lines(spark.createDataFrame(list(enumerate(texts)), "k int, diff string"), ["k"]).collect()
    return [sorted((r.new_line, r.text, r.raw_index) for r in rows if r.k == i) for i in range(len(texts))]


def test_added_lines_by_hand(spark):
    assert added(spark, [F1]) == [[(12, "new1", 4), (14, "new2", 7), (60, "z", 11)]]


def test_added_lines_of_random_diffs(spark):
    rng = random.Random(5)
    kinds = ["+a", "-b", " c", "+++x", "---y", "\\ n", "", "@@ -1 +7 @@", "@@ x @@", "+", "-", "@@ +3"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(0, 25))) for _ in range(300)]
    assert added(spark, texts) == [sorted(plain_added(t)) for t in texts]


def test_null_and_empty_diffs(spark):
    assert added(spark, [None, "", "no hunk"]) == [[], [], []]


def test_unified_text(spark):
    rows = spark.createDataFrame([([("a", "b", "x"), (None, "n", None), ("", "", "z")],)], "d array<struct<old_path:string,new_path:string,diff:string>>")
    want = "diff --git a/a b/b\n--- a/a\n+++ b/b\nx\ndiff --git a/n b/n\n--- a/n\n+++ b/n\n\ndiff --git a/unknown b/unknown\n--- a/unknown\n+++ b/unknown\nz"
    assert rows.select(diffs.unified_diff_text(F.col("d"))).first()[0] == want


FAR = "@@ -1 +1 @@\n+same\n" + "\n".join(f" l{i}" for i in range(30)) + "\n+same\n after"
CASES = [
    # file_path, anchor, before, after, new_path, diff -> ok, line, reason
    (None, "a", None, None, "p", "", False, None, localize.NO_PATH),
    ("p", "", None, None, "p", "", False, None, localize.NO_ANCHOR),
    ("p", "a", None, None, None, "", False, None, "file_path 'p' does not match diff new_path 'None'"),
    ("p", "a", None, None, "p", None, False, None, localize.NOT_FOUND),
    ("p", " \t", None, None, "p", FAR, False, None, localize.NOT_FOUND),
    ("p", "z\nq", None, None, "p", "@@ +1 @@\n+z", True, 1, localize.UNIQUE),
    ("p", "same", None, "after", "p", FAR, True, 32, localize.RESOLVED),
    ("p", "same", "l20", None, "p", FAR, True, 32, localize.RESOLVED),  # ten lines before
    ("p", "same", "l19", None, "p", FAR, False, None, localize.UNRESOLVED + "[1, 32]"),  # eleven
    ("p", "same", "   ", None, "p", FAR, False, None, localize.UNRESOLVED + "[1, 32]"),
    ("p", "same", None, None, "p", FAR, False, None, localize.STILL_AMBIGUOUS + "[1, 32]"),
    ("p", "x", "", "", "p", "@@ +5 @@\n+x\n@@ +5 @@\n+x", True, 5, localize.UNIQUE),
]


def test_outcomes(spark):
    rows = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(CASES)], "k int, file_path string, anchor_text string, before_anchor string, after_anchor string, new_path string, diff string")
    got = {r.k: (r.ok, r.new_line, r.reason) for r in localize.locate(rows, ["k"]).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[6:] for c in CASES]


def test_windows_need_one_exchange(spark):
    d = spark.createDataFrame([(1, F1)], "k int, diff string")
    plan = diffs.added_lines(d, ["k"])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_empty_and_equal_diffs(spark):
    d = "@@ -1 +1,2 @@\n+ a\\\\.b  c\n+\n+x"
    rows = [(1, "p", "a.b c", None, None, "p", d), (2, "q", "x", "a\\.b", "", "q", d), (3, "p", "x", None, None, "p", None), (4, "p", "x", None, None, "p", ""), (None, None, "x", None, None, "p", d)]
    found = localize.locate(spark.createDataFrame(rows, "k int, file_path string, anchor_text string, before_anchor string, after_anchor string, new_path string, diff string"), ["k"])
    assert {(r.k, r.new_line) for r in found.collect()} == {(1, 1), (2, 3), (3, None), (4, None), (None, None)}
    files = spark.createDataFrame([(1, 0, "p", "o", ""), (1, 1, "p", "o", d)], "mr int, file_pos int, new_path string, old_path string, diff string")
    issue = [(1, 0, "line", "bug", 5, 5, "c", "p", "x", None, None), (1, 1, "line", "bug", 5, 5, "c", "other", "x", None, None)]
    schema = "mr int, issue_pos int, scope string, problem_type string, severity_score int, confidence_score int, comment string, file_path string, anchor_text string, before_anchor string, after_anchor string"
    got = {r.issue_pos: r.fallback_reason for r in publish.publication_plan(spark.createDataFrame(issue, schema), files, ["mr"]).collect()}
    assert got == {0: localize.NOT_FOUND, 1: publish.NO_FILE}
