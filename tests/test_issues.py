import json

from pyspark.sql import functions as F

from hunkwise.operators import issues
from hunkwise.plans.review import plan_review

GOOD = {"scope": "line", "severity_score": 8, "confidence_score": 5, "problem_type": "bug", "comment": "c", "file_path": "p", "anchor_text": "a"}


def reasons(spark, values):
    rows = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    return [r.reject_reason for r in sorted(issues.validate(rows.select("i", F.parse_json("j").alias("issue"))).collect())]


def test_numbers_are_lax(spark):
    good = ["8", '"8"', "8.0", '"8.0"', '" 8 "', "true"]
    bad = ["8.5", "null", "11", "0", '"x"', "[8]", "false", '""', '"8."']
    make = lambda s: json.dumps(GOOD).replace('"severity_score": 8', f'"severity_score": {s}')
    assert reasons(spark, [make(s) for s in good]) == [None] * len(good)
    assert reasons(spark, [make(s) for s in bad]) == ["severity_score"] * len(bad)


def test_fields(spark):
    without = {k: v for k, v in GOOD.items() if k != "comment"}
    cases = [GOOD | {"more": 1}, GOOD | {"scope": "x"}, GOOD | {"problem_type": None}, GOOD | {"anchor_text": 5}, GOOD | {"file_path": None}, without]
    assert reasons(spark, cases) == [None, "scope", "problem_type", "anchor_text", None, "comment"]


def test_scopes(spark):
    cases = [("line", None, "a", "mr", None, None), ("line", "", "a", "mr", None, None), ("line", "p", None, "file", "p", None), ("line", "p", "", "file", "p", None), ("line", "p", "a", "line", "p", "a"), ("file", "p", "a", "file", "p", None), ("file", None, "a", "mr", None, None), ("mr", "p", "a", "mr", None, None)]
    rows = spark.createDataFrame([(i, *c[:3], "b", "d") for i, c in enumerate(cases)], "i int, scope string, file_path string, anchor_text string, before_anchor string, after_anchor string")
    once = issues.normal_scope(rows)
    got = {r.i: r for r in once.collect()}
    assert [(got[i].scope, got[i].file_path, got[i].anchor_text) for i in range(len(cases))] == [c[3:] for c in cases]
    assert all((r.before_anchor is None) == (r.scope != "line") for r in got.values())
    assert sorted(issues.normal_scope(once).collect()) == sorted(once.collect())


def test_responses(spark):
    raws = ["{}", '{"issues":null}', "no json", '{"issues":[]}', json.dumps({"issues": [GOOD]}), json.dumps({"issues": [GOOD, GOOD | {"scope": "x"}]}), "[]", None, '{"issues":{}}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw_response string")
    got = [(r.valid, r.n_issues) for r in sorted(issues.response_validity(rows, ["i"]).collect())]
    assert got == [(True, 0), (False, 0), (False, 0), (True, 0), (True, 1), (False, 2), (False, 0), (False, 0), (False, 0)]


def test_whole_review(spark):
    found = [GOOD | {"anchor_text": "x = 1"}, GOOD | {"anchor_text": "gone"}, GOOD | {"file_path": "other"}, GOOD | {"scope": "mr"}]
    r = spark.createDataFrame([(1, json.dumps({"issues": found})), (2, json.dumps({"issues": [GOOD, {}]}))], "mr int, raw_response string")
    m = spark.createDataFrame([(1, [("o", "p", "@@ +4 @@\n+x = 1"), ("o2", "p", "@@ +9 @@\n+x = 1")])], "mr int, diffs array<struct<old_path:string,new_path:string,diff:string>>")
    got = sorted(plan_review(r, m, ["mr"]).collect(), key=lambda x: x.issue_pos)
    assert [(x.mr, x.publication_mode, x.new_line, x.old_path) for x in got] == [(1, "inline", 4, "o"), (1, "mr_note_fallback", None, None), (1, "mr_note_fallback", None, None), (1, "mr_note", None, None)]
    assert got[2].body.endswith("Publication fallback: file_path was not found in MR diff")
