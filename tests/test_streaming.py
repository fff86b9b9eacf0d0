import json

from pyspark.sql import functions as F

from hunkwise.operators import issues


def test_findings_from_a_stream(spark, tmp_path):
    good = {"scope": "line", "severity_score": "8", "confidence_score": 5, "problem_type": "bug", "comment": "c", "file_path": "p"}
    (tmp_path / "a.json").write_text(json.dumps({"i": 1, "raw_response": json.dumps({"issues": [good, {}]})}))
    stream = spark.readStream.schema("i int, raw_response string").json(str(tmp_path))
    rows = issues.normal_scope(issues.validate(issues.issues_of(stream, ["i"])))
    q = rows.select("i", "issue_pos", "scope", "reject_reason").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.scope, r.reject_reason) for r in spark.table("found").orderBy("issue_pos").collect()] == [("file", None), (None, "scope")]
    assert spark.table("found").filter(F.col("i") == 1).count() == 2
