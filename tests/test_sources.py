import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hunkwise.functions.http import duration_ms, error_status, request_id
from hunkwise.operators import housekeeping, projections, publish
from hunkwise.sources import captured, model, settings, sinks
from hunkwise.sources.rest import KeyedRest, PagedRest, answers, error_of, page_rows, posted_as

sys.path.insert(0, str(Path(__file__).parent))


def paged(spark, url, **options):
    spark.dataSource.register(PagedRest)
    return spark.read.format("paged_rest").options(url=url, fetch="tests.fake_server:answer", **options).load()


def test_pages_in_order(spark):
    rows = sorted(paged(spark, "http://h/diffs").collect())
    assert [(r.page, r.pos, json.loads(r.item)["new_path"]) for r in rows] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_known_pages_are_partitions(spark):
    df = paged(spark, "http://h/diffs", pages="2")
    assert df.rdd.getNumPartitions() == 2 and df.count() == 3


def test_errors(spark):
    assert [r.error for r in paged(spark, "http://h/denied").collect()] == ["403: no"]
    assert [r.error for r in paged(spark, "http://h/down").collect()] == ["502: refused"]
    codes = [200, 302, 401, 403, 404, 400, 409, 500, None]
    want = [None, None, 401, 403, 404, 502, 502, 502, 502]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, s int").select("i", error_status(F.col("s")).alias("e")).collect()
    assert [r.e for r in sorted(rows)] == want and [error_of(c) for c in codes] == want


def test_writes(spark):
    spark.dataSource.register(PagedRest)
    rows = sinks.chat_posts(spark.createDataFrame([("c", "m")], "channel_id string, message string"))
    sinks.write(rows, "http://h", fetch="tests.fake_server:answer")
    with pytest.raises(Exception, match="403"):
        sinks.write(rows, "http://h/denied", fetch="tests.fake_server:answer")


def test_posts(spark):
    plan = spark.createDataFrame([(7, "inline", "a b")], "mr_iid int, publication_mode string, body string")
    row = sinks.posts(plan, "g/p").first()
    assert row.path == "/projects/g%2Fp/merge_requests/7/discussions" and row.body == "body=a+b"


def test_outcome(spark):
    plan = spark.createDataFrame([(1, "inline", None), (2, "mr_note", 502)], "i int, publication_mode string, e int")
    got = publish.outcome(plan, F.col("e"), F.lit("x")).orderBy("i").collect()
    assert [(r.publication_mode, r.publish_error) for r in got] == [("inline", None), ("failed", "x")]


def test_model(spark):
    def provider(system, text, options):
        if text == "bad":
            raise ValueError("no")
        return "" if text == "none" else json.dumps({"issues": [], "n": options["max_tokens"]})

    rows = model.respond(spark.createDataFrame([("ok",), ("bad",), ("none",)], "prompt string"), provider, "s").collect()
    got = {r.prompt: (r.raw_response, r.error) for r in rows}
    assert got["ok"] == ('{"issues": [], "n": 5000}', None) and got["bad"] == (None, "500: no") and got["none"] == (None, "500: empty content")
    assert model.response_schema()["properties"]["issues"]["items"]["required"][0] == "scope"


def test_settings():
    env = {n: "x" for n in settings.REQUIRED}
    assert settings.load(env | {"LOG_LEVEL": "debug"})["LOG_LEVEL"] == "DEBUG" and settings.load(env)["LOG_BACKUP_DAYS"] == 30
    with pytest.raises(ValueError):
        settings.load(env | {"LOG_LEVEL": "loud"})
    with pytest.raises(ValueError):
        settings.load(env | {"BASE_URL": ""})


def test_files(spark, tmp_path):
    (tmp_path / "app.2026-01-01.log").write_text("a\nb")
    (tmp_path / "other").write_text("")
    assert {r.name for r in captured.listed(spark, str(tmp_path)).collect()} == {"app.2026-01-01.log", "other"}
    assert "a\nb" in {r.content for r in captured.whole_files(spark, str(tmp_path)).collect()}
    (tmp_path / "mr.json").write_text(json.dumps({"id": 1, "iid": 2, "diffs": [{"new_path": "p"}]}))
    assert captured.json_rows(spark, str(tmp_path / "mr.json"), captured.MERGE_REQUEST).first().diffs[0].new_path == "p"
    t = spark.createDataFrame([('{"key":"K","fields":{"summary":"s"}}',)], "j string")
    assert captured.parsed(t, "j", captured.TASK).first().fields.summary == "s"


def test_retention(spark):
    names = [f"a.2026-01-0{i}.log" for i in range(1, 6)] + ["a.log", "b.2026-01-01.log", "a.2026-01-01.logx"]
    df = spark.createDataFrame([("d", n) for n in names], "folder string, name string").filter(housekeeping.is_dated(F.col("name"), "a", ".log"))
    left = lambda n: sorted(r.name for r in housekeeping.to_delete(df, ["folder"], n).collect())
    assert left(3) == names[:2] and left(0) == [] and left(5) == [] and left(-1) == []
    one = spark.createDataFrame([("a.log.2026-01-02",)], "n string").select(housekeeping.rotated_name(F.col("n"))).first()[0]
    assert one == "a.2026-01-02.log"


def test_pages_end_at_an_empty_one(spark):
    pages = spark.createDataFrame([("g", 1, [1], 2), ("g", 2, [], 3), ("g", 3, [9], 4), ("h", 1, [5], None), ("h", 2, [6], 3)], "g string, page int, items array<int>, next_page int")
    assert sorted((r.g, r.item) for r in housekeeping.in_page_order(pages, ["g"]).collect()) == [("g", 1), ("h", 5)]


def test_missing_inputs(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 2)], "issue_key string, mr_iid int")
    assert [r.issue_key for r in projections.missing_inputs(asked, asked.filter("mr_iid = 1")).collect()] == ["b"]


def test_request_ids_and_durations(spark):
    rows = spark.createDataFrame([("a", 1.23456), ("", 0.5), (None, 0.0)], "h string, s double").select(request_id(F.col("h")).alias("i"), duration_ms(F.col("s")).alias("d")).collect()
    assert rows[0].i == "a" and len(rows[1].i) == len(rows[2].i) == 36 and [r.d for r in rows] == [1234.56, 500.0, 0.0]


def test_null_groups_are_groups(spark):
    files = spark.createDataFrame([(None, f"a.2026-01-0{i}.log") for i in range(1, 6)] + [("d", "a.2026-01-01.log")], "folder string, name string")
    assert sorted(r.name for r in housekeeping.to_delete(files, ["folder"], 3).collect()) == ["a.2026-01-01.log", "a.2026-01-02.log"]
    pages = spark.createDataFrame([(None, 1, [1], 2), (None, 2, [2], None), (None, 3, [3], 4)], "g string, page int, items array<int>, next_page int")
    assert sorted((r.g, r.item) for r in housekeeping.in_page_order(pages, ["g"]).collect()) == [(None, 1), (None, 2)]


def keyed(spark):
    spark.dataSource.register(KeyedRest)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("keyed_rest").options(url="http://h/items/{key}", fetch="hunkwise.sources.canned:answer").load()


def test_lookup_by_key(spark):
    df = keyed(spark)
    got = df.filter("key IN ('1', '7', '2', '1') AND status > 0 AND key <> '2'").collect()
    assert sorted((r.key, r.status, r.error) for r in got) == [("1", 200, None), ("7", 404, "404: no 7")]
    assert df.filter("key = '1' AND key = '2'").count() == 0
    many = df.filter(F.col("key").isin(*[str(i) for i in range(1, 251)]))
    assert many.rdd.getNumPartitions() == 3 and many.count() == 250
    with pytest.raises(Exception, match="names its keys"):
        keyed(spark).count()
    with pytest.raises(Exception, match="names its keys"):
        df.filter("status = 200").count()


def test_answers_are_of_their_row_alone(spark):
    rows = spark.createDataFrame([("/a/1", 1.5, "x"), ("/a/7", None, "y"), (None, 2.0, None), ("/a/17", 0.0, None)], "path string, v double, error string")
    got = {r.path: r for r in answers(rows, "http://h", fetch="hunkwise.sources.canned:answer").collect()}
    assert {p: (r.status, r.error_status, r.error) for p, r in got.items()} == {"/a/1": (200, None, None), "/a/7": (404, 404, "404: no 7"), None: (None, 502, "502: no path"), "/a/17": (None, 502, "502: refused")}
    assert got["/a/7"].v is None and got["/a/17"].v == 0.0 and json.loads(got["/a/1"].answer)["title"] == "t1"
    assert answers(rows.limit(0), "http://h", fetch="hunkwise.sources.canned:answer").count() == 0


def test_a_post_tried_again_has_its_key(spark):
    one = posted_as({"a": "b"}, "http://h/x", b"t")
    assert one["a"] == "b" and one == posted_as({"a": "b"}, "http://h/x", b"t")
    assert len({posted_as({}, u, b, k)["Idempotency-Key"] for u in ("x", "y") for b in (b"", b"1") for k in ("", "k")}) == 8


def test_inline_posts_have_positions(spark):
    plan = spark.createDataFrame([(1, 3, "inline", "t"), (2, 7, "mr_note", "t")], "i int, mr_iid int, publication_mode string, body string")
    got = {r.i: r for r in sinks.published(plan, "g/p", "http://h", F.lit("u"), ["i"], position=F.create_map(F.lit("body"), F.lit("at")), fetch="hunkwise.sources.canned:answer").collect()}
    assert got[1].discussion.id == "d3" and got[1].discussion.notes_count == 1 and got[1].note is None and got[1].publish_error is None
    assert (got[2].publication_mode, got[2].publish_error, got[2].discussion, got[2].note) == ("failed", "404: no 7", None, None)
