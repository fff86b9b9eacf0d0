"""The registered queries over the supplied tables, and the DuckDB SQL that each must equal.

The tables hold no diffs or findings, so these are derived: a document becomes a diff (a header before every fifth line; lines are
added, kept, deleted, added in turn), a benchmark passage an anchor, an event a finding, a conversation a rich-text tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.functions import text as X
from hunkwise.functions.http import duration_ms, error_status, request_id
from hunkwise.operators import diffs, documents, housekeeping, issues, localize, projections, publish
from hunkwise.plans.passages import locate_passages
from hunkwise.plans.review import plan_review
from hunkwise.sources import captured, model, rest, settings, sinks
from hunkwise.sources.canned import answer, provider


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL fragments -------------------------------------------------------------------------------------------------------


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{X.SPACES}+', ' ', 'g'), ' ')"


def _soft(x: str) -> str:
    y = f"regexp_replace({x}, '^{X.SPACES}+|{X.SPACES}+$', '', 'g')"
    for old, new in X.ESCAPES:
        y = "replace({}, '{}', '{}')".format(y, old.replace("'", "''"), new.replace("'", "''"))
    return _norm(y)


def _compact(x: str) -> str:
    return f"regexp_replace({_soft(x)}, '{X.SPACES}+', '', 'g')"


def _lines(x: str) -> str:
    y = f"regexp_split_to_array({x}, '{X.BREAKS}')"
    return f"(CASE WHEN {y}[-1] = '' THEN list_slice({y}, 1, len({y}) - 1) ELSE {y} END)"


def _escaped(x: str) -> str:
    return f"replace({x}, '.', '\\.')"


_FORMS = f"""
variants AS (
  SELECT DISTINCT id, {_norm("v")} AS norm, {_compact("v")} AS compact FROM (
    SELECT id, unnest(list_concat(list_filter(list_transform({_lines("t")}, lambda p: regexp_replace(p, '^{X.SPACES}+|{X.SPACES}+$', '', 'g')), lambda p: p <> ''), [t])) AS v FROM anchors
  )
), soft_variants AS (SELECT DISTINCT id, {_norm("s")} AS norm, {_compact("s")} AS compact FROM (
    SELECT id, {_soft("v")} AS s FROM (SELECT id, unnest(list_concat({_lines("t")}, [t])) AS v FROM anchors)) WHERE s <> ''
), forms AS (SELECT * FROM variants UNION SELECT * FROM soft_variants)
"""
_HIT = "(f.norm <> '' AND contains({n}, f.norm)) OR (f.compact <> '' AND contains({c}, f.compact))"

# A document's diff as numbered raw lines, and its added lines.
_RAW = """
parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
doc_lines AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM parts),
raw0 AS (
  SELECT doc_id, i * 2 AS ord, '@@ -' || (i + 1) || ' +' || (2 * i + 1) || ',5 @@' AS line FROM doc_lines WHERE i % 5 = 0
  UNION ALL SELECT doc_id, i * 2 + 1, CASE i % 4 WHEN 1 THEN ' ' WHEN 2 THEN '-' ELSE '+' END || x FROM doc_lines
)"""
# The diff is a text: what breaks lines in it does so again.
_NUMBERED = f"""{_RAW},
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS diff FROM raw0 GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(range(len(l))) AS raw_index, unnest(l) AS line FROM (SELECT doc_id, {_lines("diff")} AS l FROM texts)),
flags AS (SELECT *, starts_with(line, '@@') AS h, starts_with(line, '+') AND NOT starts_with(line, '+++') AS a,
  CASE WHEN starts_with(line, '@@') OR (starts_with(line, '-') AND NOT starts_with(line, '---')) OR starts_with(line, '\\') THEN 0 ELSE 1 END AS m,
  CASE WHEN starts_with(line, '@@') THEN try_cast(regexp_extract(line, '\\+([0-9]+)', 1) AS INT) END AS s FROM raw),
hunked AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY raw_index) AS hunk FROM flags),
numbered AS (SELECT *, CASE WHEN hunk > 0 AND NOT h THEN max(s) OVER (PARTITION BY doc_id, hunk) + coalesce(sum(m) OVER (PARTITION BY doc_id, hunk ORDER BY raw_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::INT AS new_line FROM hunked),
added AS (SELECT doc_id, new_line, substr(line, 2) AS text, raw_index::INT AS raw_index FROM numbered WHERE a AND new_line IS NOT NULL)
"""


def synthetic_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, diff)"""
    docs = _read(spark, sf_dir, "documents")
    mark = lambda i: F.when(i % 4 == 1, " ").when(i % 4 == 2, "-").otherwise("+")
    head = lambda i: F.when(i % 5 == 0, F.concat(F.lit("@@ -"), (i + 1).cast("string"), F.lit(" +"), (2 * i + 1).cast("string"), F.lit(",5 @@\n"))).otherwise("")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(head(i), mark(i), x)), "\n").alias("diff"))


# ---- 1: text primitives and the flagship ---------------------------------------------------------------------------------


def q_locate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("normalized"))


def q_compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", X.compact(F.col("text")).alias("compacted"))


def q_soft_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", X.soft(F.replace("text", F.lit("."), F.lit("\\."))).alias("softened"))


def q_anchor_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select("item_id", F.explode(X.variants(F.replace("text", F.lit("."), F.lit("\\.")))).alias("variant"))


def q_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("pos", "line"))


# ---- 2: diffs ------------------------------------------------------------------------------------------------------------


def q_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.added_lines(synthetic_diffs(spark, sf_dir), ["doc_id"])


def q_hunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.hunks(synthetic_diffs(spark, sf_dir), ["doc_id"])


def q_unified_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda old, new: F.struct(old.cast("string").alias("old_path"), new.cast("string").alias("new_path"), F.col("diff"))
    path, none = F.concat(F.lit("src/"), F.col("doc_id").cast("string")), F.lit(None)
    files = F.array(one(path, path), one(none, path), one(F.lit(""), F.lit("")))
    return synthetic_diffs(spark, sf_dir).select("doc_id", diffs.unified_diff_text(files).alias("unified"))


# ---- 3: disambiguation ---------------------------------------------------------------------------------------------------


def q_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows around each added line, as digests."""
    d = synthetic_diffs(spark, sf_dir)
    at = diffs.added_lines(d, ["doc_id"]).groupBy("doc_id").agg(F.collect_list("raw_index").alias("ats"))  # of one diff
    rows = d.withColumn("lines", X.split_lines(F.col("diff"))).join(at, "doc_id").select("doc_id", "lines", F.explode("ats").alias("raw_index"))
    return rows.select("doc_id", "raw_index", F.md5(diffs.window_before(F.col("lines"), F.col("raw_index"))).alias("before"), F.md5(diffs.window_after(F.col("lines"), F.col("raw_index"))).alias("after"))


def _first_word(x: Column) -> Column:
    return F.split_part(x, F.lit(" "), F.lit(1))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, issue_pos, file_path, anchor_text, before_anchor, after_anchor, new_path, diff): one of each kind for every document.

    Anchors are the first line, its first word, the first word with the line before or after the second added line, a word that
    isn't there, and none; then no path and another path.
    """
    d = synthetic_diffs(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = F.split("text", "\n")
    first, third, second = F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(2)), F.lit("")), F.coalesce(F.get(lines, F.lit(1)), F.lit("   "))
    none, path = F.lit(None).cast("string"), F.concat(F.lit("src/"), F.col("doc_id").cast("string"))
    word = _first_word(first)
    kinds = [(path, first, none, none), (path, word, none, none), (path, word, third, none), (path, word, none, second), (path, F.lit("no such words"), none, none), (path, F.lit(""), none, none), (none, first, none, none), (F.lit("other"), first, none, none), (path, F.lit("e"), second, third)]
    rows = F.array(*[F.struct(F.lit(i).alias("issue_pos"), p.alias("file_path"), a.alias("anchor_text"), b.alias("before_anchor"), c.alias("after_anchor")) for i, (p, a, b, c) in enumerate(kinds)])
    return d.select("doc_id", path.alias("new_path"), "diff", F.explode(rows).alias("f")).select("doc_id", "f.*", "new_path", "diff")


def q_locate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localize.locate(findings(spark, sf_dir), ["doc_id", "issue_pos"]).select("doc_id", "issue_pos", "ok", "new_line", "reason")


_FINDINGS_SQL = """
firsts AS (SELECT doc_id, 'src/' || doc_id AS path, p[1] AS first, string_split(p[1], ' ')[1] AS word, coalesce(p[3], '') AS third, coalesce(p[2], '   ') AS second FROM parts),
findings AS (
  SELECT doc_id, 0 AS issue_pos, path AS file_path, first AS anchor_text, NULL::VARCHAR AS before_anchor, NULL::VARCHAR AS after_anchor FROM firsts
  UNION ALL SELECT doc_id, 1, path, word, NULL, NULL FROM firsts
  UNION ALL SELECT doc_id, 2, path, word, third, NULL FROM firsts
  UNION ALL SELECT doc_id, 3, path, word, NULL, second FROM firsts
  UNION ALL SELECT doc_id, 4, path, 'no such words', NULL, NULL FROM firsts
  UNION ALL SELECT doc_id, 5, path, '', NULL, NULL FROM firsts
  UNION ALL SELECT doc_id, 6, NULL, first, NULL, NULL FROM firsts
  UNION ALL SELECT doc_id, 7, 'other', first, NULL, NULL FROM firsts
  UNION ALL SELECT doc_id, 8, path, 'e', second, third FROM firsts
)"""


def _one_line_forms(x: str) -> str:
    """Anchors here have no breaks, so their forms are two at most."""
    return f"list_filter(list_distinct([{{'n': {_norm(x)}, 'c': {_compact(x)}}}, {{'n': {_norm(_soft(x))}, 'c': {_compact(_soft(x))}}}]), lambda z: z.n <> '' OR z.c <> '')"


def _found(forms: str, n: str, c: str) -> str:
    return f"len(list_filter({forms}, lambda z: (z.n <> '' AND contains({n}, z.n)) OR (z.c <> '' AND contains({c}, z.c)))) > 0"


_LOCATE_SQL = f"""WITH {_NUMBERED}, {_FINDINGS_SQL},
asked AS (SELECT *, {_one_line_forms("anchor_text")} AS af, {_one_line_forms("before_anchor")} AS bf, {_one_line_forms("after_anchor")} AS cf FROM findings WHERE file_path = 'src/' || doc_id AND anchor_text <> ''),
added_forms AS (SELECT *, {_norm("text")} AS n, {_compact("text")} AS c FROM added),
cands AS (SELECT q.*, a.new_line, a.raw_index FROM asked q JOIN added_forms a USING (doc_id) WHERE {_found("af", "a.n", "a.c")}),
windows AS (SELECT *, {_norm("b")} AS bn, {_compact("b")} AS bc, {_norm("f")} AS fn, {_compact("f")} AS fc FROM (
  SELECT doc_id, raw_index::INT AS raw_index, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY raw_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b,
         string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY raw_index ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS f FROM raw)),
judged AS (SELECT k.doc_id, issue_pos, new_line,
  (coalesce(before_anchor, '') = '' OR coalesce({_found("bf", "coalesce(bn, '')", "coalesce(bc, '')")}, false)) AND (coalesce(after_anchor, '') = '' OR coalesce({_found("cf", "coalesce(fn, '')", "coalesce(fc, '')")}, false)) AS stays
  FROM cands k JOIN windows w ON k.doc_id = w.doc_id AND k.raw_index = w.raw_index),
sets AS (SELECT doc_id, issue_pos, list_sort(list(DISTINCT new_line)) AS l, coalesce(list_sort(list(DISTINCT new_line) FILTER (WHERE stays)), []) AS s FROM judged GROUP BY ALL),
located AS (SELECT f.doc_id, f.issue_pos, f.file_path, f.anchor_text, coalesce(l, []) AS l, coalesce(s, []) AS s, coalesce(file_path, '') <> '' AND anchor_text <> '' AND file_path = 'src/' || f.doc_id AS asked FROM findings f LEFT JOIN sets USING (doc_id, issue_pos)),
results AS (SELECT doc_id, issue_pos, CASE WHEN asked AND len(l) = 1 THEN l[1] WHEN asked AND len(l) > 1 AND len(s) = 1 THEN s[1] END AS new_line,
  CASE WHEN coalesce(file_path, '') = '' THEN '{localize.NO_PATH}' WHEN anchor_text = '' THEN '{localize.NO_ANCHOR}'
       WHEN NOT asked THEN 'file_path ''' || file_path || ''' does not match diff new_path ''src/' || doc_id || ''''
       WHEN len(l) = 0 THEN '{localize.NOT_FOUND}' WHEN len(l) = 1 THEN '{localize.UNIQUE}' WHEN len(s) = 1 THEN '{localize.RESOLVED}'
       WHEN len(s) = 0 THEN '{localize.UNRESOLVED}[' || array_to_string(l, ', ') || ']' ELSE '{localize.STILL_AMBIGUOUS}[' || array_to_string(s, ', ') || ']' END AS reason FROM located)
"""


# ---- 4: findings ---------------------------------------------------------------------------------------------------------

_KINDS = {"view": "line", "click": "file", "purchase": "mr", "signup": "line", "error": "else"}


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, issue): an event as the JSON of a finding. Scores are events' own numbers, often out of bounds; every
    third is a text, every fifth a real number; some are of unknown scope."""
    e = _read(spark, sf_dir, "events")
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    score = F.when(i % 3 == 0, F.concat(F.lit('" '), k, F.lit(' "'))).when(i % 5 == 0, F.concat(k, F.lit(".5"))).when(i % 7 == 0, F.concat(k, F.lit(".0"))).when(i % 11 == 0, F.lit("true")).otherwise(k)
    scope = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("event_type")]
    path = F.when(i % 4 == 0, F.lit("null")).when(i % 4 == 1, F.lit('""')).otherwise(F.lit('"src/a.py"'))
    anchor = F.when(i % 13 == 0, F.lit("null")).when(i % 13 == 1, F.lit("5")).otherwise(F.lit('"x = 1"'))
    issue = F.concat(F.lit('{"scope":"'), scope, F.lit('","severity_score":'), score, F.lit(',"confidence_score":5,"problem_type":"bug","comment":"c","file_path":'), path, F.lit(',"anchor_text":'), anchor, F.lit(',"more":[]}'))
    return e.select("event_id", "user_id", issue.alias("issue"))


_ISSUES_SQL = """
e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'line' WHEN 'click' THEN 'file' WHEN 'purchase' THEN 'mr' WHEN 'signup' THEN 'line' ELSE 'else' END AS scope, json_extract_string(props, '$.k')::INT AS k FROM events),
i AS (SELECT event_id, user_id, scope, CASE WHEN event_id % 3 = 0 THEN k WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN k WHEN event_id % 11 = 0 THEN 1 ELSE k END AS severity_score,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'src/a.py' END AS file_path, CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'x = 1' END AS anchor_text, event_id % 13 = 1 AS bad_anchor FROM e),
v AS (SELECT *, CASE WHEN scope = 'else' THEN 'scope' WHEN severity_score IS NULL OR severity_score NOT BETWEEN 1 AND 10 THEN 'severity_score' WHEN bad_anchor THEN 'anchor_text' END AS reject_reason FROM i)
"""
_SCOPE_SQL = "CASE WHEN scope = 'line' AND coalesce(file_path, '') <> '' AND coalesce(anchor_text, '') <> '' THEN 'line' WHEN scope IN ('line', 'file') AND coalesce(file_path, '') <> '' THEN 'file' ELSE 'mr' END"


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.validate(raw_issues(spark, sf_dir).withColumn("issue", F.parse_json("issue")))


def q_validate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("event_id", "scope", "severity_score", "file_path", "anchor_text", "reject_reason")


def q_normalize_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.normal_scope(_validated(spark, sf_dir).filter("reject_reason IS NULL")).select("event_id", "scope", "file_path", "anchor_text")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, part, raw_response): a response for each user and ten of his events' numbers."""
    e = raw_issues(spark, sf_dir).withColumn("part", (F.col("event_id") / 40).cast("bigint"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "issue"))), lambda x: x["issue"]), ",")  # 40 events at most
    return e.groupBy("user_id", "part").agg(F.concat(F.lit('{"issues":['), listed, F.lit("]}")).alias("raw_response"))


def q_response_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.response_validity(responses(spark, sf_dir), ["user_id", "part"])


def q_issue_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issues.validate(issues.issues_of(responses(spark, sf_dir), ["user_id", "part"]))
    return issues.all_or_nothing(rows, ["user_id", "part"]).select("user_id", "part", "issue_pos", "scope", "severity_score")


def q_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    channel, message, n = F.when(F.col("event_id") % 10 == 0, "").otherwise("c"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")), F.when(k > 2, k)
    return e.select("event_id", issues.request_reasons(channel, message, n).alias("reason"), issues.model_answer_error(k % 3, channel).alias("answer_error"))


# ---- 5: routing ----------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review, file_pos, new_path, old_path, diff): documents of a source as files of a review; copies share a path, by their size."""
    d = synthetic_diffs(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    path = F.when(F.col("n_chars") % 10 != 0, F.concat(F.lit("src/"), F.col("n_chars").cast("string")))
    return d.select(F.col("source").alias("review"), F.col("doc_id").alias("file_pos"), path.alias("new_path"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("old/"), F.col("doc_id").cast("string"))).otherwise("").alias("old_path"), "diff")


_FILES_SQL = """files AS (SELECT source AS review, d.doc_id AS file_pos, CASE WHEN n_chars % 10 <> 0 THEN 'src/' || n_chars END AS new_path, CASE WHEN d.doc_id % 3 > 0 THEN 'old/' || d.doc_id ELSE '' END AS old_path FROM documents d),
first_files AS (SELECT review, new_path, min(file_pos) AS file_pos, arg_min(old_path, file_pos) AS old_path FROM files WHERE new_path IS NOT NULL GROUP BY ALL)"""


def q_file_diff_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.first_files(files(spark, sf_dir).drop("diff"), ["review"]).select("review", "new_path", "file_pos", "old_path")


def q_old_path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("source").alias("review"), "doc_id", F.concat(F.lit("src/"), F.col("n_chars").cast("string")).alias("file_path"))
    out = publish.with_file(d, files(spark, sf_dir), ["review"])
    return out.select("doc_id", publish.old_path_of(F.col("file_path"), F.col("old_path")).alias("old_path"), F.col("new_path").isNotNull().alias("found"))


def normal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings() as normal findings of one review per document."""
    f = findings(spark, sf_dir).withColumn("scope", F.when(F.col("issue_pos") == 6, "mr").otherwise("line"))
    f = f.withColumns({"severity_score": F.col("issue_pos") + 1, "confidence_score": F.lit(5), "problem_type": F.lit("bug"), "comment": F.lit("c")})
    return issues.normal_scope(f)


def q_publication_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = normal_findings(spark, sf_dir)
    own = synthetic_diffs(spark, sf_dir).select("doc_id", F.lit(0).alias("file_pos"), F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("new_path"), F.lit("").alias("old_path"), "diff")
    plan = publish.publication_plan(f.drop("new_path", "diff"), own, ["doc_id"])
    return plan.select("doc_id", "issue_pos", "scope", "publication_mode", "new_line", "old_path", "fallback_reason", "body")


_PLAN_SQL = f"""{_LOCATE_SQL},
plan AS (SELECT f.doc_id, f.issue_pos, f.file_path, f.anchor_text, r.new_line, r.reason,
  CASE WHEN f.issue_pos = 6 THEN 'mr' WHEN f.issue_pos = 5 OR f.anchor_text = '' THEN 'file' ELSE 'line' END AS scope FROM findings f JOIN results r USING (doc_id, issue_pos)),
modes AS (SELECT *, CASE WHEN scope <> 'line' THEN 'mr_note' WHEN new_line IS NULL THEN 'mr_note_fallback' ELSE 'inline' END AS publication_mode FROM plan),
why AS (SELECT *, CASE WHEN publication_mode = 'mr_note_fallback' THEN CASE WHEN file_path = 'other' THEN '{publish.NO_FILE}' ELSE reason END END AS fallback_reason FROM modes)
SELECT doc_id, issue_pos, scope, publication_mode, CASE WHEN publication_mode = 'inline' THEN new_line END AS new_line, CASE WHEN publication_mode = 'inline' THEN file_path END AS old_path, fallback_reason,
  'AI review: bug, severity ' || (issue_pos + 1) || '/10, confidence 5/10' || chr(10) || chr(10) || CASE WHEN scope <> 'mr' THEN 'File: `' || file_path || '`' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN scope = 'line' THEN 'Anchor: `' || anchor_text || '`' || chr(10) || chr(10) ELSE '' END || 'c' || coalesce(chr(10) || chr(10) || 'Publication fallback: ' || fallback_reason, '') AS body
FROM why"""


def q_note_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = issues.normal_scope(_validated(spark, sf_dir).filter("reject_reason IS NULL"))
    return ok.select("event_id", publish.note_body(*[F.col(c) for c in ("scope", "problem_type", "severity_score", "confidence_score", "comment", "file_path", "anchor_text")]).alias("body"))


def q_inline_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    one = lambda s: F.struct(*[F.concat(F.lit(f"{s}{x}-"), F.col("event_id").cast("string")).alias(f"{x}_commit_sha") for x in ("base", "start", "head")])
    version = housekeeping.first_version(F.array(one("a"), one("b")))
    fields = publish.inline_position(F.col("event_type"), version, F.lit("old"), F.lit("new"), F.col("event_id"))
    return e.select("event_id", F.array_join(F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(k, F.lit("="), F.element_at(fields, k))), ";").alias("fields"))


def q_plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses all the way to a plan: every user's responses against a review of one small diff."""
    r = responses(spark, sf_dir)
    diff = F.array(F.struct(F.lit("").alias("old_path"), F.lit("src/a.py").alias("new_path"), F.lit("@@ -1 +1,3 @@\n+y = 2\n+x  =  1\n ctx").alias("diff")))
    plan = plan_review(r, r.select("user_id", "part", diff.alias("diffs")), ["user_id", "part"])
    return plan.select("user_id", "part", "issue_pos", "scope", "publication_mode", "new_line")


# ---- 6 and 7: documents and projections ----------------------------------------------------------------------------------


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, tree): a conversation as a document, a paragraph for each turn; a turn's lines are texts with hard breaks."""
    c = _read(spark, sf_dir, "conversations")
    text = lambda x: F.concat(F.lit('{"type":"text","text":'), F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2), F.lit("}"))
    inner = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), text), ',{"type":"hardBreak"},')
    turn = F.concat(F.lit('{"type":"paragraph","content":['), inner, F.lit("]}"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", turn.alias("node")))).alias("t"))
    return turns.select("conv_id", F.concat(F.lit('{"type":"doc","content":['), F.array_join(F.transform("t", lambda x: x["node"]), ","), F.lit("]}")).alias("tree"))


def q_flatten_rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir).select("conv_id", documents.flatten("tree").alias("description"))


def raw_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a tracker's tasks."""
    e = _read(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    who = F.array(F.struct(F.concat(F.lit("a"), i.cast("string")).alias("accountId"), F.when(i % 2 == 0, F.col("event_type")).alias("displayName"), F.when(i % 3 == 0, F.lit("m")).alias("emailAddress"), F.when(i % 5 > 0, k > 50).alias("active")))
    fields = F.struct(F.when(k > 10, F.col("event_type")).alias("summary"), F.struct(F.when(k > 20, F.lit("Open")).alias("name")).alias("status"), F.when(k > 30, F.lit("http://h/1")).alias(projections.MR_URL), F.when(k > 40, who).alias(projections.REVIEWERS), F.when(k > 50, F.struct(F.lit("Bug").alias("value"))).alias(projections.TASK_TYPE))
    return e.select(F.concat(F.lit("T-"), i.cast("string")).alias("requested_key"), F.when(i % 2 == 1, F.concat(F.lit("K-"), i.cast("string"))).alias("key"), fields.alias("fields"))


def _flat_reviewers(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda r: F.concat_ws("|", r["account_id"], r["display_name"], F.coalesce(r["email"], F.lit("-")), r["active"].cast("string"))), ";")


def q_task_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = projections.task(raw_tasks(spark, sf_dir), F.lit(""))
    return t.select("id", "type", "title", "description", "status", "mr_url", F.size("reviewers").cast("int").alias("n_reviewers"))


def q_reviewers_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.task(raw_tasks(spark, sf_dir), F.lit("")).select("id", _flat_reviewers(F.col("reviewers")).alias("reviewers"))


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    author = F.when(F.col("doc_id") % 3 > 0, F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("username"), F.col("source").alias("name"), F.lit(None).cast("string").alias("web_url")))
    one = F.struct(F.lit("").alias("old_path"), F.col("source").alias("new_path"), F.lit("@@ +1 @@\n+a").alias("diff"))
    return d.select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("iid"), F.when(F.col("n_chars") > 500, F.col("source")).alias("title"), F.lit(None).cast("string").alias("description"), author.alias("author"), F.lit("2024-01-01").alias("created_at"), F.col("lang").alias("source_branch"), F.lit("main").alias("target_branch"), F.array(one, one).alias("diffs"))


def q_mr_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = projections.merge_request_answer(projections.merge_request(raw_requests(spark, sf_dir), diffs.unified_diff_text(F.col("diffs"))))
    return m.select("id", "iid", "title", "description", F.col("author.id").alias("author_id"), F.col("author.username").alias("username"), F.col("author.name").alias("name"), "created_at", "source_branch", "target_branch", "diff")


def q_prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    own = {"id": F.col("doc_id").cast("string"), "type": F.col("lang"), "title": F.when(F.col("n_chars") > 500, F.col("source")), "description": F.lit("d")}
    return d.select("doc_id", projections.prompt(F.lit("context"), own, {"title": F.lit("t"), "description": F.lit(None).cast("string"), "diff": F.col("text")}).alias("prompt"))


def q_review_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests name a task and a merge request, of which some are missing; the context file is that of the target branch."""
    e = _read(spark, sf_dir, "events").select(F.concat(F.lit("K-"), F.col("event_id").cast("string")).alias("issue_key"), F.col("user_id").alias("mr_iid"))
    tasks = projections.task_info(projections.task(raw_tasks(spark, sf_dir), F.lit("")))
    m = projections.merge_request(raw_requests(spark, sf_dir), F.lit(""))
    context = spark.createDataFrame([("AGENT.md", "main", "ctx"), ("AGENT.md", "dev", "other"), ("README.md", "main", "no")], "path string, ref string, content string")
    out = projections.review_inputs(e, tasks, m, context, "AGENT.md")
    return out.select("issue_key", "mr_iid", "task_title", "mr_title", "agent_context")


def q_discussion_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    one = F.struct(F.col("event_id").alias("id"), F.when(k > 50, F.col("event_type")).alias("body"), F.lit(None).cast("string").alias("web_url"), F.when(k > 10, F.col("user_id") % 3).alias("noteable_iid"))
    notes = F.when(k % 4 == 0, F.array().cast(f"array<{'struct<id:bigint,body:string,web_url:string,noteable_iid:bigint>'}>")).when(k % 4 == 1, F.array(one, one)).otherwise(F.array(one))
    d, n = projections.discussion(notes, F.lit("http://h/1")), projections.note(F.col("event_id"), notes, F.lit("sent"))
    return e.select("event_id", d["notes_count"].cast("int").alias("notes_count"), d["web_url"].alias("web_url"), n["id"].alias("note_id"), n["body"].alias("note_body"))


def q_outer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of chat, model check, consultation and health, and the path of the context file."""
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    post = F.struct(F.col("event_id").cast("string").alias("id"), F.when(k > 50, "c").alias("channel_id"), F.when(k > 70, F.col("event_type")).alias("message"), F.lit(None).cast("string").alias("user_id"), F.col("event_id").alias("create_at"))
    p = projections.chat_post(post, F.lit("asked"), F.lit("said"))
    m = projections.model_check("m", F.col("event_type"), F.lit("works"))
    c = projections.consultation(F.col("event_type"))
    return e.select("event_id", p["channel_id"].alias("channel_id"), p["message"].alias("message"), p["create_at"].alias("create_at"), m["ok"].alias("ok"), m["input"].alias("input"), F.size(c["sources"]).cast("int").alias("n_sources"), c["question"].alias("question"), projections.health()["status"].alias("status"), projections.context_path(F.when(k % 3 == 0, "").when(k % 3 == 1, "x.md")).alias("context_path"))


# ---- 8: housekeeping -----------------------------------------------------------------------------------------------------


def _log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("app.log."), day)).otherwise(F.concat(F.lit("app."), day, F.lit(".log")))
    return o.select(F.col("o_orderpriority").alias("folder"), name.alias("name")).distinct()


_NAMES_SQL = "names AS (SELECT DISTINCT o_orderpriority AS folder, CASE WHEN o_orderkey % 10 = 0 THEN 'app.log.' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'app.' || strftime(o_orderdate, '%Y-%m-%d') || '.log' END AS name FROM orders)"


def q_retention_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = _log_names(spark, sf_dir).filter(housekeeping.is_dated(F.col("name"), "app", ".log"))
    return housekeeping.to_delete(dated, ["folder"], 30)


def q_rotate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _log_names(spark, sf_dir)
    return names.select("folder", "name", F.when(housekeeping.is_dated(F.col("name"), "app", ".log"), F.col("name")).otherwise(housekeeping.rotated_name(F.col("name"))).alias("rotated"))


def q_status_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k > 5, F.lit(190) + k * 4)
    return _read(spark, sf_dir, "events").select("event_id", status.alias("status"), error_status(status).alias("error"))


def q_paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as items of pages of two; every fifth page names no next."""
    l = _read(spark, sf_dir, "lineitem").withColumn("page", ((F.col("l_linenumber") + 1) / 2).cast("int"))
    pages = l.groupBy("l_orderkey", "page").agg(F.array_sort(F.collect_list(F.col("l_linenumber"))).alias("items"))  # two at most
    pages = pages.withColumn("next_page", F.when((F.col("l_orderkey") + F.col("page")) % 5 > 0, F.col("page") + 1))
    return housekeeping.in_page_order(pages, ["l_orderkey"])


def q_url_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", X.percent_encode(F.concat("url", F.lit(" *~é+"))).alias("quoted"), X.without_last_slashes("url").alias("bare"))


CANNED = f"{answer.__module__}:{answer.__name__}"


def q_rest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of which the number of pages isn't known."""
    spark.dataSource.register(rest.PagedRest)
    items = spark.read.format("paged_rest").options(url="http://h/diffs", fetch=CANNED).load()
    return items.select("page", "pos", F.get_json_object("item", "$.new_path").alias("new_path"), "status", "error")


def q_rest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a filter names: each is asked for alone."""
    spark.dataSource.register(rest.KeyedRest)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("keyed_rest").options(url="http://h/merge_requests/{key}", fetch=CANNED).load()
    return found.filter(F.col("key").isin(*[str(i) for i in range(1, 251)])).select("key", F.get_json_object("item", "$.title").alias("title"), "status", "error")


def q_rest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, versions, raw files and tasks by keys that are rows."""
    n, project = F.col("event_id"), F.lit("g/p")
    paths = {"request": sinks.request_path(project, n), "versions": sinks.request_path(project, n, "/versions"), "task": sinks.task_path(F.concat(F.lit("K-"), n.cast("string")))}
    paths["raw"] = sinks.raw_file_path(project, F.concat(F.lit("src/a b"), n.cast("string")), F.col("event_type"))
    kind = F.element_at(F.array(*[F.lit(k) for k in paths]), (n % 4 + 1).cast("int"))
    path = F.coalesce(*[F.when(kind == k, p) for k, p in paths.items()])
    got = rest.answers(_read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), path.alias("path")), "http://h", fetch=CANNED)
    version = housekeeping.first_version(F.from_json("answer", f"array<struct<{captured.VERSION}>>"))["head_commit_sha"]
    request, task = F.from_json("answer", captured.MERGE_REQUEST), F.from_json("answer", f"{captured.TASK[:-1]},n_fields:int>")
    told = F.when(F.col("kind") == "versions", version).when(F.col("kind") == "request", request["title"]).when(F.col("kind") == "raw", F.col("answer"))
    return got.select("event_id", "kind", "status", "error_status", "error", told.otherwise(F.concat_ws("/", task["fields"]["summary"], task["fields"]["n_fields"].cast("string"))).alias("told"))


def q_publish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each post: a discussion, a note, or a failure that is its row's alone."""
    mode = F.when(F.col("event_id") % 3 == 0, publish.INLINE).otherwise(publish.NOTE)
    plan = _read(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("mr_iid"), mode.alias("publication_mode"), F.concat(F.lit("a & b "), "event_type").alias("body"))
    out = sinks.published(plan, "g/p", "http://h", F.lit("http://h/1"), ["event_id"], fetch=CANNED)
    d, n = F.col("discussion"), F.col("note")
    return out.select("event_id", "publication_mode", "publish_error", F.coalesce(d["id"], n["id"]).alias("id"), d["notes_count"].alias("notes_count"), d["individual_note"].alias("individual_note"), F.coalesce(d["web_url"], n["web_url"]).alias("web_url"), n["body"].alias("note_body"))


def q_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    return model.respond(prompts, provider, "system").select("doc_id", F.get_json_object("raw_response", "$.limit").cast("int").alias("max_tokens"), F.get_json_object("raw_response", "$.strict").alias("strict"), "error")


def q_model_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = model.response_format()["json_schema"]
    item = form["schema"]["properties"]["issues"]["items"]
    return spark.createDataFrame([(form["name"], form["strict"], p, p in item["required"]) for p in item["properties"]], "name string, strict boolean, property string, required boolean")


def q_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = settings.load({n: n.lower() for n in settings.REQUIRED} | {"LOG_LEVEL": "warning", "LOG_BACKUP_DAYS": "7"})
    return spark.createDataFrame([(k, str(v), isinstance(v, int)) for k, v in loaded.items()], "name string, value string, whole boolean")


def q_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's id, its own or a new one, and its duration."""
    brought = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r-"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 0, "")
    e = _read(spark, sf_dir, "events").select("event_id", request_id(brought).alias("i"), duration_ms(F.col("event_id") / 1024).alias("duration_ms"))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("i")).alias("request_id"), F.length("i").alias("id_length"), "duration_ms")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_CANNED_SQL = """CASE WHEN {n} % 7 = 0 THEN 404 WHEN {n} % 11 = 0 THEN 403 WHEN {n} % 13 = 0 THEN 500 WHEN {n} % 17 = 0 THEN NULL ELSE 200 END AS status,
    CASE WHEN {n} % 7 = 0 THEN 404 WHEN {n} % 11 = 0 THEN 403 WHEN {n} % 13 = 0 OR {n} % 17 = 0 THEN 502 END AS e, CASE WHEN {n} % 7 > 0 AND {n} % 11 > 0 AND {n} % 13 > 0 AND {n} % 17 = 0 THEN 'refused' ELSE 'no ' || {n} END AS b"""

ORACLE_SQL = {
    "locate_passages": f"""WITH anchors AS (SELECT item_id AS id, text AS t FROM benchmark), {_FORMS},
        l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM (SELECT doc_id, {_lines("text")} AS p FROM documents)), n AS (SELECT doc_id, i, {_norm("x")} AS n, {_compact("x")} AS c FROM l),
        hits AS (SELECT DISTINCT n.doc_id, f.id AS item_id, n.i FROM n JOIN forms f ON {_HIT.format(n="n.n", c="n.c")})
        SELECT doc_id, item_id, count(*)::INT AS n_lines, min(i)::INT AS first_line, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM hits GROUP BY ALL""",
    "normalize_text": f"SELECT doc_id, {_norm('text')} AS normalized FROM documents",
    "compact_text": f"SELECT doc_id, {_compact('text')} AS compacted FROM documents",
    "soft_normalize": f"SELECT doc_id, {_soft(_escaped('text'))} AS softened FROM documents",
    "anchor_variants": f"""WITH a AS (SELECT item_id, {_escaped("text")} AS t FROM benchmark), p AS (SELECT item_id, unnest(list_concat({_lines("t")}, [t])) AS x FROM a),
        s AS (SELECT item_id, regexp_replace(x, '^{X.SPACES}+|{X.SPACES}+$', '', 'g') AS v FROM p) SELECT item_id, v AS variant FROM s WHERE v <> '' UNION SELECT item_id, {_soft("v")} FROM s WHERE {_soft("v")} <> ''""",
    "split_lines": f"SELECT doc_id, unnest(range(len(p)))::INT AS pos, unnest(p) AS line FROM (SELECT doc_id, {_lines('text')} AS p FROM documents)",
    "added_lines": f"WITH {_NUMBERED} SELECT * FROM added",
    "hunk_numbering": f"WITH {_NUMBERED} SELECT doc_id, hunk::INT AS hunk, min(new_line) AS first_line, count(*) AS lines, count(*) FILTER (WHERE a) AS added FROM numbered WHERE new_line IS NOT NULL GROUP BY doc_id, hunk",
    "unified_diff_text": f"""WITH {_NUMBERED}, h AS (SELECT doc_id, diff, chr(10) AS n, 'src/' || doc_id AS p FROM texts), b AS (SELECT *, 'diff --git a/' || p || ' b/' || p || n || '--- a/' || p || n || '+++ b/' || p || n || diff AS one,
        'diff --git a/unknown b/unknown' || n || '--- a/unknown' || n || '+++ b/unknown' || n || diff AS none FROM h) SELECT doc_id, one || n || one || n || none AS unified FROM b""",
    "context_window": f"""WITH {_NUMBERED}, w AS (SELECT doc_id, raw_index::INT AS raw_index, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY raw_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS b,
        coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY raw_index ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), '') AS f FROM raw) SELECT doc_id, raw_index, md5(b) AS before, md5(f) AS after FROM w SEMI JOIN added USING (doc_id, raw_index)""",
    "locate_line": f"{_LOCATE_SQL} SELECT doc_id, issue_pos, new_line IS NOT NULL AS ok, new_line, reason FROM results",
    "validate_issues": f"WITH {_ISSUES_SQL} SELECT event_id, scope, severity_score, file_path, anchor_text, reject_reason FROM v",
    "normalize_scope": f"WITH {_ISSUES_SQL}, s AS (SELECT event_id, {_SCOPE_SQL} AS n, file_path, anchor_text FROM v WHERE reject_reason IS NULL) SELECT event_id, n AS scope, CASE WHEN n <> 'mr' THEN file_path END AS file_path, CASE WHEN n = 'line' THEN anchor_text END AS anchor_text FROM s",
    "response_all_or_nothing": f"WITH {_ISSUES_SQL} SELECT user_id, event_id // 40 AS part, bool_and(reject_reason IS NULL) AS valid, count(*)::INT AS n_issues FROM v GROUP BY ALL",
    "issue_unnest": f"""WITH {_ISSUES_SQL}, o AS (SELECT *, event_id // 40 AS part FROM v), g AS (SELECT *, bool_and(reject_reason IS NULL) OVER (PARTITION BY user_id, part) AS good, (row_number() OVER (PARTITION BY user_id, part ORDER BY event_id) - 1)::INT AS issue_pos FROM o)
        SELECT user_id, part, issue_pos, scope, severity_score FROM g WHERE good""",
    "request_validation": """WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'channel_id' WHEN event_id % 7 = 0 THEN 'message' WHEN k > 50 THEN 'max_results' END AS reason,
        CASE WHEN k % 3 < 1 THEN 'empty completion' WHEN event_id % 10 = 0 THEN 'empty content' END AS answer_error FROM e""",
    "file_diff_first_match": f"WITH {_FILES_SQL} SELECT review, new_path, file_pos, old_path FROM first_files",
    "old_path_lookup": f"WITH {_FILES_SQL}, d AS (SELECT source AS review, doc_id, 'src/' || n_chars AS file_path FROM documents) SELECT doc_id, CASE WHEN coalesce(old_path, '') <> '' THEN old_path ELSE file_path END AS old_path, new_path IS NOT NULL AS found FROM d LEFT JOIN first_files f ON d.review = f.review AND d.file_path = f.new_path",
    "publication_plan": _PLAN_SQL,
    "note_body": f"""WITH {_ISSUES_SQL}, s AS (SELECT event_id, severity_score, {_SCOPE_SQL} AS n, file_path, anchor_text FROM v WHERE reject_reason IS NULL) SELECT event_id, 'AI review: bug, severity ' || severity_score || '/10, confidence 5/10' || chr(10) || chr(10)
        || CASE WHEN n <> 'mr' THEN 'File: `' || file_path || '`' || chr(10) || chr(10) ELSE '' END || CASE WHEN n = 'line' THEN 'Anchor: `' || anchor_text || '`' || chr(10) || chr(10) ELSE '' END || 'c' AS body FROM s""",
    "inline_position": "SELECT event_id, 'body=' || event_type || ';position[base_sha]=abase-' || event_id || ';position[head_sha]=ahead-' || event_id || ';position[new_line]=' || event_id || ';position[new_path]=new;position[old_path]=old;position[position_type]=text;position[start_sha]=astart-' || event_id AS fields FROM events",
    "plan_review": f"""WITH {_ISSUES_SQL}, o AS (SELECT *, event_id // 40 AS part FROM v), g AS (SELECT *, bool_and(reject_reason IS NULL) OVER (PARTITION BY user_id, part) AS good, (row_number() OVER (PARTITION BY user_id, part ORDER BY event_id) - 1)::INT AS issue_pos FROM o),
        s AS (SELECT user_id, part, issue_pos, {_SCOPE_SQL} AS scope FROM g WHERE good) SELECT user_id, part, issue_pos, scope, CASE WHEN scope = 'line' THEN 'inline' ELSE 'mr_note' END AS publication_mode, CASE WHEN scope = 'line' THEN 2 END AS new_line FROM s""",
    "flatten_rich_text": f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations), j AS (SELECT conv_id, string_agg(x || chr(10), '' ORDER BY turn) AS raw FROM t GROUP BY conv_id)
        SELECT conv_id, array_to_string(list_transform(list_filter({_lines("raw")}, lambda l: regexp_replace(l, '{X.SPACES}+', '', 'g') <> ''), lambda l: regexp_replace(l, '{X.SPACES}+$', '')), chr(10)) AS description FROM j""",
    "task_projection": """WITH e AS (SELECT event_id AS i, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT CASE WHEN i % 2 = 1 THEN 'K-' ELSE 'T-' END || i AS id, CASE WHEN k > 50 THEN 'Bug' ELSE '' END AS type, CASE WHEN k > 10 THEN t ELSE '' END AS title, '' AS description,
        CASE WHEN k > 20 THEN 'Open' ELSE '' END AS status, CASE WHEN k > 30 THEN 'http://h/1' END AS mr_url, CASE WHEN k > 40 THEN 1 ELSE 0 END::INT AS n_reviewers FROM e""",
    "reviewers_transform": """WITH e AS (SELECT event_id AS i, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT CASE WHEN i % 2 = 1 THEN 'K-' ELSE 'T-' END || i AS id,
        CASE WHEN k > 40 THEN 'a' || i || '|' || CASE WHEN i % 2 = 0 THEN t ELSE '' END || '|' || CASE WHEN i % 3 = 0 THEN 'm' ELSE '-' END || '|' || CASE WHEN i % 5 > 0 AND k > 50 THEN 'true' ELSE 'false' END ELSE '' END AS reviewers FROM e""",
    "mr_projection": """WITH h AS (SELECT *, 'diff --git a/' || source || ' b/' || source || chr(10) || '--- a/' || source || chr(10) || '+++ b/' || source || chr(10) || '@@ +1 @@' || chr(10) || '+a' AS one FROM documents)
        SELECT doc_id AS id, doc_id + 1 AS iid, CASE WHEN n_chars > 500 THEN source ELSE '' END AS title, '' AS description, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS author_id, CASE WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS username,
        CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS name, '2024-01-01' AS created_at, lang AS source_branch, 'main' AS target_branch, one || chr(10) || one AS diff FROM h""",
    "prompt_build": """SELECT doc_id, 'PROJECT CONTEXT:' || n || 'context' || n || n || 'TASK:' || n || 'ID: ' || doc_id || n || 'Type: ' || lang || n || 'Title: ' || CASE WHEN n_chars > 500 THEN source ELSE 'None' END || n || 'Description:' || n || 'd' || n || n
        || 'MERGE REQUEST:' || n || 'Title: t' || n || 'Description:' || n || 'None' || n || n || 'DIFF:' || n || text || n AS prompt FROM (SELECT *, chr(10) AS n FROM documents)""",
    "review_inputs": """SELECT 'K-' || e.event_id AS issue_key, e.user_id AS mr_iid, CASE WHEN json_extract_string(props, '$.k')::INT > 10 THEN event_type ELSE '' END AS task_title, CASE WHEN n_chars > 500 THEN source ELSE '' END AS mr_title, 'ctx' AS agent_context
        FROM events e JOIN documents d ON d.doc_id + 1 = e.user_id WHERE event_id % 2 = 1""",
    "discussion_projection": """WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_id, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::INT AS notes_count,
        CASE WHEN k % 4 = 0 OR k <= 10 THEN NULL WHEN user_id % 3 = 0 THEN '0' ELSE 'http://h/1#note_' || event_id END AS web_url, event_id::VARCHAR AS note_id, CASE WHEN k % 4 > 0 AND k > 50 THEN event_type ELSE 'sent' END AS note_body FROM e""",
    "outer_answers": """WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_id, CASE WHEN k > 50 THEN 'c' ELSE 'asked' END AS channel_id, CASE WHEN k > 70 THEN event_type ELSE 'said' END AS message, event_id AS create_at, true AS ok, event_type AS input, 0 AS n_sources, event_type AS question, 'ok' AS status,
        CASE WHEN k % 3 = 1 THEN 'x.md' ELSE 'AGENT.md' END AS context_path FROM e""",
    "retention_top_n": f"WITH {_NAMES_SQL}, r AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY name DESC) AS n FROM names WHERE regexp_matches(name, '^app\\.[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\.log$')) SELECT folder, name FROM r WHERE n > 30",
    "rotate_name": f"WITH {_NAMES_SQL} SELECT folder, name, CASE WHEN starts_with(name, 'app.log.') THEN 'app.' || substr(name, 9) || '.log' ELSE name END AS rotated FROM names",
    "status_mapping": "WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events), s AS (SELECT event_id, CASE WHEN k > 5 THEN 190 + k * 4 END AS status FROM e) SELECT event_id, status, CASE WHEN status IS NULL THEN 502 WHEN status IN (401, 403, 404) THEN status WHEN status >= 400 THEN 502 END AS error FROM s",
    "paged_scan": """WITH l AS (SELECT l_orderkey, l_linenumber, ((l_linenumber + 1) // 2)::INT AS page FROM lineitem), p AS (SELECT l_orderkey, page, list_sort(list(l_linenumber)) AS items FROM l GROUP BY ALL),
        e AS (SELECT l_orderkey, min(page) FILTER (WHERE (l_orderkey + page) % 5 = 0) AS last FROM p GROUP BY l_orderkey) SELECT l_orderkey, page, unnest(range(len(items)))::INT AS pos, unnest(items) AS item FROM p JOIN e USING (l_orderkey) WHERE last IS NULL OR page <= last""",
    "url_quote": "SELECT page_id, url_encode(url || ' *~é+') AS quoted, rtrim(url, '/') AS bare FROM pages",
    "rest_scan": "SELECT (i // 100 + 1)::INT AS page, (i % 100)::INT AS pos, 'src/' || i AS new_path, 200 AS status, NULL::VARCHAR AS error FROM range(250) r(i)",
    "rest_lookup": f"SELECT i::VARCHAR AS key, CASE WHEN e IS NULL THEN 't' || i END AS title, status, e || ': ' || b AS error FROM (SELECT i, {_CANNED_SQL.format(n='i')} FROM range(1, 251) r(i))",
    "rest_answers": f"""SELECT event_id, kind, status, e AS error_status, e || ': ' || b AS error, CASE WHEN kind = 'task' THEN CASE WHEN e IS NULL THEN 's' || event_id || '/6' ELSE '' END WHEN e IS NOT NULL THEN NULL WHEN kind = 'request' THEN 't' || event_id
        WHEN kind = 'versions' THEN CASE WHEN event_id % 3 > 0 THEN 'h' || event_id || '-0' END ELSE 'src/a b' || event_id || '/raw@' || event_type END AS told FROM (SELECT event_id, event_type, ['request', 'versions', 'task', 'raw'][event_id % 4 + 1] AS kind, {_CANNED_SQL.format(n='event_id')} FROM events)""",
    "publish_outcomes": f"""SELECT event_id, CASE WHEN e IS NOT NULL THEN 'failed' WHEN inline THEN 'inline' ELSE 'mr_note' END AS publication_mode, e || ': ' || b AS publish_error, CASE WHEN e IS NULL THEN 'd' || event_id END AS id, CASE WHEN e IS NULL AND inline THEN CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END END::INT AS notes_count,
        CASE WHEN e IS NULL AND inline THEN event_id % 2 = 0 END AS individual_note, CASE WHEN e IS NOT NULL OR event_id % 5 = 0 THEN NULL WHEN inline THEN '0' ELSE 'http://h/note/' || event_id END AS web_url,
        CASE WHEN e IS NOT NULL OR inline THEN NULL WHEN event_id % 5 = 0 THEN 'a & b ' || event_type ELSE upper('a & b ' || event_type) END AS note_body FROM (SELECT event_id, event_type, event_id % 3 = 0 AS inline, {_CANNED_SQL.format(n='event_id').replace("ELSE 200", "ELSE 201")} FROM events)""",
    "model_answers": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), e AS (SELECT *, CASE WHEN n > 700 AND n % 2 = 1 THEN '500: too long' WHEN n % 5 = 0 THEN '500: empty content' END AS error FROM d)
        SELECT doc_id, CASE WHEN error IS NULL THEN 5000 END AS max_tokens, CASE WHEN error IS NULL THEN 'true' END AS strict, error FROM e""",
    "model_schema": """SELECT 'structured_response_schema' AS name, true AS strict, p AS property, r AS required FROM (VALUES ('scope', true), ('severity_score', true), ('confidence_score', true), ('problem_type', true), ('comment', true),
        ('file_path', false), ('anchor_text', false), ('before_anchor', false), ('after_anchor', false)) t(p, r)""",
    "settings": """SELECT n AS name, coalesce(v, lower(n)) AS value, n = 'LOG_BACKUP_DAYS' AS whole FROM (VALUES ('MODEL_LLM', NULL), ('BASE_URL', NULL), ('OPENROUTER_API_KEY', NULL), ('GITLAB_URL', NULL), ('GITLAB_TOKEN', NULL), ('GITLAB_PROJECT_ID', NULL), ('JIRA_URL', NULL), ('JIRA_EMAIL', NULL), ('JIRA_API_TOKEN', NULL),
        ('MATTERMOST_URL', NULL), ('MATTERMOST_BOT_TOKEN', NULL), ('AGENT_CONTEXT_PATH', 'AGENT.md'), ('LOG_DIR', 'logs'), ('LOG_LEVEL', 'WARNING'), ('LOG_FILE_NAME', 'review.log'), ('LOG_BACKUP_DAYS', '7')) t(n, v)""",
    "request_log": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'r-' || event_id END AS request_id, CASE WHEN event_id % 2 = 0 THEN length('r-' || event_id) ELSE 36 END::INT AS id_length, round(event_id / 1024 * 1000, 2) AS duration_ms FROM events",
}
