import re
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hunkwise.functions import text as X

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
ODD = ["a\r\nb\x0cc\n\nd\x1ce f\n", "", "\n", "  x   y　", "\x85z\x1f", 'say \\"hi\\" \\\\ \\. \\/ \\@', "a = b", "\\", '\\"', " ", "tab\tx\x0by"]


def python_soft(v: str) -> str:
    v = v.strip()
    for old, new in X.ESCAPES:
        v = v.replace(old, new)
    return " ".join(v.split())


def run(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column.alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_lines_are_python_lines(spark):
    assert run(spark, ODD, X.split_lines(F.col("x"))) == [v.splitlines() for v in ODD]


def test_every_python_space_is_a_space(spark):
    assert run(spark, [f"a{c}b" for c in SPACES], X.normalize(F.col("x"))) == ["a b"] * len(SPACES)
    assert len(SPACES) == 29


def test_normal_forms(spark):
    assert run(spark, ODD, X.normalize(F.col("x"))) == [" ".join(v.split()) for v in ODD]
    assert run(spark, ODD, X.soft(F.col("x"))) == [python_soft(v) for v in ODD]
    assert run(spark, ODD, X.compact(F.col("x"))) == [re.sub(r"\s+", "", python_soft(v)) for v in ODD]
    assert run(spark, ODD, X.strip(F.col("x"))) == [v.strip() for v in ODD]
    assert run(spark, ODD, X.rstrip(F.col("x"))) == [v.rstrip() for v in ODD]


def test_tiers(spark):
    pairs = [("a=b", "a = b", True), ('say \\"hi\\"', 'say "hi"', True), ("\\", '\\"', True), ("a b", "x a  b y", True), ("ab c", "a bd", False), ("  ", "x", False)]
    rows = spark.createDataFrame(pairs, "a string, l string, want boolean")
    got = rows.select("want", X.matches(X.forms(F.col("a")), X.normalize(F.col("l")), X.compact(F.col("l"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_percent_encoding(spark):
    values = ["a b/c*~é+%", "x?y=1&z", "", "日本"]
    assert run(spark, values, X.percent_encode(F.col("x"))) == [quote(v, safe="") for v in values]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\n\r\x0b\x1c\x85 \\\"'@./"), max_size=30), min_size=1, max_size=20))
def test_random_texts(spark, values):
    assert run(spark, values, X.split_lines(F.col("x"))) == [v.splitlines() for v in values]
    assert run(spark, values, X.soft(F.col("x"))) == [python_soft(v) for v in values]
