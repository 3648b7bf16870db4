import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.functions.matchers import Matcher, predicate
from seriesforge.model import QueryError

ROWS = [("1", "2", "a"), ("3", "4", "b"), ("7", "12", "c"), ("9", "22", "d"), ("0", "1", "e"), ("7", "1", "f"), ("7", "1", "g"), ("0", "1", "h")]


def found(spark, rows, *matchers):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, l_A string, l_B string, l_C string")
    return [r[0] for r in df.where(predicate([Matcher(*m) for m in matchers], ["A", "B", "C"])).orderBy("n").collect()]


@pytest.mark.parametrize(
    ("matchers", "expected"),
    [
        ([("A", "=", "7"), ("C", "=", "g")], [6]), ([("A", "=", "7")], [2, 5, 6]), ([("A", "=", "7"), ("B", "!=", "1")], [2]), ([("A", "=", "7"), ("C", "!=", "c")], [5, 6]),
        ([("A", "!=", "227")], [0, 1, 2, 3, 4, 5, 6, 7]), ([("C", "=~", "a|c|d")], [0, 2, 3]), ([("C", "!~", "a|c|d")], [1, 4, 5, 6, 7]), ([("C", "=~", "[a-c]")], [0, 1, 2]),
        ([("Z", "=", "")], list(range(8))), ([("Z", "=", "x")], []), ([("Z", "!=", "x")], list(range(8))), ([("Z", "=~", ".+")], []), ([("Z", "!~", ".+")], list(range(8))),
    ],
)
def test_rows(spark, matchers, expected):
    assert found(spark, ROWS, *matchers) == expected


def test_absent_is_empty(spark):
    rows = [("1", "5", None), ("2", "5", ""), ("3", "2", "foo")]
    assert found(spark, rows, ("C", "=", "")) == found(spark, rows, ("C", "=~", "")) == [0, 1]
    assert found(spark, rows, ("C", "!=", "")) == found(spark, rows, ("C", "=~", ".+")) == found(spark, rows, ("C", "!~", "")) == [2]
    assert found(spark, rows, ("C", "=~", "foo|")) == [0, 1, 2]
    assert found(spark, rows, ("C", "!=", "foo")) == found(spark, rows, ("C", "!~", "f.*")) == [0, 1]


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([("x", 1)], "l_A string, n int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda m: df.where(m.column(["A"]))._jdf.queryExecution().toString()
    assert "EqualTo(l_A,x)" in plan(Matcher("A", "=", "x"))
    assert "In(l_A, [x,y])" in plan(Matcher("A", "=~", "x|y"))
    assert "StringStartsWith(l_A,ab)" in plan(Matcher("A", "=~", "ab.*"))
    assert "Or(IsNull(l_A)" in plan(Matcher("A", "!=", "x"))


RE2 = [
    ("(?i)ABC", ["abc", "ABC", "aBc"], ["ab", "abcd"]), ("(?P<x>a+)(?<y>b)", ["aab", "ab"], ["a"]), ("a(?i)b|c", ["ab", "aB", "C", "c"], ["Ab"]), ("x(?:(?i)y|z)w", ["xYw", "xZw"], ["xyW"]),
    (r"\Qa.b\E+", ["a.b", "a.bb"], ["axb"]), ("[[:alpha:]_]+[[:digit:]]", ["ab_1"], ["ab", "1"]), (r"a\sb", ["a b", "a\tb"], ["a\x0bb", "ab"]), ("a$", ["a"], ["a\n"]), (r"[]a[]+", ["]a["], ["b"]),
    (r"\pL+", ["äb"], ["1"]), ("(?s-i:a.b)", ["a\nb"], ["A.b"]), (".*", ["", "a\nb"], []), (r"\++", ["++"], [""]),
]


@pytest.mark.parametrize(("pattern", "yes", "no"), RE2)
def test_re2_syntax(spark, pattern, yes, no):
    rows = [("1", "1", v) for v in [*yes, *no]]
    assert found(spark, rows, ("C", "=~", pattern)) == list(range(len(yes)))
    m = Matcher("C", "=~", pattern)
    assert all(m.matches(v) for v in yes) and not any(m.matches(v) for v in no)


def test_errors():
    for op, value in (("~", "x"), ("=~", "(a"), ("=~", "a)"), ("=~", r"(a)\1"), ("=~", "(?=a)"), ("=~", "a*+"), ("=~", "(?U)a"), ("=~", "[a"), ("=~", "(?P<x>a)(?P<x>b)")):
        with pytest.raises(QueryError):
            Matcher("a", op, value)


@settings(max_examples=25, deadline=None)
@given(st.sampled_from(["a", "b.*", "a|b", "", ".+", "x?", "a|", "[ab]+"]), st.lists(st.sampled_from(["", "a", "b", "ab", "bb", "x", None, "b\n"]), min_size=1, max_size=6))
def test_complement(spark, pattern, values):
    rows = [("1", "1", v) for v in values]
    hit, miss = found(spark, rows, ("C", "=~", pattern)), found(spark, rows, ("C", "!~", pattern))
    assert sorted(hit + miss) == list(range(len(values)))
    m = Matcher("C", "=~", pattern)
    assert hit == [i for i, v in enumerate(values) if m.matches(v or "")]
