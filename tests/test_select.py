import pytest

from seriesforge.functions.matchers import Matcher
from seriesforge.model import QueryError

from .load import storage

BASE = 'foo{bar="baz"} 1\nabc{def="ghi"} 1'
D1 = BASE + '\njkl{ext="doesntmatter1"} 1\njkl{ext="doesntmatter2"} 1'
D10 = 'foo{bar="baz"} 1\nabc{ext="internal"} 1'
OPTIONS = {"external": {"ext": "test", "rep": "1"}, "replica": ("rep",)}


def shown(df):
    return sorted(tuple(sorted((c[2:], v) for c, v in r.asDict().items() if c.startswith("l_") and v is not None)) for r in df.collect())


def test_select(spark):
    s = storage(spark, D1, **OPTIONS)
    name = "__name__"
    assert shown(s.select([])) == [((name, "abc"), ("def", "ghi"), ("ext", "test")), ((name, "foo"), ("bar", "baz"), ("ext", "test")), ((name, "jkl"), ("ext", "test"))]
    assert s.conflicts([]) and s.warnings.messages
    assert s.select([Matcher("ext", "!=", "test")]).count() == 0
    assert s.select([Matcher("ext", "=~", "doesntmatter.*")]).count() == 0
    assert shown(s.select([Matcher(name, "=", "foo")])) == [((name, "foo"), ("bar", "baz"), ("ext", "test"))]


def test_names(spark):
    s = storage(spark, BASE, **OPTIONS)
    names = lambda *m: [r[0] for r in s.label_names([Matcher(*x) for x in m]).collect()]
    assert names() == names(("ext", "=", "test")) == ["__name__", "bar", "def", "ext"]
    assert names(("ext", "!=", "test")) == names(("fizz", "=", "buzz")) == []
    assert names(("__name__", "=", "abc")) == ["__name__", "def", "ext"]


def test_values(spark):
    s = storage(spark, D10, **OPTIONS)

    def values(name, *m):
        s.warnings.messages.clear()
        return [r[0] for r in s.label_values(name, [Matcher(*x) for x in m]).collect()], bool(s.warnings.messages)

    assert values("bar") == (["baz"], False)
    assert values("ext", ("bar", "=", "baz")) == (["test"], False)
    assert values("ext", ("fizz", "=", "buzz")) == ([], False)
    assert values("ext", ("__name__", "=", "abc")) == (["test"], True)
    assert values("ext") == (["test"], True)
    assert values("rep") == ([], False)


def test_limits(spark):
    s = storage(spark, D1)
    assert s.series([], limit=2).count() == 2 and s.warnings.messages
    s.row_quota = 3
    with pytest.raises(QueryError, match="more than 3"):
        s.select([])
    assert s.select([Matcher("bar", "=", "baz")]).count() == 1


def test_merge_keeps_one_sample_per_time(spark):
    s = storage(spark, 'm{r="1"} 5 6\nm{r="2"} 7 _ 9', replica=("r",))
    assert sorted((r["ts_ms"], r["value"]) for r in s.select([]).collect()) == [(0, 5.0), (300_000, 6.0), (600_000, 9.0)]
