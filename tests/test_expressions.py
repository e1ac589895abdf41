"""The predicate language: syntax, types and normal form."""

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from orrery.functions import timespan as ts
from orrery.functions.glob import glob, glob_regex, is_glob, matches, matches_value
from orrery.functions.times import parse_time
from orrery.plans import expressions as ex


def rows(spark, text, **bind):
    df = spark.createDataFrame([(i, float(i) / 2, "abc"[i % 3], None if i % 4 == 0 else i) for i in range(20)], "i long, f double, s string, n long")
    return [r["i"] for r in ex.predicate(text, ex.frame_resolver(df), bind).apply(df).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("i IN (1..7:3)", lambda i: i in (1, 4, 7)),
        ("i NOT IN (2, 3) AND i < 6", lambda i: i in (0, 1, 4, 5)),
        ("not (i < 5 or s = 'b')", lambda i: i >= 5 and i % 3 != 1),
        ("n = NULL", lambda i: i % 4 == 0),
        ("n != NULL AND i % 2 = 0", lambda i: i % 4 == 2),
        ("f * 2.0 - 1.0 > 15.5", lambda i: i > 16),
        ("i IN (:wanted)", lambda i: i in (3, 9)),
        ("GLOB(s, 'a*') AND -i < -10", lambda i: i % 3 == 0 and i > 10),
        ("i = 3 OR s = 'c' AND i < 6", lambda i: i == 3 or i in (2, 5)),
        ("", lambda i: True),
    ],
)
def test_predicates(spark, text, want):
    assert rows(spark, text, wanted=[3, 9]) == [i for i in range(20) if want(i)]


@pytest.mark.parametrize("text", ["i = ", "i = 's'", "i % 2.0 = 1", "(i", "nothere = 1", "f IN (1..3)", "i IN (:x)", "s < NULL", "-s = 1", "i i", "FOO(1) = 2"])
def test_errors(spark, text):
    with pytest.raises(ex.ExpressionError):
        rows(spark, text)


def test_division_by_zero_is_null(spark):
    assert rows(spark, "i / 0 = 1") == []


def test_implied_data_id_and_conflicts(spark):
    df = spark.range(3).select(F.col("id").alias("i"), F.col("id").alias("j"))
    made = ex.predicate("i = 1 AND NOT j != 2 AND (i = 1 OR j = 2)", ex.frame_resolver(df))
    assert made.implied_data_id() == {"i": 1}
    with pytest.raises(ex.ExpressionError):
        ex.predicate("i = 1 AND i = 2", ex.frame_resolver(df)).implied_data_id()


def test_spatial_overlap_below_or_is_refused(spark):
    df = spark.sql("SELECT 1L i, named_struct('kind', 'point', 'values', array(1D, 2D)) r")
    with pytest.raises(ex.ExpressionError):
        ex.predicate("r OVERLAPS CIRCLE(1, 2, 3) OR i = 1", ex.frame_resolver(df)).spatial()
    with pytest.raises(ex.ExpressionError):
        ex.predicate("NOT r OVERLAPS CIRCLE(1, 2, 3)", ex.frame_resolver(df))


def test_times():
    """Calendar formats are UTC unless they say otherwise, days by number are TAI."""
    assert parse_time("2020-01-01/tai") == 1_577_836_800_000_000_000
    assert parse_time("2020-01-01") == parse_time("2020-01-01T00:00:00/utc") == parse_time("2020-01-01/tai") + 37_000_000_000
    assert parse_time("2020-01-01T00:00:00+00:00") == parse_time("2020:001") == parse_time("unix/1577836800") == parse_time("2020-01-01")
    assert parse_time("mjd/40587.5") == parse_time("40587.5") == 43_200_000_000_000
    assert parse_time("2020-01-01/tt") == parse_time("2020-01-01/tai") - 32_184_000_000
    for text in ("tomorrow", "2020-01-01T00:00:00+01:00", "2020-01-01/xyz"):
        with pytest.raises(ValueError):
            parse_time(text)


@given(st.text(alphabet="ab*?\\.[]", max_size=8), st.text(alphabet="ab.\\*[", max_size=8))
def test_glob_of_values(pattern, name):
    def walk(p, n):
        if not p:
            return not n
        if p[0] == "*":
            return walk(p[1:], n) or bool(n) and walk(p, n[1:])
        if p[0] == "\\" and p[1:2] in ("\\", "*", "?", "[", "]"):
            return bool(n) and n[0] == p[1] and walk(p[2:], n[1:])
        return bool(n) and (p[0] == "?" or p[0] == n[0]) and walk(p[1:], n[1:])

    assert matches_value(pattern, name) == walk(pattern, name), glob_regex(pattern)


def test_glob_columns_and_names(spark):
    values = ["a\\b", "ab", "a*", "a[1]", "a1", "\\", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for pattern in ("a\\b", "a\\*", "a[1]", "a?", "a*", "\\", "\\\\", "a\\[*", "*"):
        got = {r["v"] for r in df.where(glob(F.col("v"), pattern)).collect()}
        assert got == {v for v in values if pattern == "*" or v is not None and matches_value(pattern, v)}, pattern
    assert matches("r[ab]*", "rb1") and not matches("r[ab]*", "rc") and is_glob("r[ab]") and not is_glob("r[") and matches("r[", "r[")


spans = st.tuples(st.integers(0, 9), st.integers(0, 9)).map(lambda p: ts.Timespan(*p))


@given(spans, spans, st.integers(0, 9))
def test_timespans_are_sets_of_instants(a, b, t):
    points = lambda s: {x for x in range(10) if s.contains(x)}
    assert a.empty == (not points(a))
    assert a.overlaps(b) == bool(points(a) & points(b))
    assert points(a.intersection(b)) == points(a) & points(b)
    pieces = a.difference(b)
    assert set().union(*map(points, pieces)) == points(a) - points(b)
    assert all(not p.empty for p in pieces) and len(pieces) <= 2
    assert ts.Timespan.instant(t).overlaps(a) == a.contains(t)


def test_timespan_columns_agree(spark):
    pairs = [(a, b, c, d) for a in range(4) for b in range(4) for c in range(4) for d in range(4)]
    df = spark.createDataFrame(pairs, "a long, b long, c long, d long")
    x, y = ts.span(F.col("a"), F.col("b")), ts.span(F.col("c"), F.col("d"))
    full = df.where("a < b AND c < d").select("*", ts.overlaps(x, y).alias("o"), ts.contains(x, y).alias("k"), ts.before(x, y).alias("l"), ts.difference(x, y).alias("p"))
    for r in full.collect():
        s, u = ts.Timespan(r.a, r.b), ts.Timespan(r.c, r.d)
        assert (r.o, r.k, r.l) == (s.overlaps(u), s.contains(u), s.before(u))
        assert [(p.begin, p.end) for p in r.p] == [q.bounds for q in s.difference(u)]
