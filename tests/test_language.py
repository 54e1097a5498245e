import pytest

from chronoloom.errors import InvalidQuery
from chronoloom.functions import duration, names
from chronoloom.plans.filters import AllStar, And, Eq, Not, Or, Wildcard, parse_filter


@pytest.mark.parametrize(
    "text, tree",
    [
        ("site:north", Eq("site", "north")),
        ("!site:north", Not(Eq("site", "north"))),
        ("!(site:north OR lane:left)", Not(Or((Eq("site", "north"), Eq("lane", "left"))))),
        ("unit:kw_*", Wildcard("unit", "kw_")),
        ("unit:*", Wildcard("unit", "")),
        (" * ", AllStar()),
        (None, AllStar()),
        ("ANDx:y", Eq("ANDx", "y")),
        ("a:b OR c:d AND !e:f", Or((Eq("a", "b"), And((Eq("c", "d"), Not(Eq("e", "f"))))))),
    ],
)
def test_parses(text, tree):
    assert parse_filter(text) == tree
    assert parse_filter(str(tree)) == tree


@pytest.mark.parametrize(
    "text",
    ["env = prod", "a:b and c:d", "* AND a:b", "s:*x", "(a:b", "a:b)", "a:b AND", "AND", "!", "", "()", "a:b c:d", "a:b c:d AND", "a:b !", "h:[a,b]", "k1:v"],
)
def test_refuses(text):
    with pytest.raises(InvalidQuery):
        parse_filter(text)


def test_sets():
    assert parse_filter("bay:[ b.7,b_8 ,\tb-9 ]", sets=True) == Or((Eq("bay", "b.7"), Eq("bay", "b_8"), Eq("bay", "b-9")))
    assert parse_filter("bay:[x]", sets=True) == Eq("bay", "x")
    for bad in ("bay:[]", "bay:[a b]", "bay:[a,,b]"):
        with pytest.raises(InvalidQuery):
            parse_filter(bad, sets=True)


def test_deep_nesting_is_refused_not_fatal():
    with pytest.raises(InvalidQuery):
        parse_filter("(" * 5000 + "a:b" + ")" * 5000)


def test_series_keys():
    assert names.series_key("gate.load", {"site": "north"}) == "gate.load#site:north"
    assert names.series_key("gate.load", {"site": "north", "bay": "b-7", "lane": "left"}) == "gate.load#bay:b-7;lane:left;site:north"
    assert names.parse_tags("lane:left;bay:b-7:2") == {"lane": "left", "bay": "b-7:2"}
    assert names.parse_tags("") == {} and names.term("m", "k", "v") == "m#k:v"


def test_names_are_checked():
    assert names.MetricName("cpu.total_ms") == "cpu.total_ms" and names.MetricName("", allow_empty=True) == ""
    for bad in ("", "Cpu", "cpu1", "cpu-x"):
        with pytest.raises(InvalidQuery):
            names.MetricName(bad)
    for bad in ({"": "x"}, {"a:b": "x"}, {"a": "x;y"}, {"a": None}):
        with pytest.raises(InvalidQuery):
            names.check_tags(bad)
    assert names.tagset(host="h-1") == {"host": "h-1"}


def test_durations():
    assert duration.minutes(1) == 60 * 10**9 and duration.months(1) == 28 * duration.days(1) and duration.years(1) == 12 * duration.months(1)
    assert duration.days(0.5) == duration.hours(12) and duration.duration(0.5, "days", truncate_first=True) == 0
    assert duration.seconds(-1) == 0 and duration.seconds(float("nan")) == 0
    assert duration.weeks(2) == duration.days(14) and duration.micros(3) == 3000 and duration.millis(1) == duration.micros(1000) and duration.nanos(5) == 5
    assert duration.timestamp() > 10**18


def test_columns_match_the_python_forms(spark):
    from pyspark.sql import functions as F

    rows = [("m", {"b": "2", "a": "1"}), ("m", {}), ("m", None)]
    df = spark.createDataFrame(rows, "metric STRING, tags MAP<STRING,STRING>")
    got = [r[0] for r in df.select(names.series_key_column(F.col("metric"), F.col("tags"))).collect()]
    assert got == ["m#a:1;b:2", "m#", "m#"]
    text = spark.createDataFrame([("a:1;b:x:y",), ("",)], "t STRING")
    assert [r[0] for r in text.select(names.parse_tags_column(F.col("t"))).collect()] == [{"a": "1", "b": "x:y"}, {}]
