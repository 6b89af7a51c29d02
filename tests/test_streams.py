"""Small inputs with hand-derived results."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from streamloom.functions.predicates import all_of, any_of, compare
from streamloom.functions.text import parse_delimited, template
from streamloom.operators.cep import ANY, RELAXED, STRICT, Pattern
from streamloom.operators.stream import Stream
from streamloom.operators.windows import CountWindow, SessionWindow, TimeWindow
from streamloom.plans.rules import Action, Condition, stateless_rules
from streamloom.streaming.watermark import punctuated

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream(spark, rows, schema="value string"):
    data = [(*(r[:-1]), r[-1], i) for i, r in enumerate(rows)]
    return Stream(spark.createDataFrame(data, f"{schema}, ts long, seq long"))


def ints(spark, pairs):
    return stream(spark, pairs, "value int")


def test_filter_flat_map_route_union(spark):
    words = ["alpha", "gamma", "area", "delta", "ally"]
    s = stream(spark, [(w, i + 1) for i, w in enumerate(words)])
    assert [r.value for r in s.filter(F.col("value").startswith("a")).df.orderBy("ts").collect()] == ["alpha", "area", "ally"]
    s = stream(spark, [("a b c", 1), ("b d", 2)])
    assert sorted((r.word, r.ts) for r in s.flat_map(word=F.split("value", " ")).df.collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 2)]
    s = stream(spark, [(x, i) for i, x in enumerate(["1", "22", "333", "4444", "55555"])])
    n = F.length("value")
    assert [(r.value, r.branch) for r in s.routed(n < 2, n < 3, n < 5).df.orderBy("ts").collect()] == [("1", 1), ("22", 2), ("333", 3), ("4444", 3)]
    assert [b.df.count() for b in s.route_if(n < 2, n < 3, n < 5)] == [1, 1, 2]
    assert s.union(s).df.count() == 10
    with pytest.raises(ValueError):
        s.union(ints(spark, [(1, 1)]))


def test_time_windows(spark):
    s = ints(spark, [(1, 1000), (2, 1300), (3, 1550), (0, 2050)])
    got = [(r.win_start, r.win_end, r.data) for r in s.window(TimeWindow(500, 250)).collect("value").orderBy("win_end").collect()]
    assert got[:3] == [(1000, 1249, [1]), (1000, 1499, [1, 2]), (1250, 1749, [2, 3])]
    assert got[3][:2] == (1500, 1999) and got[3][2] == [3]
    s = ints(spark, [(1, 1000), (2, 1300), (3, 1550), (4, 1790), (9, 2300)])
    got = [(r.win_start, r.win_end, r.data) for r in s.window(TimeWindow(500, 750)).collect("value").orderBy("win_end").collect()]
    assert got == [(1000, 1499, [1, 2]), (1750, 2249, [4])]
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            TimeWindow(*bad)


def test_count_windows(spark):
    s = ints(spark, [(i, i * 10) for i in range(1, 10)])
    got = [(r.win_start, r.win_end, r.data) for r in s.window(CountWindow(5, 3)).collect("value").orderBy("win_end").collect()]
    assert got == [(1, 3, [1, 2, 3]), (2, 6, [2, 3, 4, 5, 6]), (5, 9, [5, 6, 7, 8, 9])]
    s = ints(spark, [(i, i * 10) for i in range(1, 9)])
    got = [(r.win_start, r.win_end, r.data) for r in s.window(CountWindow(3, 5)).collect("value").orderBy("win_end").collect()]
    assert got == [(1, 3, [1, 2, 3]), (6, 8, [6, 7, 8])]


def test_sessions(spark):
    s = ints(spark, [(1, 200), (2, 700), (3, 1750), (4, 1800), (5, 2000), (6, 2700)])
    got = [(r.win_start, r.win_end, r.data) for r in s.window(SessionWindow(500), flush=True).collect("value").orderBy("win_start").collect()]
    assert got == [(200, 700, [1, 2]), (1750, 2000, [3, 4, 5]), (2700, 2700, [6])]
    assert s.window(SessionWindow(500)).df.select("win_start").distinct().count() == 2
    with pytest.raises(ValueError):
        SessionWindow(0)


def test_join_in_window(spark):
    left = Stream(spark.createDataFrame([("one", 1, 0, 0), ("two", 2, 1, 1), ("three", 3, 2, 2)], "a string, k int, ts long, seq long"))
    right = Stream(spark.createDataFrame([(1, 3000, 3, 3), (1, 4000, 4, 4), (2, 5000, 5, 5)], "k int, v int, ts long, seq long"))
    got = left.join(right, lambda a, b: a("k") == b("k"), TimeWindow(100, 100), flush=True)
    assert sorted((r.l_a, r.r_v) for r in got.collect()) == [("one", 3000), ("one", 4000), ("two", 5000)]


def test_reduce_by_key(spark):
    s = Stream(spark.createDataFrame([(k, 1, i, i) for i, k in enumerate("abcadab")], "k string, v int, ts long, seq long"))
    log = [(r.k, r.v) for r in s.reduce_by_key("k", "v").orderBy("ts").collect()]
    assert log == [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("d", 1), ("a", 3), ("b", 2)]
    assert s.reduce_by_key("k", "v", mode="map").orderBy(F.desc("ts")).first().state == {"a": 3, "b": 2, "c": 1, "d": 1}
    assert {r.k: r.v for r in s.reduce_by_key("k", "v", mode="final").collect()} == {"a": 3, "b": 2, "c": 1, "d": 1}


class _Max:
    def initialize(self):
        return None

    def update(self, state, row):
        return row["value"] if state is None else max(state, row["value"])

    def produce(self, state):
        return state


def test_stateful(spark):
    s = ints(spark, [(10, 0), (20, 1), (15, 2), (30, 3)])
    assert [r.result for r in s.apply_stateful(_Max(), "int").orderBy("ts").collect()] == [10, 20, 20, 30]
    assert [r.result for r in s.running("value").orderBy("ts").collect()] == [10, 20, 20, 30]
    s = ints(spark, [(10, 0), (20, 10), (30, 20), (15, 30), (10, 100), (20, 110)])
    got = s.window(TimeWindow(100, 100), flush=True).apply_stateful_window(_Max(), "int").orderBy("win_start").collect()
    assert [(r.win_start, r.result) for r in got] == [(0, 30), (100, 20)]


def test_machine(spark):
    s = ints(spark, [(1, 0), (2, 1), (3, 10), (4, 11)])
    v = F.col("value")
    table = {"0": [(v == 1, "1"), (v == 3, "3")], "1": [(v == 2, "0")], "3": [(v == 4, "4")]}
    assert [(r.value, r.state) for r in s.state_transition("0", {"1", "4"}, table).orderBy("ts").collect()] == [(1, "1"), (4, "4")]


def _matches(spark, rows, patterns, within):
    return [r.events for r in stream(spark, rows).cep(patterns, within).collect()]


def test_patterns(spark):
    a = F.col("value") == "A"
    three = [("A", 1), ("A", 2), ("A", 3)]
    loop = Pattern("a", a).at_least(2)
    assert sorted(_matches(spark, three, [loop.within_loop(STRICT)], 1000)) == [[0, 1], [0, 1, 2], [1, 2]]
    assert sorted(_matches(spark, three, [loop.within_loop(ANY)], 1000)) == [[0, 1], [0, 1, 2], [0, 2], [1, 2]]
    pair = [Pattern("a", a), Pattern("b", a, STRICT)]
    assert sorted(_matches(spark, [("A", 1), ("A", 9), ("A", 20), ("A", 23)], pair, 10)) == [[0, 1], [2, 3]]
    five = [("A", i) for i in range(1, 6)]
    got = sorted(_matches(spark, five, [*pair, Pattern("c", a, ANY)], 1000))
    assert got == [[0, 1, 2], [0, 1, 3], [0, 1, 4], [1, 2, 3], [1, 2, 4], [2, 3, 4]]
    mixed = [("A", 1), ("x", 2), ("B", 3), ("B", 4)]
    b = F.col("value") == "B"
    assert _matches(spark, mixed, [Pattern("a", a), Pattern("b", b, RELAXED)], 100) == [[0, 2]]
    assert _matches(spark, mixed, [Pattern("a", a), Pattern("b", b, STRICT)], 100) == []
    assert sorted(_matches(spark, mixed, [Pattern("a", a), Pattern("b", b, RELAXED).optional()], 100)) == [[0], [0, 2]]


def test_pattern_validation():
    c = F.lit(True)
    for bad in (
        lambda: Pattern("", c),
        lambda: Pattern("a", None),
        lambda: Pattern("a", c, "sometimes"),
        lambda: Pattern("a", c).times(2).at_least(3),
        lambda: Pattern("a", c).optional().optional(),
        lambda: Pattern("a", c).within_loop(STRICT),
        lambda: Pattern("a", c).times(2).until(c),
        lambda: Pattern("a", c).times(3, 2),
    ):
        with pytest.raises(ValueError):
            bad()


def test_predicates_text_rules(spark):
    df = spark.createDataFrame([("room1,30",), ("room2, 5",), ("room3,20,x",)], "line string")
    rows = parse_delimited(df, "line", [("Place", "STRING"), ("T", "INTEGER")])
    assert [(r.Place, r["T"]) for r in rows.orderBy("Place").collect()] == [("room1", 30), ("room2", 5), ("room3", 20)]
    with pytest.raises(Exception, match="too few fields"):
        parse_delimited(spark.createDataFrame([("x",)], "line string"), "line", [("a", "STRING"), ("b", "LONG")]).collect()
    rules = [(Condition("GT", "T", 25), Action(("Hot", "$Place"))), (Condition("LT", "T", 10), Action(("Cold", "$T")))]
    assert sorted(r.message for r in stateless_rules(rows, rules).collect()) == ["Cold,5", "Hot,room1"]
    both = [(Condition("OR", parts=(Condition("GT", "T", 25), Condition("EQ", "Place", "room1"))), Action(("x",)))]
    assert stateless_rules(rows, both).count() == 1 and stateless_rules(rows, both, or_duplicates=True).count() == 2
    with pytest.raises(TypeError):
        compare(rows, "T", "GT", "a")
    assert rows.where(all_of()).count() == 3 and rows.where(any_of()).count() == 0
    value = spark.createDataFrame([("v", "$w\\")], "T string, Tem string").select(template(["$Tem", "$T"], ["T", "Tem"], "-").alias("m"))
    assert value.first().m == "$w\\-v"


def test_punctuated(spark):
    s = stream(spark, [("a", 100), ("b", 800), ("W", 1000), ("c", 1200), ("late", 1000), ("W", 1500)]).df
    got = punctuated(s, F.col("value") == "W", F.col("ts")).orderBy("seq").collect()
    assert [r.value for r in got] == ["a", "b", "c"]
