"""Live twins of the operators: fixed inputs in two micro-batches with a restart between, against hand-derived and stored results."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from streamloom.operators.cep import ANY, RELAXED, STRICT, Pattern
from streamloom.operators.stream import Stream
from streamloom.operators.windows import CountWindow, SessionWindow, TimeWindow
from streamloom.streaming.watermark import punctuated

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def lived(spark, tmp_path):
    """lived(schema, batches, operator): rows that operator(df) gives over batches, with a restart before each."""
    made = []

    def run(schema, batches, operator):
        made.append(1)
        folder, out = tmp_path / f"in{len(made)}", []
        folder.mkdir()
        names = [f.split()[0] for f in schema.split(", ")]
        for i, rows in enumerate(batches):
            (folder / f"{i}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
            df = operator(spark.readStream.schema(schema).json(str(folder)))
            query = df.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / f"cp{len(made)}")).trigger(availableNow=True).start()
            query.awaitTermination()
        return out

    return run


def rows(pairs, at=0, marks=()):
    """(value, ts, seq, wm) rows of (value, ts), a row with wm for each None value."""
    return [(v, ts, at + i, v is None) for i, (v, ts) in enumerate(pairs)]


INTS = "value long, ts long, seq long, wm boolean"


def windows(lived, spec, batches, **how):
    def run(df):
        return Stream(df, watermark="wm").window(spec, **how).collect("value")

    n, told = 0, []
    for b in batches:
        told.append(rows(b, n))
        n += len(b)
    return sorted((r.win_end, r.win_start, r.data) for r in lived(INTS, told, run))


def test_time_windows(lived):
    sliding = windows(lived, TimeWindow(500, 250), [[(1, 1000), (2, 1300), (3, 1550), (None, 1550)], [(None, 1800), (None, 2050)]])
    assert sliding == [(1249, 1000, [1]), (1499, 1000, [1, 2]), (1749, 1250, [2, 3]), (1999, 1500, [3])]
    hopping = windows(lived, TimeWindow(500, 750), [[(1, 1000), (2, 1300), (3, 1550)], [(None, 1550), (4, 1790), (None, 1800), (None, 2050), (None, 2300)]])
    assert hopping == [(1499, 1000, [1, 2]), (2249, 1750, [4])]


def test_count_windows(lived):
    ints = lambda a, b: [(i, i * 10) for i in range(a, b)]
    assert windows(lived, CountWindow(5, 3), [ints(1, 5), ints(5, 10)]) == [(3, 1, [1, 2, 3]), (6, 2, [2, 3, 4, 5, 6]), (9, 5, [5, 6, 7, 8, 9])]
    assert windows(lived, CountWindow(3, 5), [ints(1, 3), ints(3, 9)]) == [(3, 1, [1, 2, 3]), (8, 6, [6, 7, 8])]


def test_sessions(lived):
    got = windows(lived, SessionWindow(500), [[(1, 200), (2, 700), (None, 1200), (3, 1750), (4, 1800)], [(5, 2000), (None, 2400), (6, 2700), (None, 3100), (None, 3700)]])
    assert got == [(700, 200, [1, 2]), (2000, 1750, [3, 4, 5]), (2700, 2700, [6])]


class _Max:
    columns = ("value",)

    def initialize(self):
        return None

    def update(self, state, row):
        return row["value"] if state is None else max(state, row["value"])

    def produce(self, state):
        return state


def test_window_functions(spark, lived):
    data = [(10, 0), (20, 10), (30, 20), (15, 30), (10, 100), (20, 110), (None, 300)]
    batches = [rows(data[:3]), rows(data[3:], 3)]
    of = lambda df: Stream(df, watermark="wm").window(TimeWindow(100, 100))
    assert sorted((r.win_start, r.result) for r in lived(INTS, batches, lambda df: of(df).apply_stateful_window(_Max(), "long"))) == [(0, 30), (100, 20)]
    text = lambda a, b, data: f"{[d['value'] for d in data]}, {a}, {b}"
    got = sorted((r.result, r.ts) for r in lived(INTS, batches, lambda df: of(df).aggregate_function(text, "string", "value")))
    assert got == [("[10, 20, 30, 15], 0, 99", 30), ("[10, 20], 100, 199", 110)]
    stored = Stream(spark.createDataFrame(rows(data)[:-1], INTS).drop("wm")).window(TimeWindow(100, 100), flush=True)
    assert sorted((r.result, r.ts) for r in stored.aggregate_function(text, "string", "value").collect()) == got
    sums = lambda w: w.summarise(keys=("value",), n="count", s=("sum", "value"), m=("max", "value"))
    key = lambda r: (r.win_start, r.value, r.n, r.s, r.m)
    assert sorted(map(key, lived(INTS, batches, lambda df: sums(of(df))))) == sorted(map(key, sums(stored).collect()))
    longest = lambda w: w.reduce_by_key_window("value", "ts", lambda a, b: max(a, b))
    assert sorted(map(tuple, lived(INTS, batches, lambda df: longest(of(df))))) == sorted(map(tuple, longest(stored).collect()))


def test_join(lived):
    schema = "a string, k long, v long, ts long, seq long, side long"
    data = [("one", 1, None, 0, 0, 0), ("two", 2, None, 1, 1, 0), ("three", 3, None, 2, 2, 0), (None, 1, 3000, 3, 3, 1), (None, 1, 4000, 4, 4, 1), (None, 2, 5000, 5, 5, 1), ("late", 9, None, 200, 6, 0)]

    def run(df):
        left = Stream(df.where("side = 0").select("a", "k", "ts", "seq"))
        right = Stream(df.where("side = 1").select("k", "v", "ts", "seq"))
        return left.join(right, lambda x, y: x("k") == y("k"), TimeWindow(100, 100))

    assert sorted((r.l_a, r.r_v, r.win_start) for r in lived(schema, [data[:4], data[4:]], run)) == [("one", 3000, 0), ("one", 4000, 0), ("two", 5000, 0)]


def test_reduce_by_key(spark, lived):
    schema = "k string, v long, ts long, seq long"
    data = [(k, 1, i, i) for i, k in enumerate("abcadab")] + [(None, 9007199254740993, 8, 8), (None, None, 9, 9), ("a", None, 10, 10), (None, 2, 11, 11)]
    batches = [data[:4], data[4:]]
    stored = Stream(spark.createDataFrame(data, schema))
    live = sorted((r.seq, r.k, r.v) for r in lived(schema, batches, lambda df: Stream(df).reduce_by_key("k", "v")))
    assert live[:7] == [(0, "a", 1), (1, "b", 1), (2, "c", 1), (3, "a", 2), (4, "d", 1), (5, "a", 3), (6, "b", 2)] and live[-1] == (11, None, 9007199254740995)
    for how in ("sum", "count", lambda a, b: a + b):
        assert sorted(((r.seq, r.k, r.v) for r in stored.reduce_by_key("k", "v", how).collect()), key=str) == sorted(((r.seq, r.k, r.v) for r in lived(schema, batches, lambda df, how=how: Stream(df).reduce_by_key("k", "v", how))), key=str)
    final = {r.k: r.v for r in stored.reduce_by_key("k", "v", lambda a, b: a + b, "final").collect()}
    assert final == {"a": 3, "b": 2, "c": 1, "d": 1, None: 9007199254740995} == {r.k: r.v for r in stored.reduce_by_key("k", "v", mode="final").collect()}
    maps = lived(schema, batches, lambda df: Stream(df).reduce_by_key("k", "v", mode="map"))
    assert max(maps, key=lambda r: r.seq).state == {"a": 3, "b": 2, "c": 1, "d": 1}
    with pytest.raises(ValueError):
        stored.reduce_by_key("k", "v", "odd")


def test_stateful_and_machine(lived):
    batches = [[(10, 0, 0, False), (20, 1, 1, False)], [(15, 2, 2, False), (30, 3, 3, False)]]
    assert [r.result for r in lived(INTS, batches, lambda df: Stream(df).apply_stateful(_Max(), "long"))] == [10, 20, 20, 30]
    v = F.col("value")
    table = {"0": [(v == 1, "1"), (v == 3, "3")], "1": [(v == 2, "0")], "3": [(v == 4, "4")]}
    batches = [[(1, 0, 0, False), (2, 1, 1, False)], [(3, 10, 2, False), (4, 11, 3, False)]]
    assert [(r.value, r.state) for r in lived(INTS, batches, lambda df: Stream(df).state_transition("0", {"1", "4"}, table))] == [(1, "1"), (4, "4")]


def test_patterns(spark, lived):
    a = F.col("value") == "A"
    schema = "value string, ts long, seq long"
    three = [("A", 1, 0), ("A", 2, 1), ("A", 3, 2)]
    loop = Pattern("a", a).at_least(2)
    pair = [Pattern("a", a), Pattern("b", a, STRICT)]
    five = [("A", i, i - 1) for i in range(1, 6)]
    cases = [
        (three, [loop.within_loop(STRICT)], 1000, [[0, 1], [0, 1, 2], [1, 2]]),
        (three, [loop.within_loop(ANY)], 1000, [[0, 1], [0, 1, 2], [0, 2], [1, 2]]),
        ([("A", 1, 0), ("A", 9, 1), ("A", 20, 2), ("A", 23, 3)], pair, 10, [[0, 1], [2, 3]]),
        (five, [*pair, Pattern("c", a, ANY)], 1000, [[0, 1, 2], [0, 1, 3], [0, 1, 4], [1, 2, 3], [1, 2, 4], [2, 3, 4]]),
        ([("A", 1, 0), ("x", 2, 1), ("B", 3, 2), ("B", 4, 3)], [Pattern("a", a), Pattern("b", F.col("value") == "B", RELAXED)], 100, [[0, 2]]),
    ]
    for data, patterns, within, want in cases:
        found = lambda df, p=patterns, w=within: Stream(df).cep(p, w, carry=("value",))
        got = lived(schema, [data[:2], data[2:]], found)
        stored = found(spark.createDataFrame(data, schema)).collect()
        assert sorted(r.events for r in got) == want == sorted(r.events for r in stored)
        by_seq = {s: v for v, _, s in data}
        assert all([x.value for x in r.rows] == [by_seq[s] for s in r.events] for r in got + stored)


def test_punctuated(lived):
    data = [("a", 100, 0), ("b", 800, 1), ("W", 1000, 2), ("c", 1200, 3), ("late", 1000, 4), ("W", 1500, 5), ("later", 1400, 6)]
    got = lived("value string, ts long, seq long", [data[:4], data[4:]], lambda df: punctuated(df, F.col("value") == "W", F.col("ts")))
    assert [(r.value, r.watermark) for r in got] == [("a", None), ("b", None), ("c", 1000)]


def test_ordered_union(spark, lived):
    left = [("a", 1), ("b", 3), ("c", 5), (None, 9), (None, 10)]
    right = [("d", 1), ("e", 2), (None, 3), ("f", 4), ("g", 6), (None, 11)]
    data = [(v, t, i, v is None, 0) for i, (v, t) in enumerate(left)] + [(v, t, i, v is None, 1) for i, (v, t) in enumerate(right)]
    schema = "value string, ts long, seq long, wm boolean, of long"
    both = lambda df: Stream(df.where("of = 0").drop("of"), watermark="wm").union(Stream(df.where("of = 1").drop("of"), watermark="wm"), ordered=True).df
    batches = [[r for r in data if r[1] <= 3], [r for r in data if r[1] > 3]]
    got = lived(schema, batches, both)
    assert [r.value for r in sorted(got, key=lambda r: r.seq)] == list("adebfcg") and [r.seq for r in got] == list(range(1, 8))
    plain = [Stream(spark.createDataFrame([r[:3] for r in data if r[4] == k and r[0]], "value string, ts long, seq long")) for k in (0, 1)]
    assert [r.value for r in plain[0].union(plain[1], ordered=True).df.orderBy("seq").collect()] == list("adebfcg")
    tie = [Stream(spark.createDataFrame([r], "value string, ts long, seq long")) for r in (("l", 1, 5), ("r", 1, 0))]
    assert [r.value for r in tie[0].union(tie[1], ordered=True).df.orderBy("ts", "seq").collect()] == ["l", "r"]


def test_late_rows_and_clock(spark, lived):
    from streamloom.streaming.watermark import clocked, drop_late

    data = [(1, 100, 0, False), (None, 500, 1, True), (2, 500, 2, False), (3, 501, 3, False), (None, 300, 4, True), (4, 450, 5, False), (5, None, 6, False)]
    want = [0, 1, 3, 4]
    assert sorted(r.seq for r in lived(INTS, [data[:3], data[3:]], lambda df: drop_late(df, "wm"))) == want
    assert sorted(r.seq for r in drop_late(spark.createDataFrame(data, INTS), "wm").collect()) == want
    rate = spark.readStream.format("rate").load().select(F.col("value"), F.unix_millis("timestamp").alias("ts"), F.col("value").alias("seq"))
    marked = clocked(rate, 500, 100)
    out = []
    query = marked.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).start()
    import time

    end = time.time() + 20
    while time.time() < end and not any(r.is_watermark for r in out):
        time.sleep(0.3)
    query.stop()
    marks = [r for r in out if r.is_watermark]
    assert marks and all(r.value is None and r.ts < time.time() * 1000 - 100 for r in marks)
    with pytest.raises(ValueError):
        clocked(rate, 0)
