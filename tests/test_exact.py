"""Nulls, large integers, clashing names and other odd rows of the stream operators; panes and stretches against plain rows."""

import gc
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from streamloom.functions.ordered import numbered
from streamloom.operators.cep import RELAXED, STRICT, Pattern, by_name
from streamloom.operators.stream import Stream
from streamloom.operators.windows import CountWindow, SessionWindow, TimeWindow

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BIG = 9007199254740993


class _Count:
    def initialize(self):
        return 0

    def update(self, state, row):
        return state + 1

    def produce(self, state):
        return state


def test_large_and_null_values(spark):
    rows = [(k, v, i, i) for i, (k, v) in enumerate([(None, BIG), (None, None), (None, 3), (1, BIG), (1, None)])]
    s = Stream(spark.createDataFrame(rows, "k long, v long, ts long, seq long"))
    got = sorted((r.seq, r.k, r.v, r.result) for r in s.apply_stateful(_Count(), "long", key_by="k").collect())
    assert got == [(0, None, BIG, 1), (1, None, None, 2), (2, None, 3, 3), (3, 1, BIG, 1), (4, 1, None, 2)]
    moves = {"a": [(F.col("v").isNull(), "b")], "b": [(F.col("v") == 3, "a")]}
    assert sorted((r.seq, r.v) for r in s.state_transition("a", {"a"}, moves, key_by="k").collect()) == [(0, BIG), (2, 3), (3, BIG)]
    nan = Stream(spark.createDataFrame([(float("nan"), i, i) for i in range(3)], "k double, ts long, seq long"))
    assert sorted(r.result for r in nan.apply_stateful(_Count(), "long", key_by="k").collect()) == [1, 2, 3]


def test_clashing_names(spark):
    s = Stream(spark.createDataFrame([("x", "y", i, i) for i in range(2)], "state string, result string, ts long, seq long"))
    assert sorted((r.state, r.result) for r in s.apply_stateful(_Count(), "long").collect()) == [("x", 1), ("x", 2)]
    moves = {"0": [(F.col("state") == "x", "1")]}
    assert sorted((r.state, r.result) for r in s.state_transition("0", {"1"}, moves).collect()) == [("1", "y"), ("1", "y")]
    empty = Stream(s.df.limit(0))
    assert empty.apply_stateful(_Count(), "long").count() == empty.state_transition("0", {"1"}, moves).count() == 0
    assert empty.window(CountWindow(2, 1)).df.count() == empty.window(SessionWindow(5)).df.count() == empty.window(TimeWindow(2, 1)).df.count() == 0
    assert empty.window(TimeWindow(2, 2), flush=True).summarise(n="count").count() == 0


def test_string_keys_in_patterns(spark):
    rows = [("u", "A", 1, 0), ("u", "B", 2, 1), (None, "A", 1, 2), (None, "B", 3, 3), ("v", "B", 1, 4), ("u", "A", None, 5)]
    s = Stream(spark.createDataFrame(rows, "k string, value string, ts long, seq long"))
    for how in (STRICT, RELAXED):
        got = s.cep([Pattern("a", F.col("value") == "A"), Pattern("b", F.col("value") == "B", how)], 10, key_by="k", carry=("value", "ts"))
        assert sorted((r.key or "", r.events) for r in got.collect()) == [("", [2, 3]), ("u", [0, 1])]
        assert {tuple(x.ts for x in by_name(got, "rows").where("key = 'u'").first().match["b"])} == {(2,)}


def test_until(spark):
    rows = [(v, i, i) for i, v in enumerate("AAxAS A".replace(" ", ""))]
    s = Stream(spark.createDataFrame(rows, "value string, ts long, seq long"))
    a = Pattern("a", F.col("value") == "A").at_least(1).within_loop(RELAXED).until(F.col("value") == "S")
    got = sorted(r.events for r in s.cep([a], 100).collect())
    assert got == sorted([[0], [0, 1], [0, 1, 3], [1], [1, 3], [3], [5]])


def test_functions_of_rows(spark):
    s = Stream(spark.createDataFrame([("a b", 1, 0), (None, 2, 1), ("", 3, 2), ("c", 4, 3)], "line string, ts long, seq long"))
    assert [(r.n, r.ts) for r in s.map(lambda row: len(row["line"] or ""), "n long").df.orderBy("seq").collect()] == [(3, 1), (0, 2), (0, 3), (1, 4)]
    words = s.flat_map(lambda row: [{"word": w, "n": i} for i, w in enumerate((row["line"] or "").split())], "word string, n long")
    assert [(r.word, r.n, r.seq) for r in words.df.orderBy("seq", "n").collect()] == [("a", 0, 0), ("b", 1, 0), ("c", 0, 3)]
    assert [r.seq for r in s.filter(lambda row: bool(row["line"])).df.orderBy("seq").collect()] == [0, 3]
    kept = s.flat_map(word=F.split("line", " ")).df
    assert sorted(kept.columns) == ["line", "seq", "ts", "word"] and kept.where("word = 'b'").first().line == "a b"
    with pytest.raises(ValueError):
        s.flat_map(a=F.array(), b=F.array())


def test_numbers(spark):
    rows = [(random.Random(i).randint(0, 40), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "ts long, seq long").repartition(7)
    got = [(r._n, r.ts, r.seq) for r in numbered(df, "ts", "seq").collect()]
    assert sorted(got) == [(i + 1, *r) for i, r in enumerate(sorted(rows))]


@pytest.mark.parametrize("seed", range(2))
def test_summaries_against_rows(spark, seed):
    """Cells and stretches give what windows of plain rows give, keyed or not, with null keys and times."""
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 9) if rnd.random() < 0.9 else None, rnd.randint(0, 400) if rnd.random() < 0.95 else None, i) for i in range(150)]
    s = Stream(spark.createDataFrame(rows, "k string, v long, ts long, seq long"))
    for spec in (TimeWindow(60, 25), TimeWindow(20, 50), CountWindow(12, 8), SessionWindow(3)):
        for key, flush, keys in ((None, False, ()), ("k", True, ()), (None, True, ("k",)), ("k", False, ("v",))):
            w = s.window(spec, key_by=key, flush=flush)
            found = w.summarise(keys=keys, n="count", total=("sum", "v"), top=("max", "v"), known=("count", "v"))
            names = ["win_start", "win_end", *dict.fromkeys([*([key] if key else []), *keys])]
            plain = w.df.groupBy(*names).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("top"), F.count("v").alias("known"))
            assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), (spec, key, flush, keys)
        mine = {}
        for r in s.window(spec, key_by="k", flush=True).df.collect():
            mine.setdefault((r.k, r.win_start, r.win_end), []).append(r.ts)
        if isinstance(spec, SessionWindow):
            want = {}
            for key in ("a", "b", None):
                times = sorted(r[2] for r in rows if r[0] == key and r[2] is not None)
                part = []
                for t in [*times, 10**9]:
                    if part and t - part[-1] > spec.gap:
                        want[key, part[0], part[-1]], part = part, []
                    part.append(t)
            assert {k: sorted(v) for k, v in mine.items()} == want


@pytest.mark.parametrize("key", (None, "k", "u"))
def test_window_folds(spark, key):
    """Functions of two values over windows, in order, with null keys, times and values; NaN is one key."""
    rnd = random.Random(7)
    rows = [(rnd.choice(["x", None]), rnd.choice([1.5, float("nan"), None]), rnd.randint(0, 9) if rnd.random() < 0.8 else None, rnd.randint(0, 400) if rnd.random() < 0.95 else None, i) for i in range(150)]
    s = Stream(spark.createDataFrame(rows, "u string, k double, v long, ts long, seq long"))
    for spec in (TimeWindow(60, 25), CountWindow(12, 8), SessionWindow(3)):
        w = s.window(spec, key_by=key)
        want = {}
        for r in sorted(w.df.collect(), key=lambda r: (r.ts, r.seq)):
            group = str((r.win_start, r.win_end, *([r.u] if key == "u" else []), r.k))
            old = want.setdefault(group, None)
            want[group] = r.v if old is None else old if r.v is None else (old * 31 + r.v) % 1009
        got = w.reduce_by_key_window("k", "v", lambda a, b: (a * 31 + b) % 1009)
        names = ["win_start", "win_end", *(["u"] if key == "u" else []), "k", "v"]
        assert got.columns == names
        assert sorted((str(tuple(r[:-1])), str(r[-1])) for r in got.collect()) == sorted((g, str(x)) for g, x in want.items()), spec


MARK, ROWS = 987654321, 5000


def _alive() -> int:
    """Values of the test's rows that this worker holds."""
    return sum(type(x) is list and len(x) == 2 and type(x[0]) is int and x[0] == MARK for x in gc.get_objects())


def test_windows_held(spark):
    """A fold holds a batch of a window's rows at most; a function of whole windows holds one window."""
    s = Stream(spark.range(ROWS).select(F.lit("a").alias("k"), F.array(F.lit(MARK).cast("long"), "id").alias("v"), F.col("id").alias("ts"), F.col("id").alias("seq")))
    last = lambda a, b: [_alive() if b[1] == ROWS - 1 else 0, b[1]]
    (fold,) = s.window(TimeWindow(ROWS, ROWS), flush=True).reduce_by_key_window("k", "v", last).collect()
    assert fold.v[1] == ROWS - 1 and 0 < fold.v[0] <= 2000
    held = s.window(TimeWindow(50, 50), flush=True).aggregate_function(lambda a, b, data: _alive(), "long", "v").collect()
    assert [r.result for r in held] == [50] * (ROWS // 50)
