"""Canonical JSON, and the pairing of repeated identifiers."""

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from streamloom.llm import toolcalls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMA = "name string, field string, kind string, required boolean"


def test_canonical_json(spark):
    equal = [
        ['{"b":1e2,"a":[100,1.00e+2]}', '{ "a" : [1E2, 100.0], "b":100 }'],
        ["100000000000000000000", "1e20", "100000000000000000000.00"],
        ["9007199254740993", "9.007199254740993e15"], ["1e400", "10e399"], ["0", "-0", "0.0e5", "-0E-3"], ["1e-7", "0.0000001"], ["-12.50", "-1.25e1"],
        ['{"k":"1e2\\\\","s":"\\u0001n5","t":"q\\"\\u0001n5\\""}', '{"t":"q\\"\\u0001n5\\"","s":"\\u0001n5","k":"1e2\\\\"}'],
    ]
    none = ["{\"a\":01}", "nope", '{"a":1,"a":2}', "", "1 2", "1,2", "1],[2", '{"a":1} x', '1,"\\u0001e"],[', "\x01", None]
    rows = [(i, t) for i, same in enumerate(equal) for t in same] + [(-1, t) for t in none]
    got = spark.createDataFrame(rows, "i int, t string").select("i", "t", toolcalls.canonical_json(F.col("t")).alias("c")).collect()
    for r in got:
        if r.i < 0:
            assert r.c is None, r
        else:
            assert json.loads(r.c, parse_float=Decimal, parse_int=Decimal) == json.loads(r.t, parse_float=Decimal, parse_int=Decimal)
    assert all(len({r.c for r in got if r.i == i}) == 1 for i in range(len(equal)))
    assert {r.c for r in got if r.i == 0} == {'{"a":[100,100],"b":100}'}
    rnd = random.Random(3)
    tokens = [f"{rnd.choice(['', '-'])}{rnd.randint(0, 10 ** rnd.randint(0, 25))}{rnd.choice(['', '.' + str(rnd.randint(0, 999)) + '0'])}{rnd.choice(['', 'e' + str(rnd.randint(-30, 30)), 'E+3'])}" for _ in range(400)]
    found = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", toolcalls.canonical_number(F.col("t")).alias("c"), toolcalls.canonical_number(toolcalls.canonical_number(F.col("t"))).alias("again")).collect()
    assert all(Decimal(r.c) == Decimal(r.t) and r.again == r.c for r in found)


def test_repeated_identifiers(spark):
    rnd = random.Random(5)
    calls = [(1, rnd.randint(0, 50) if rnd.random() < 0.9 else None, f"c{rnd.choice([0, 0, 0, 1, 2, 3])}", rnd.choice("fg"), '{"x":%d}' % rnd.randint(0, 3), None) for _ in range(300)]
    results = [(1, rnd.randint(0, 50), f"c{rnd.choice([0, 0, 1, 1, 4])}", rnd.choice(["a", None])) for _ in range(200)]
    lost = [(None, 1, "c0", "f", '{"x":1}', ["c0"]), (1, 1, None, "f", "{}", None)]
    gone = [(None, 1, "c0", "a"), (None, 2, None, None)]
    schemas = spark.createDataFrame([("f", "x", "integer", True)], SCHEMA)
    got = toolcalls.link(spark.createDataFrame(calls + lost, CALLS), spark.createDataFrame(results + gone, RESULTS), schemas).collect()
    want = []
    last = lambda x: (x is None, x or 0)
    for i in sorted({c[2] for c in calls} | {r[2] for r in results}):
        mine = sorted((c for c in calls if c[2] == i), key=lambda c: (last(c[1]), c[3], c[4]))
        theirs = sorted((r for r in results if r[2] == i), key=lambda r: (r[1], r[3] is None))
        for k in range(max(len(mine), len(theirs))):
            c, r = (x[k] if k < len(x) else None for x in (mine, theirs))
            status = "no_call" if c is None else "no_schema" if c[3] == "g" else "no_result" if r is None else "ok"
            want.append((1, i, c and c[1], r and r[1], None if c is None else 0, status))
    want += [(None, "c0", 1, None, None, "no_id"), (1, None, 1, None, None, "no_id"), (None, "c0", None, 1, None, "no_id"), (None, None, None, 2, None, "no_id")]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))


def test_integers_of_any_size(spark):
    values = {"1": 1, "1.0": 1, "1e2": 1, "100000000000000000000": 1, "1e400": 1, "1.5": 0, "1e-1": 0, '"1"': 0, "1234567890123456789012345.5": 0, "null": 0}
    calls = spark.createDataFrame([(1, i, f"c{i}", "f", '{"x":%s}' % v, None) for i, v in enumerate(values)], CALLS)
    schemas = spark.createDataFrame([("f", "x", "integer", True)], SCHEMA)
    got = {r.turn: r.status for r in toolcalls.link(calls, spark.createDataFrame([], RESULTS), schemas).collect()}
    assert got == {i: "no_result" if fits else "wrong_kind" for i, fits in enumerate(values.values())}
