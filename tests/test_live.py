"""Streaming twins, shared sources, sockets."""

import json
import socket
import threading

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from streamloom.sources.configs import KafkaSource, MqttSource, SocketSource
from streamloom.sources.readers import stored
from streamloom.sources.sinks import framed, tcp_text
from streamloom.streaming.engine import Engine, Ewma
from streamloom.streaming.stateful import apply_stateful_streaming

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Count:
    def initialize(self):
        return 0

    def update(self, state, row):
        return state + 1

    def produce(self, state):
        return state


def _files(spark, folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return stored(spark, str(folder), "k string, ts long, seq long", "json")


def test_stateful_survives_restart(spark, tmp_path):
    seen, folder = [], tmp_path / "in"
    rows = [[{"k": k, "ts": i, "seq": i} for i, k in enumerate("aabca")], [{"k": k, "ts": 9, "seq": 9} for k in "bcbc"]]
    source = _files(spark, folder, rows[:1])
    engine = Engine(spark, str(tmp_path / "cp"))

    def run(df):
        counted = apply_stateful_streaming(df, _Count(), "long", "k", ["ts", "seq"])
        q = engine.submit_stateful("app", counted, lambda b, _: seen.extend(tuple(r) for r in b.collect()), name="counts", availableNow=True)
        engine.wait(q)

    run(source)
    assert sorted(seen) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)]
    (folder / "1.json").write_text("".join(json.dumps(r) + "\n" for r in rows[1]))
    seen.clear()
    run(stored(spark, str(folder), "k string, ts long, seq long", "json"))
    assert sorted(seen) == [("b", 2), ("b", 3), ("c", 2), ("c", 3)]


def test_queries_share_a_source(spark, tmp_path):
    made, out = [], {1: [], 2: []}
    source = _files(spark, tmp_path / "in", [[{"k": k, "ts": 1, "seq": i} for i, k in enumerate("abab")]])
    engine = Engine(spark, str(tmp_path / "cp"))

    def make():
        made.append(1)
        return source

    ids = [engine.submit("app", "s", make, lambda df, k=k: df.where(F.col("k") == k), lambda b, _, n=n: out[n].append(b.count())) for n, k in ((1, "a"), (2, "b"))]
    assert made == [1] and engine.sources() == 1 and len(engine.queries()) == 2
    engine._shared[("app", "s")].running.processAllAvailable()
    engine.delete(ids[0])
    assert engine.sources() == 1
    engine.delete(ids[1])
    assert engine.sources() == 0 and engine.queries() == []


def test_text_sink(spark):
    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def serve():
        for _ in range(2):
            connection, _ = server.accept()
            with connection:
                data = b""
                while part := connection.recv(4096):
                    data += part
                got.append(data)

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    df = spark.createDataFrame([("a",), ("b\n",)], "value string").repartition(2)
    df = spark.createDataFrame(df.collect(), "value string").coalesce(1)
    write = tcp_text("127.0.0.1", server.getsockname()[1])
    write(df, 0)
    write(df, 1)
    thread.join(10)
    assert all(sorted(d.split()) == [b"a", b"b"] for d in got)
    assert framed("x") == b"x\n" and framed("x\ny") == b"x\ny"


def test_configs_and_average():
    for bad in (lambda: SocketSource("", 1), lambda: KafkaSource("t", {}), lambda: KafkaSource("t", {"bootstrap.servers": "x", "odd": "1"}), lambda: MqttSource("b", ""), lambda: Ewma(0)):
        with pytest.raises(ValueError):
            bad()
    e = Ewma(0.5)
    assert [e.update(x) for x in (4, 2, 0)] == [4, 3, 1.5]
