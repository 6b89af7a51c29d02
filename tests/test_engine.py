"""The engine: sharing, isolation of failures, notes and restoring; MQTT against a stub broker; builders and examples on live files."""

import json
import os
import socket
import struct
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from streamloom.plans.builders import CepQuery, RuleQuery, TextInput
from streamloom.plans.rules import Action, Condition
from streamloom.operators.cep import STRICT, Pattern
from streamloom.sources.configs import KafkaSource, MqttSource, SocketSource
from streamloom.sources.mqtt import MqttClient, _Reader
from streamloom.sources.readers import kafka_options, stored
from streamloom.sources.receiver import serve
from streamloom.sources.sinks import mqtt as mqtt_sink
from streamloom.sources.sinks import tcp_text
from streamloom.streaming.engine import Engine

cloudpickle.register_pickle_by_value(sys.modules[__name__])
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples"))
SCHEMA = "value string, ts long, seq long"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as file:
        file.write("".join(json.dumps(dict(zip(("value", "ts", "seq"), r, strict=True))) + "\n" for r in rows))


class Collect:
    """A sink that sends to a file below a folder, so that executors can write it."""

    def __init__(self, folder):
        self.folder = str(folder)
        os.makedirs(self.folder, exist_ok=True)

    def send(self, texts):
        texts = list(texts)
        with open(f"{self.folder}/{time.time_ns()}-{os.getpid()}", "w") as file:
            file.write("".join(t + "\n" for t in texts))

    def __call__(self, df, number):
        self.send(r[0] for r in df.select("value").collect())

    def got(self):
        return sorted(line for f in os.listdir(self.folder) for line in open(f"{self.folder}/{f}").read().split("\n") if line)


class Broken:
    def send(self, texts):
        raise OSError("no one listens")

    def __call__(self, df, number):
        raise OSError("no one listens")


def test_one_pass_and_isolated_failures(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, 0, [(v, i, i) for i, v in enumerate("abcabx")])
    engine = Engine(spark, str(tmp_path / "e"), tries=2)
    source = lambda s: stored(s, folder, SCHEMA, "json")
    sinks = {k: Collect(tmp_path / k) for k in ("a", "b", "all", "again")}
    gate = threading.Event()

    def held(s):
        gate.wait(20)
        return source(s)

    def start():
        return [
            engine.submit_route("app", "s", source, lambda k=k: (F.col("value") == k, F.concat(F.lit("saw "), "value")), sinks[k], f"route-{k}") for k in ("a", "b")
        ]

    calls = []

    def plan(df):
        calls.append(1)
        return df.where("value != 'x'")

    trigger = {"processingTime": "1 second"}
    first = engine.submit("app", "s", source, plan, sinks["all"], "plan-1", **trigger)
    with pytest.raises(ValueError):
        engine.submit("app", "s", source, plan, sinks["again"], availableNow=True)
    ids = [first, *start(), engine.submit("app", "s", source, plan, sinks["again"], "plan-2"), engine.submit_route("app", "s", source, lambda: (F.lit(True), F.col("value")), Broken(), "broken-route")]
    ids.append(engine.submit("app", "s", source, lambda df: df.where("1 = 1"), Broken(), "broken-plan"))
    run = engine._shared["app", "s"].running
    run.processAllAvailable()
    put(folder, 1, [("a", 9, 9), ("b", 10, 10)])
    deadline = time.time() + 40
    while time.time() < deadline and (sinks["again"].got().count("a") < 1 or len(engine.failures()) < 2):
        run.processAllAvailable()
        time.sleep(0.2)
    assert engine.sources() == 1 and engine.queries() == sorted(ids)
    assert sinks["a"].got()[-1] == "saw a" and set(sinks["a"].got()) == {"saw a"} and set(sinks["b"].got()) == {"saw b"}
    assert "a" in sinks["all"].got() and "x" not in sinks["all"].got() and "a" in sinks["again"].got()
    assert sorted(engine.failures()) == ["broken-plan", "broken-route"] and run.isActive and engine.load(first) >= 0
    assert {n["query"] for n in engine.notes()} == set(ids) and all(n["code"] for n in engine.notes())

    # A new engine over the same folder submits all again, and goes on where the first one stopped.
    engine.delete("broken-plan")
    engine.delete("broken-route")
    engine.stop()
    put(folder, 2, [("a", 11, 11), ("c", 12, 12)])
    other = Engine(spark, str(tmp_path / "e"))
    before = len(sinks["all"].got())
    assert sorted(other.restore()) == ["plan-1", "plan-2", "route-a", "route-b"] and other.restore() == []
    other._shared["app", "s"].running.processAllAvailable()
    deadline = time.time() + 30
    while time.time() < deadline and len(sinks["all"].got()) < before + 1:
        time.sleep(0.2)
    assert len(sinks["all"].got()) >= before + 1 and other.failures() == {}
    for i in other.queries():
        other.delete(i)
    assert other.sources() == 0 and other.notes() == []


def test_shared_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, 0, [(v, i, i) for i, v in enumerate("aab")])
    engine = Engine(spark, str(tmp_path / "e"))
    from word_count import counts

    seen = {1: [], 2: []}
    source = lambda s: stored(s, folder, SCHEMA, "json")
    ids = [engine.submit_stateful("app", source, lambda b, _, n=n: seen[n].extend(r.value for r in b.collect()), name=f"q{n}", source_id="s", plan=counts) for n in (1, 2)]
    assert engine.sources() == 1
    run = next(iter(engine._shared.values())).running
    run.processAllAvailable()
    put(folder, 1, [("b", 5, 5)])
    run.processAllAvailable()
    assert sorted(seen[1])[-1] == "b 2" and "b 2" in seen[2]
    for i in ids:
        engine.delete(i)
    assert engine.sources() == 0


class Broker(threading.Thread):
    """Enough of a broker for quality of service 0: counts pings, refuses a client id that is taken."""

    def __init__(self):
        super().__init__(daemon=True)
        self.server = socket.create_server(("127.0.0.1", 0))
        self.address = f"tcp://127.0.0.1:{self.server.getsockname()[1]}"
        self.ids, self.topics, self.published, self.pings, self.hang_up = {}, [], [], 0, 0
        self.start()

    def run(self):
        while True:
            connection, _ = self.server.accept()
            threading.Thread(target=self.talk, args=(connection,), daemon=True).start()

    def talk(self, c):
        stream = c.makefile("rb")
        while kind := stream.read(1):
            n = shift = 0
            while (b := stream.read(1)[0]) & 128:
                n |= (b & 127) << shift
                shift += 7
            body = stream.read(n | b << shift)
            kind = kind[0] >> 4
            if kind == 1:
                name = body[12:].decode()
                taken = name in self.ids
                self.ids[name] = c
                c.sendall(bytes([0x20, 2, 0, 2 if taken else 0]))
            elif kind == 8:
                self.topics.append((body[4:-1].decode(), c))
                c.sendall(b"\x90\x03" + body[:2] + b"\x00")
            elif kind == 12:
                self.pings += 1
                c.sendall(b"\xd0\x00")
            elif kind == 3:
                n = struct.unpack(">H", body[:2])[0]
                self.published.append((body[2 : 2 + n].decode(), body[2 + n :]))
                for topic, to in self.topics:
                    if topic == body[2 : 2 + n].decode():
                        size = len(body)
                        to.sendall(b"\x30" + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + body)
                if self.hang_up:
                    self.hang_up -= 1
                    c.close()
                    return
            elif kind == 14:
                return


def test_mqtt(spark):
    broker = Broker()
    reader = _Reader({"broker": broker.address, "topic": "t", "poll": "0.4", "keepalive": "1"})
    assert list(reader.read({"n": 0})[0]) == []
    out = MqttClient(broker.address, "x")
    for i in range(3):
        out.publish("t", b"m%d" % i)
        out.publish("other", b"no")
    rows, end = reader.read({"n": 0})
    assert list(rows) == [("t", b"m0"), ("t", b"m1"), ("t", b"m2")] and end == {"n": 3}
    assert list(reader.readBetweenOffsets({"n": 0}, end)) == [("t", b"m0"), ("t", b"m1"), ("t", b"m2")]
    reader.commit(end)
    assert reader.recent == {}
    time.sleep(0.8)
    assert broker.pings >= 1
    reader.client.socket.shutdown(socket.SHUT_RDWR)  # a lost connection is made anew
    reader.read(end)
    assert list(reader.read(end)[0]) == []
    out.publish("t", b"again")
    assert list(reader.read(end)[0]) == [("t", b"again")]

    broker.hang_up = 1
    sink = mqtt_sink(broker.address, "answers", pause=0.05)
    sink(spark.createDataFrame([(f"v{i}",) for i in range(6)] + [(None,)], "value string").repartition(3), 0)
    deadline = time.time() + 5
    while time.time() < deadline and len({p for t, p in broker.published if t == "answers"}) < 6:
        time.sleep(0.05)
    assert {p for t, p in broker.published if t == "answers"} == {b"v%d" % i for i in range(6)}
    assert len(broker.ids) >= 5 and not any(name in ("streamloom-sink", "streamloom-source") for name in broker.ids)
    out.close()
    with pytest.raises(OSError):
        next(iter([mqtt_sink("127.0.0.1:1", "t", tries=2, pause=0.01).send(iter(["x"]))]))


def test_settings():
    full = {"bootstrap.servers": "h:1", "ssl.truststore.location": "/x", "sasl.mechanism": "PLAIN", "group.id": "g", "auto.offset.reset": "earliest", "value.deserializer": "org.apache.kafka.common.serialization.StringDeserializer", "max.poll.records": "5"}
    source = KafkaSource("t", full)
    assert source.deserializer("value") == "string" and source.deserializer("key") == "binary"
    options = kafka_options(source)
    assert options["kafka.group.id"] == "g" and options["startingOffsets"] == "earliest" and options["kafka.ssl.truststore.location"] == "/x" and "kafka.value.deserializer" not in options
    bad = [{"odd": "1"}, {"enable.auto.commit": "true"}, {"interceptor.classes": "x"}, {"value.deserializer": "x.FloatDeserializer"}, {"auto.offset.reset": "none"}]
    for more in bad:
        with pytest.raises(ValueError):
            KafkaSource("t", {"bootstrap.servers": "h:1", **more})
    for broker in ("", "http://h:1", "h:x"):
        with pytest.raises(ValueError):
            MqttSource(broker, "t")
    with pytest.raises(ValueError):
        SocketSource("h", 0)


def test_receiver(spark):
    lines = []
    server = serve(0, lines.append)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    tcp_text("127.0.0.1", server.server_address[1])(spark.createDataFrame([("a",), ("b",), (None,)], "value string"), 0)
    deadline = time.time() + 5
    while time.time() < deadline and len(lines) < 2:
        time.sleep(0.05)
    assert sorted(lines) == ["a", "b"]
    server.shutdown()


def test_examples(spark, tmp_path):
    import centres
    from centres import met, moving
    from heart_rates import warnings
    from room_rules import inside, plain

    cloudpickle.register_pickle_by_value(centres)
    lines = lambda *texts: spark.createDataFrame([(t, 1000 * i, i) for i, t in enumerate(texts)], SCHEMA)
    heart = lines("ann 101", "bob 120", "ann 90", "ann 110", "bob 110", "ann 115", "bob 130")
    assert sorted(r.message for r in warnings(heart).result(spark).collect()) == ["ann 110 115", "bob 110 130"]
    rooms = lines("Inside,30", "Attic,5", "Inside, 20", "Inside,27", "Attic,40")
    assert [r.message for r in plain(rooms).result(spark).orderBy("seq").collect()] == ["Hot,Inside", "Cold,Attic", "Hot,Inside", "Hot,Attic"]
    assert [r.message for r in inside(rooms).result(spark).orderBy("seq").collect()] == ["Hot,30", "Hot,27"]
    assert [r.result for r in moving(lines("0,0", "10,10", "2,2", "8,8"), 2).orderBy("seq").collect()] == ["0:0.000,0.000", "1:10.000,10.000", "0:1.000,1.000", "1:9.000,9.000"]
    pairs = met(lines("1,0", "2,0"), lines("2,5", "3,5"))
    assert [(r.l_y, r.r_y) for r in pairs.collect()] == [(0.0, 5.0)]

    engine, folder = Engine(spark, str(tmp_path / "e")), str(tmp_path / "in")
    sinks = [Collect(tmp_path / "heart"), Collect(tmp_path / "room")]
    put(folder, 0, [("ann 110", 0, 0), ("ann 120", 1, 1)])
    query = warnings(stored(spark, folder, SCHEMA, "json"), sinks[0])
    engine.wait(query.submit(engine, "heart", availableNow=True))
    put(folder, 1, [("ann 130", 2, 2)])
    engine.stop()
    engine.wait(warnings(stored(spark, folder, SCHEMA, "json"), sinks[0]).submit(engine, "heart", availableNow=True))
    assert sinks[0].got() == ["ann 110 120", "ann 120 130"]
    put(str(tmp_path / "rooms"), 0, [("Inside,30", 0, 0), ("Attic,5", 1, 1)])
    engine.wait(plain(stored(spark, str(tmp_path / "rooms"), SCHEMA, "json"), sinks[1]).submit(engine, "room", availableNow=True))
    assert sinks[1].got() == ["Cold,Attic", "Hot,Inside"]


def test_builders_check_themselves(spark):
    lines = spark.createDataFrame([("a,1", 0, 0)], SCHEMA)
    source = TextInput(lines, (("k", "STRING"), ("n", "INTEGER")))
    p = Pattern("a", F.lit(True))
    whole = CepQuery("app").read(source).sequence(p).within(10).action(Action(("$a.k",)))
    assert [r.message for r in whole.result(spark).collect()] == ["a"]
    rules = RuleQuery("app", source)
    for bad in (
        lambda: CepQuery("").read(source).sequence(p).within(10).action(Action(("x",))).result(spark),
        lambda: CepQuery("app").sequence(p).within(10).action(Action(("x",))).result(spark),
        lambda: CepQuery("app").read(source).within(10).action(Action(("x",))).result(spark),
        lambda: CepQuery("app").read(source).sequence(p).action(Action(("x",))).result(spark),
        lambda: CepQuery("app").read(source).sequence(p).within(10).result(spark),
        lambda: CepQuery("app").sequence(p, p),
        lambda: CepQuery("app").within(0),
        lambda: TextInput(lines, ()),
        lambda: TextInput(lines, (("k", "STRING"), ("k", "LONG"))),
        lambda: rules.result(spark),
        lambda: rules.rule(Condition("EQ", "k", "a"), Action(("x",))).states("s"),
        lambda: rules.states("s").rule(Condition("EQ", "k", "a"), Action(("x",))),
        lambda: rules.states("s").final("s", Action(("x",))).final("s", Action(("y",))),
        lambda: RuleQuery("", source),
    ):
        with pytest.raises(ValueError):
            bad()
    two = whole.sequence(p, Pattern("b", F.lit(True), STRICT)).qualify(lambda m: F.size(m["b"]) == 1)
    assert two.result(spark).count() == 0
