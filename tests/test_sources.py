"""Live sources: lines over TCP, messages of a stub broker, and Kafka where it is missing."""

import socket
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_engine import Broker

from streamloom.operators.stream import Stream
from streamloom.sources.configs import KafkaSource, MqttSource, SocketSource
from streamloom.sources.mqtt import MqttClient
from streamloom.sources.readers import events, kafka, with_event_time
from streamloom.streaming.watermark import periodic


def gathered(df, enough, seconds=40):
    out = []
    query = df.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).start()
    end = time.time() + seconds
    while time.time() < end and not enough(out):
        time.sleep(0.2)
    query.stop()
    return out


def test_lines(spark):
    server = socket.create_server(("127.0.0.1", 0))
    stop = threading.Event()

    def serve():
        while not stop.is_set():
            c, _ = server.accept()
            threading.Thread(target=lambda: (c.sendall("é one:100\ntwo:250\n".encode()), stop.wait(60)), daemon=True).start()

    threading.Thread(target=serve, daemon=True).start()
    port = server.getsockname()[1]
    told = events(spark, SocketSource("127.0.0.1", port, lambda v: F.split_part(v, F.lit(":"), F.lit(-1)).cast("long")))
    rows = gathered(told, lambda out: len(out) >= 2)
    assert sorted((r.value, r.ts) for r in rows) == [("two:250", 250), ("é one:100", 100)] and all(r.seq > 10**15 for r in rows)
    now = time.time() * 1000
    rows = gathered(events(spark, SocketSource("127.0.0.1", port)), lambda out: len(out) >= 2)
    assert all(abs(r.ts - now) < 60_000 for r in rows)
    stop.set()


def test_messages(spark):
    broker = Broker()
    df = Stream(events(spark, MqttSource(broker.address, "t", lambda v: v.cast("long")))).map(twice=F.col("ts") * 2).df
    publisher = MqttClient(broker.address, "p")

    def enough(out):
        publisher.publish("t", b"21")
        return len(out) >= 2

    rows = gathered(df, enough)
    publisher.close()
    assert len(rows) >= 2 and {r.twice for r in rows} == {42}


def test_kafka_is_gated(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka(spark, KafkaSource("t", {"bootstrap.servers": "h:1"}))


def test_event_times(spark):
    df = spark.createDataFrame([(1_500, "a")], "ms long, v string")
    assert with_event_time(df, F.col("ms")).select(F.unix_millis("event_time")).first()[0] == 1500
    assert abs(with_event_time(df).select(F.unix_millis("event_time")).first()[0] - time.time() * 1000) < 60_000
    live = spark.readStream.format("rate").load()
    assert periodic(live, "timestamp").isStreaming
    with pytest.raises(ValueError):
        periodic(live, "timestamp", -1)
