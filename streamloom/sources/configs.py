"""Validated descriptions of sources and sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

#: Consumer settings of Kafka's clients (fixed values).
_KAFKA_KEYS = frozenset(
    "allow.auto.create.topics auto.commit.interval.ms auto.include.jmx.reporter auto.offset.reset bootstrap.servers check.crcs client.dns.lookup client.id client.rack "
    "connections.max.idle.ms default.api.timeout.ms enable.auto.commit enable.metrics.push exclude.internal.topics fetch.max.bytes fetch.max.wait.ms fetch.min.bytes "
    "group.id group.instance.id group.protocol group.remote.assignor heartbeat.interval.ms interceptor.classes isolation.level key.deserializer max.partition.fetch.bytes "
    "max.poll.interval.ms max.poll.records metadata.max.age.ms metadata.recovery.rebootstrap.trigger.ms metadata.recovery.strategy metric.reporters metrics.num.samples "
    "metrics.recording.level metrics.sample.window.ms partition.assignment.strategy receive.buffer.bytes reconnect.backoff.max.ms reconnect.backoff.ms request.timeout.ms "
    "retry.backoff.max.ms retry.backoff.ms security.protocol security.providers send.buffer.bytes session.timeout.ms socket.connection.setup.timeout.max.ms "
    "socket.connection.setup.timeout.ms value.deserializer".split()
)
_KAFKA_FAMILIES = ("ssl.", "sasl.")
#: Deserializers whose results the source can give, and the column type of each.
DESERIALIZERS = {"ByteArrayDeserializer": "binary", "StringDeserializer": "string"}


@dataclass(frozen=True)
class SocketSource:
    """Newline-framed UTF-8 text from a server; timestamp, if given, makes a line's event time (ms) of it."""

    host: str
    port: int
    timestamp: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if not self.host or not 0 < self.port < 65536:
            raise ValueError("a socket source needs a host and a port")


@dataclass(frozen=True)
class KafkaSource:
    """One topic; consumer settings by their usual names, unknown ones rejected.

    Offsets are kept in the checkpoint, so that automatic commits and interceptors can't be had;
    keys and values come as the deserializers say (bytes without one).
    """

    topic: str
    consumer: dict[str, str] = field(default_factory=dict)
    timestamp: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if not self.topic or "bootstrap.servers" not in self.consumer:
            raise ValueError("a Kafka source needs a topic and bootstrap.servers")
        if unknown := sorted(k for k in self.consumer if k not in _KAFKA_KEYS and not k.startswith(_KAFKA_FAMILIES)):
            raise ValueError(f"unknown consumer settings: {unknown}")
        if str(self.consumer.get("enable.auto.commit", "false")).lower() != "false" or "interceptor.classes" in self.consumer:
            raise ValueError("offsets are kept in the checkpoint: no automatic commits, no interceptors")
        for side in ("key", "value"):
            if self.deserializer(side) is None:
                raise ValueError(f"{side}.deserializer must be one of {sorted(DESERIALIZERS)}")
        if self.consumer.get("auto.offset.reset", "latest") not in ("latest", "earliest"):
            raise ValueError("auto.offset.reset must be latest or earliest")

    def deserializer(self, side: str) -> str | None:
        name = str(self.consumer.get(f"{side}.deserializer", "ByteArrayDeserializer")).rpartition(".")[2]
        return DESERIALIZERS.get(name)


@dataclass(frozen=True)
class MqttSource:
    """One topic of a broker (host, host:port or tcp://host:port), quality of service 0."""

    broker: str
    topic: str
    timestamp: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if not self.broker or not self.topic:
            raise ValueError("an MQTT source needs a broker and a topic")
        host, _, port = self.broker.removeprefix("tcp://").partition(":")
        if not host or "/" in host or port and not port.isdigit():
            raise ValueError(f"{self.broker} is no broker address")
