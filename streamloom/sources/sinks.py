"""Sinks: text over TCP and MQTT messages, for batches and micro-batches.

A sink is called with (rows, number of the micro-batch) on the driver, and its `send(texts)` on an
executor, once for each partition.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame

from streamloom.session import ready
from streamloom.sources.mqtt import MqttClient


def framed(text: str) -> bytes:
    """A newline is added only if the text holds none."""
    return (text if "\n" in text else text + "\n").encode()


class _TextSink:
    column = "value"

    def __call__(self, df: DataFrame, _batch: int = 0) -> None:
        ready(df.sparkSession)
        send = self.send
        df.where(df[self.column].isNotNull()).select(self.column).foreachPartition(lambda rows: send(str(r[0]) for r in rows))


@dataclass(frozen=True)
class tcp_text(_TextSink):  # noqa: N801 -- called like a function
    """Sends the column's texts, one connection for each partition that has any."""

    host: str
    port: int
    column: str = "value"

    def send(self, texts: Iterator[str]) -> None:
        out = None
        try:
            for text in texts:
                out = out or socket.create_connection((self.host, self.port), 10)
                out.sendall(framed(text))
        finally:
            if out:
                out.close()


@dataclass(frozen=True)
class mqtt(_TextSink):  # noqa: N801
    """Publishes the column's texts at quality of service 0.

    Every `together` texts, and at the end, it waits for the broker's answer to a ping. On errors it
    connects anew, a bounded number of times in a row, and sends again what wasn't answered for: the
    broker reads each text at least once.
    """

    broker: str
    topic: str
    column: str = "value"
    tries: int = 5
    pause: float = 1.0
    together: int = 64

    def send(self, texts: Iterator[str]) -> None:
        client = None
        try:
            while part := list(islice(texts, self.together)):
                for left in range(self.tries, 0, -1):
                    try:
                        client = client or MqttClient(self.broker, "streamloom-sink")
                        for text in part:
                            client.publish(self.topic, text.encode())
                        client.confirm()
                        break
                    except OSError:
                        client = client and client.drop()
                        if left == 1:
                            raise
                        time.sleep(self.pause)
        finally:
            if client:
                client.close()


def console(df: DataFrame, number: int = 0) -> None:
    """Prints the rows of a micro-batch; for trying things out."""
    print(f"--- batch {number}")
    df.show(truncate=False)
