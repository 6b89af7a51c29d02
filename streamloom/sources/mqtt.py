"""MQTT 3.1.1 at quality of service 0, as a Python data source and a writer; no library needed."""

from __future__ import annotations

import socket
import struct
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def _length(n: int) -> bytes:
    out = bytearray()
    while True:
        n, digit = n >> 7, n & 127
        out.append(digit | (128 if n else 0))
        if not n:
            return bytes(out)


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">H", len(raw)) + raw


class MqttClient:
    """A connection to a broker, kept alive by pings; its id is the given name and a random part."""

    def __init__(self, broker: str, name: str, timeout: float = 5.0, keep_alive: int = 60):
        host, _, port = broker.removeprefix("tcp://").partition(":")
        self.socket = socket.create_connection((host, int(port or 1883)), timeout)
        self.buffer, self.lock, self.closed = b"", threading.Lock(), threading.Event()
        self.keep_alive, self.pinged, self.answered = keep_alive, 0, 0
        body = _text("MQTT") + bytes([4, 2]) + struct.pack(">H", keep_alive) + _text(f"{name}-{uuid.uuid4().hex[:12]}")
        try:
            self._send(b"\x10" + _length(len(body)) + body)
            kind, answer = self._packet(timeout)
            if kind >> 4 != 2 or answer[1] != 0:
                raise ConnectionError("the broker refused the connection")
        except BaseException:
            self.drop()
            raise
        threading.Thread(target=self._pings, daemon=True).start()

    def _send(self, data: bytes) -> None:
        with self.lock:
            self.socket.sendall(data)

    def _pings(self) -> None:
        """PINGREQ three times in the time after which the broker would hang up."""
        while not self.closed.wait(self.keep_alive / 3):
            try:
                self._ping()
            except OSError:
                return

    def _ping(self) -> int:
        with self.lock:
            self.socket.sendall(b"\xc0\x00")
            self.pinged += 1
            return self.pinged

    def confirm(self, timeout: float = 5.0) -> None:
        """Wait until the broker has answered a ping, and so has read all that was sent before."""
        wanted = self._ping()
        while self.answered < wanted:
            self._packet(timeout)

    def drop(self) -> None:
        """Close the socket without a word."""
        self.closed.set()
        self.socket.close()

    def _more(self) -> None:
        data = self.socket.recv(65536)
        if not data:
            raise ConnectionError("the broker closed the connection")
        self.buffer += data

    def _packet(self, timeout: float) -> tuple[int, bytes]:
        self.socket.settimeout(timeout)
        while True:
            value = shift = 0
            for i, b in enumerate(self.buffer[1:5], 1):
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    if len(self.buffer) >= 1 + i + value:
                        kind, body = self.buffer[0], self.buffer[1 + i : 1 + i + value]
                        self.buffer = self.buffer[1 + i + value :]
                        self.answered += kind >> 4 == 13
                        return kind, body
                    break
            self._more()

    def publish(self, topic: str, payload: bytes) -> None:
        body = _text(topic) + payload
        self._send(b"\x30" + _length(len(body)) + body)

    def subscribe(self, topic: str) -> None:
        body = b"\x00\x01" + _text(topic) + b"\x00"
        self._send(b"\x82" + _length(len(body)) + body)

    def messages(self, seconds: float) -> Iterator[tuple[str, bytes]]:
        """Messages that come within the time."""
        end = time.monotonic() + seconds
        while (left := end - time.monotonic()) > 0:
            try:
                kind, body = self._packet(left)
            except TimeoutError:
                return
            if kind >> 4 == 3:
                n = struct.unpack(">H", body[:2])[0]
                yield body[2 : 2 + n].decode(), body[2 + n :]

    def close(self) -> None:
        try:
            self._send(b"\xe0\x00")
        except OSError:
            pass
        self.drop()


class _Reader(SimpleDataSourceStreamReader):
    """Polls the subscription; messages can't be asked for again, as quality of service 0 has it."""

    def __init__(self, options: dict):
        self.options, self.client, self.recent, self.lost = options, None, {}, 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        rows = []
        try:
            if self.client is None:
                self.client = MqttClient(self.options["broker"], self.options.get("client", "streamloom-source"), keep_alive=int(self.options.get("keepalive", "60")))
                self.client.subscribe(self.options["topic"])
            for message in self.client.messages(float(self.options.get("poll", "0.5"))):
                rows.append(message)
        except OSError:  # connect anew with the next micro-batch; what came so far is given
            self.client = self.client and self.client.drop()
            self.lost += 1
            if self.lost > int(self.options.get("tries", "5")):
                raise
        else:
            self.lost = 0
        end = {"n": start["n"] + len(rows)}
        self.recent[(start["n"], end["n"])] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.recent.get((start["n"], end["n"]), []))

    def commit(self, end: dict) -> None:
        self.recent = {k: v for k, v in self.recent.items() if k[1] > end["n"]}


class MqttDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mqtt"

    def schema(self) -> str:
        return "topic string, payload binary"

    def simpleStreamReader(self, schema):
        return _Reader(self.options)
