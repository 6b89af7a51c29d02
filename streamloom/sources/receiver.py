"""A server that prints the lines that text sinks send it: python -m streamloom.sources.receiver PORT."""

from __future__ import annotations

import socketserver
import sys


class _Lines(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        for line in self.rfile:
            self.server.show(line.decode(errors="replace").rstrip("\n"))


def serve(port: int, show=print, host: str = "127.0.0.1") -> socketserver.ThreadingTCPServer:
    """A server that hands each line it gets to show; its serve_forever runs it."""
    server = socketserver.ThreadingTCPServer((host, port), _Lines)
    server.daemon_threads, server.show = True, show
    return server


if __name__ == "__main__":
    serve(int(sys.argv[1]), host="0.0.0.0").serve_forever()
