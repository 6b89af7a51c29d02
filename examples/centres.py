"""Moving centres of points (lines `x,y` over TCP), and joins of readings with them: python examples/centres.py HOST PORT."""

import sys

from pyspark.sql import DataFrame, SparkSession

from streamloom.functions.text import parse_delimited
from streamloom.operators.stream import Stream
from streamloom.operators.windows import CountWindow
from streamloom.sources.configs import SocketSource
from streamloom.sources.readers import events
from streamloom.sources.sinks import console
from streamloom.streaming.engine import Engine


class Centres:
    """Online k-means: each point moves its nearest centre towards itself; the result is that centre."""

    columns = ("x", "y")

    def __init__(self, k: int):
        self.k = k

    def initialize(self):
        return [], None

    def update(self, state, row):
        centres, _ = state
        if len(centres) < self.k:
            centres.append([row["x"], row["y"], 1])
            return centres, len(centres) - 1
        near = min(range(self.k), key=lambda i: (centres[i][0] - row["x"]) ** 2 + (centres[i][1] - row["y"]) ** 2)
        c = centres[near]
        c[2] += 1
        c[0] += (row["x"] - c[0]) / c[2]
        c[1] += (row["y"] - c[1]) / c[2]
        return centres, near

    def produce(self, state):
        centres, near = state
        return f"{near}:{centres[near][0]:.3f},{centres[near][1]:.3f}"


def points(lines: DataFrame) -> Stream:
    return Stream(parse_delimited(lines, "value", [("x", "DOUBLE"), ("y", "DOUBLE")]).drop("value"))


def moving(lines: DataFrame, k: int = 3) -> DataFrame:
    return points(lines).apply_stateful(Centres(k), "string")


def met(left: DataFrame, right: DataFrame, size: int = 4) -> DataFrame:
    """Pairs of points with one x in windows of `size` rows of both streams together."""
    return points(left).join(points(right), lambda a, b: a("x") == b("x"), CountWindow(size, size))


if __name__ == "__main__":
    spark = SparkSession.builder.appName("centres").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    engine = Engine(spark, spark.conf.get("spark.sql.warehouse.dir") + "/_engine")
    engine.wait(engine.submit_stateful("examples", moving(events(spark, SocketSource(sys.argv[1], int(sys.argv[2])))), console, name="centres"))
