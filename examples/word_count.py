"""Counts words of lines that come over TCP: python examples/word_count.py HOST PORT [OUT_HOST OUT_PORT]."""

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.operators.stream import Stream
from streamloom.sources.configs import SocketSource
from streamloom.sources.readers import events
from streamloom.sources.sinks import console, tcp_text
from streamloom.streaming.engine import Engine


def counts(lines: DataFrame) -> DataFrame:
    """`word count` as value, for each word as it comes."""
    words = Stream(lines).flat_map(word=F.split("value", r"\s+")).filter(F.col("word") != "")
    running = words.map(word=F.col("word"), n=F.lit(1)).reduce_by_key("word", "n")
    return running.select(F.concat_ws(" ", "word", "n").alias("value"), "ts", "seq")


if __name__ == "__main__":
    spark = SparkSession.builder.appName("word count").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    host, port, *out = sys.argv[1:]
    sink = tcp_text(out[0], int(out[1])) if out else console
    engine = Engine(spark, spark.conf.get("spark.sql.warehouse.dir") + "/_engine")
    engine.wait(engine.submit_stateful("examples", counts(events(spark, SocketSource(host, int(port)))), sink, name="word-count"))
