"""Warns of a heart rate that rises twice in a row: lines `name rate` over TCP: python examples/heart_rates.py HOST PORT."""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from streamloom.operators.cep import STRICT, Pattern
from streamloom.plans.builders import CepQuery, TextInput
from streamloom.plans.rules import Action
from streamloom.sources.configs import SocketSource
from streamloom.sources.sinks import console
from streamloom.streaming.engine import Engine


def warnings(source, sink=None) -> CepQuery:
    high = F.col("rate") > 100
    rising = lambda match: match["second"][0]["rate"] > match["first"][0]["rate"]
    query = CepQuery("examples").read(TextInput(source, (("name", "STRING"), ("rate", "INTEGER")), " "), key_by="name")
    return query.sequence(Pattern("first", high), Pattern("second", high, STRICT)).within(60_000).qualify(rising).action(Action(("$first.name", "$first.rate", "$second.rate"), " "), sink)


if __name__ == "__main__":
    spark = SparkSession.builder.appName("heart rates").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    engine = Engine(spark, spark.conf.get("spark.sql.warehouse.dir") + "/_engine")
    engine.wait(warnings(SocketSource(sys.argv[1], int(sys.argv[2])), console).submit(engine, "heart-rates"))
