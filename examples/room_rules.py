"""Rules on lines `Place,Temperature` over TCP: python examples/room_rules.py HOST PORT."""

import sys

from pyspark.sql import SparkSession

from streamloom.plans.builders import RuleQuery, TextInput
from streamloom.plans.rules import Action, Condition
from streamloom.sources.configs import SocketSource
from streamloom.sources.sinks import console
from streamloom.streaming.engine import Engine

FIELDS = (("Place", "STRING"), ("Temperature", "INTEGER"))


def plain(source, sink=None) -> RuleQuery:
    hot, cold = Condition("GT", "Temperature", 25), Condition("LT", "Temperature", 10)
    return RuleQuery("examples", TextInput(source, FIELDS)).rule(hot, Action(("Hot", "$Place")), sink).rule(cold, Action(("Cold", "$Place")), sink)


def inside(source, sink=None) -> RuleQuery:
    """Hot or cold, but only after the place became Inside."""
    enter, leave = Condition("EQ", "Place", "Inside"), Condition("NEQ", "Place", "Inside")
    query = RuleQuery("examples", TextInput(source, FIELDS)).states("out")
    query = query.move("out", Condition("AND", parts=(enter, Condition("GT", "Temperature", 25))), "hot").move("out", enter, "in")
    query = query.move("in", leave, "out").move("in", Condition("GT", "Temperature", 25), "hot").move("hot", leave, "out").move("hot", Condition("LE", "Temperature", 25), "in")
    return query.final("hot", Action(("Hot", "$Temperature")), sink)


if __name__ == "__main__":
    spark = SparkSession.builder.appName("room rules").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    engine = Engine(spark, spark.conf.get("spark.sql.warehouse.dir") + "/_engine")
    engine.wait(plain(SocketSource(sys.argv[1], int(sys.argv[2])), console).submit(engine, "room-rules"))
