"""Events a second of live operators, and seconds for N queries on one source with and without sharing; one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from streamloom.operators.cep import RELAXED, Pattern
from streamloom.operators.stream import Stream
from streamloom.operators.windows import TimeWindow
from streamloom.plans.queries import DAY, events
from streamloom.sources.readers import stored
from streamloom.streaming.engine import Engine


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    folder = tempfile.mkdtemp(prefix="bench-live-")
    rows = events(spark, sf_dir).df
    rows.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    n, schema = rows.count(), rows.schema
    source = lambda s: stored(s, f"{folder}/in", schema, files_per_batch=1)
    is_kind = lambda k: F.col("event_type") == k
    plans = {
        "time_window": lambda df: Stream(df).window(TimeWindow(DAY, DAY), key_by="user_id").summarise(n="count", cents=("sum", "cents")),
        "keyed_reduce": lambda df: Stream(df).reduce_by_key("user_id", "cents"),
        "pattern": lambda df: Stream(df).cep([Pattern("look", is_kind("view")), Pattern("buy", is_kind("purchase"), RELAXED)], DAY, "user_id"),
    }
    out: dict = {"events": n, "events_per_second": {}, "seconds_of_n_queries": {}}
    for name, plan in [("warm-up", plans["keyed_reduce"]), *plans.items()]:
        t = time.perf_counter()
        plan(source(spark)).writeStream.format("noop").option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
        if name != "warm-up":
            out["events_per_second"][name] = round(n / (time.perf_counter() - t))

    class Nothing:
        def send(self, texts) -> None:
            for _ in texts:
                pass

        def __call__(self, df, number) -> None:
            df.write.format("noop").mode("overwrite").save()

    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for k in (1, 10, 50):
        for kind in ("routes", "plans", "alone"):
            engine = Engine(spark, f"{folder}/engine-{k}-{kind}")
            t = time.perf_counter()
            ids = []
            for i in range(k):
                route = lambda i=i: (F.col("cents") % 97 == i, F.concat_ws(" ", "event_type", "cents"))
                plan = lambda df, i=i: df.where(F.col("cents") % 97 == i).select(F.concat_ws(" ", "event_type", "cents").alias("value"))
                name = "s" if kind != "alone" else f"s{i}"
                if kind == "routes":
                    ids.append(engine.submit_route("bench", name, source, route, Nothing(), processingTime="0 seconds"))
                else:
                    ids.append(engine.submit("bench", name, source, plan, Nothing(), processingTime="0 seconds"))
            for run in {engine._run(i).running for i in ids}:
                run.processAllAvailable()
            out["seconds_of_n_queries"][f"{k} {kind}"] = round(time.perf_counter() - t, 2)
            assert not engine.failures(), engine.failures()
            engine.stop()
    print(json.dumps(out | {"sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus)}))
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
