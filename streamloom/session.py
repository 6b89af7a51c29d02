"""Session helpers shared by every operator: worker imports, shared folders, staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_own_dirs: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


#: Bounds on batches, set where nobody set others.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.parquet.columnarReaderBatchSize": "256",
}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the rows of Arrow and Parquet batches.

    Long texts make row counts a poor measure of memory, so Arrow batches are kept to 1,000 rows
    and 16 MB, and the vectors that Parquet columns are read into to 256 rows. Bounds that the
    session was given otherwise stay as they are.
    """
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, environment.get("PYTHONPATH")) if x)
    for name, bound in _BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, bound)
    return spark


def partitions_for(df: DataFrame, size: int = 128 << 20, least: int | None = None) -> int:
    """Partitions of about `size` bytes by the sizes of what df reads, and no fewer than least (else the session's)."""
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        estimate = sum(int(leaves.apply(i).stats().sizeInBytes().toString()) for i in range(leaves.size()))
    except AttributeError:  # a session without a JVM of its own
        return least
    return max(least, min(estimate // size + 1, 100_000))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set.

    Where it is not, a local master gets a temporary folder of its own and any other master the
    warehouse, which executors share too.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="streamloom-")
        else:
            _own_dirs[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streamloom"
    return _own_dirs[app]


#: Rows of a few numbers in one file of a small staged table.
ROWS = 250_000


def stage(df: DataFrame, name: str = "stage", whole: bool = False, rows: int | None = None) -> DataFrame:
    """Write a result to the shared folder and read it again: cuts lineage, survives lost executors.

    Small results of many partitions are written as fewer files: four for each core at most, or one
    for every 64 MB that df reads, if that is more; where a caller knows that there are about `rows`
    narrow rows, one for every ROWS of them. whole keeps one file for each partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not whole:
        files = partitions_for(df, 64 << 20, 4 * spark.sparkContext.defaultParallelism)
        df = df.coalesce(files if rows is None else min(files, rows // ROWS + 1))
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a folder, as the JVM has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def drop_staged(spark: SparkSession) -> int:
    """Delete all tables staged so far and return their number; results that still read them are lost.

    Without it they go when the driver ends in order.
    """
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files, place = _files(spark, path)
        files.delete(place, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
