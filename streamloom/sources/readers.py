"""Live and stored sources as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamloom.sources.configs import KafkaSource, MqttSource, SocketSource


def socket_text(spark: SparkSession, source: SocketSource) -> DataFrame:
    """Lines as `value`, with their arrival as `timestamp`. Not replayable after a failure."""
    return spark.readStream.format("socket").option("host", source.host).option("port", source.port).option("includeTimestamp", True).load()


def kafka_options(source: KafkaSource) -> dict[str, str]:
    """The reader's options for a source; the checkpoint keeps offsets, so commits are left out."""
    own = ("auto.offset.reset", "enable.auto.commit", "auto.commit.interval.ms", "key.deserializer", "value.deserializer")
    out = {"subscribe": source.topic, "startingOffsets": source.consumer.get("auto.offset.reset", "latest")}
    return out | {f"kafka.{k}": str(v) for k, v in source.consumer.items() if k not in own}


def kafka(spark: SparkSession, source: KafkaSource) -> DataFrame:
    """key, value, topic, partition, offset and timestamp of all partitions of the topic.

    Needs Spark's Kafka connector on the class path; raises where it is missing.
    """
    reader = spark.readStream.format("kafka")
    for key, value in kafka_options(source).items():
        reader = reader.option(key, value)
    df = reader.load()
    return df.withColumns({side: F.col(side).cast(source.deserializer(side)) for side in ("key", "value")})


def mqtt(spark: SparkSession, source: MqttSource) -> DataFrame:
    """topic and payload (binary) of each message."""
    from streamloom.sources.mqtt import MqttDataSource

    spark.dataSource.register(MqttDataSource)
    return spark.readStream.format("mqtt").option("broker", source.broker).option("topic", source.topic).load()


def stored(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """A folder of files as a stream, for replay and tests."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def events(spark: SparkSession, source: SocketSource | KafkaSource | MqttSource) -> DataFrame:
    """(value string, ts ms, seq) of any source: ts by its timestamp function, or the clock; seq is the clock's microsecond."""
    if isinstance(source, SocketSource):
        df = socket_text(spark, source)
    elif isinstance(source, KafkaSource):
        df = kafka(spark, source)
    else:
        df = mqtt(spark, source).withColumn("value", F.col("payload"))
    value = F.col("value").cast("string")
    clock = F.col("timestamp") if "timestamp" in df.columns else F.current_timestamp()
    ts = source.timestamp(value) if source.timestamp else F.unix_millis(clock)
    return df.select(value.alias("value"), ts.cast("long").alias("ts"), F.unix_micros(clock).alias("seq"))


def with_event_time(df: DataFrame, ms=None, name: str = "event_time") -> DataFrame:
    """df with an event time from a column of ms, or the clock where there is none."""
    return df.withColumn(name, F.current_timestamp() if ms is None else F.timestamp_millis(ms))
