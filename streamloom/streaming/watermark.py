"""Watermarks and late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions.ordered import dealt
from streamloom.streaming.live import live_drop_late, live_punctuated


def periodic(df: DataFrame, event_time: str, expected_delay_ms: int = 0) -> DataFrame:
    """A watermark `expected_delay_ms` behind the latest event time seen (not the wall clock)."""
    if expected_delay_ms < 0:
        raise ValueError("the expected delay must not be negative")
    return df.withWatermark(event_time, f"{expected_delay_ms} milliseconds")


def clocked(df: DataFrame, period_ms: int = 1000, expected_delay_ms: int = 0, ts: str = "ts", seq: str = "seq", mark: str = "is_watermark") -> DataFrame:
    """A live stream with a watermark row every period: `mark` is true there, and ts the wall clock less the expected delay.

    Rows of the stream have mark false. Live windows and ordered unions take such rows to move time
    on where no data come (Stream(..., watermark=mark)); all other columns of a mark are null.
    """
    if period_ms <= 0 or expected_delay_ms < 0:
        raise ValueError("the period must be positive and the expected delay not negative")
    each = max(1, 1000 // period_ms)
    ticks = df.sparkSession.readStream.format("rate").option("rowsPerSecond", each).load()
    if period_ms > 1000:
        ticks = ticks.where(F.col("value") % (period_ms // 1000) == 0)
    marks = ticks.select((F.unix_millis("timestamp") - expected_delay_ms).cast(df.schema[ts].dataType).alias(ts), F.unix_micros("timestamp").cast(df.schema[seq].dataType).alias(seq), F.lit(True).alias(mark))
    return df.withColumn(mark, F.lit(False)).unionByName(marks, allowMissingColumns=True)


def drop_late(df: DataFrame, mark: str, ts: str = "ts", seq: str = "seq", key_by: str | None = None) -> DataFrame:
    """df without rows whose time is at most that of a watermark row (mark true) before them, or null; watermark rows stay.

    Rows come in order of seq; live ones within their micro-batch. Without a key the stream is one task.
    """
    if df.isStreaming:
        return live_drop_late(df, mark, ts, seq, key_by)
    before = Window.partitionBy(*([key_by] if key_by else [])).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = df.withColumn("_seen", F.max(F.when(F.col(mark), F.col(ts))).over(before))
    return seen.where(F.coalesce(F.col(mark), F.lit(False)) | F.col(ts).isNotNull() & (F.col("_seen").isNull() | (F.col(ts) > F.col("_seen")))).drop("_seen")


def punctuated(df: DataFrame, is_watermark: Column, watermark_ts: Column, ts: str = "ts", seq: str = "seq", key_by: str | None = None) -> DataFrame:
    """The rows that aren't late, without the punctuation rows, watermark so far as `watermark`.

    Rows come in order of seq. A punctuation row sets the watermark to its time if that is later,
    and is consumed; a row is late if its ts is at most the watermark before it, or null. A column
    of df named watermark is replaced. Live streams keep the watermark in the state store, and take
    rows of a micro-batch in order of seq.
    """
    rows = df.withColumn("_wm", F.when(is_watermark, watermark_ts).cast("long")).withColumn("_is", F.coalesce(is_watermark, F.lit(False)))
    if df.isStreaming:
        return live_punctuated(rows, "_is", "_wm", ts, seq, key_by)
    rows = rows.drop("watermark")
    if key_by:
        before = Window.partitionBy(key_by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
        marked = rows.withColumn("watermark", F.max("_wm").over(before))
    else:
        rows = dealt(rows, seq)
        tops = rows.groupBy("_pid").agg(F.max("_wm").alias("_top"))
        tops = tops.select("_pid", F.max("_top").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_o"))
        inside = Window.partitionBy("_pid").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
        # One row for each partition of the dealt rows.
        marked = rows.join(F.broadcast(tops), "_pid").withColumn("watermark", F.greatest(F.max("_wm").over(inside), "_o")).drop("_pid", "_o")
    kept = marked.where(~F.col("_is") & F.col(ts).isNotNull() & (F.col("watermark").isNull() | (F.col(ts) > F.col("watermark"))))
    return kept.drop("_wm", "_is")
