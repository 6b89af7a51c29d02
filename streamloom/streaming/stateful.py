"""User-defined stateful functions, over stored rows and over live streams."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from streamloom.streaming.live import live_scan
from streamloom.streaming.scan import column_scan


class StatefulFunction(Protocol):
    """State made by initialize, changed by update for each row, turned into a result by produce.

    A function that has an attribute `columns` sees only those columns in its rows.
    """

    def initialize(self): ...

    def update(self, state, row: dict): ...

    def produce(self, state): ...


def apply_stateful(df: DataFrame, function: StatefulFunction, result_type: str, ts: str = "ts", seq: str = "seq", key_by: str | None = None) -> DataFrame:
    """df with the function's result after each row as `result`, in order within each key.

    A column of df named result is replaced. Live streams keep their state in the state store; rows
    of a micro-batch are put in order, and across micro-batches arrival decides.
    """
    inputs = list(getattr(function, "columns", None) or df.columns)
    (result,) = StructType.fromDDL(f"result {result_type}").fields
    if df.isStreaming:
        kept = [c for c in df.columns if c != "result"]

        def live_step(state, row):
            state = function.update(state, {c: row[c] for c in inputs})
            return state, [(*(row[c] for c in kept), function.produce(state))]

        return live_scan(df, key_by, [ts, seq], StructType([*(df.schema[c] for c in kept), result]), function.initialize, live_step)

    def step(state, *values):
        state = function.update(state, dict(zip(inputs, values, strict=True)))
        return state, function.produce(state), True

    return column_scan(df, key_by, [ts, seq], inputs, StructField("result", result.dataType), function.initialize, step)


def apply_stateful_streaming(df: DataFrame, function: StatefulFunction, result_type: str, key_by: str, order: list[str]) -> DataFrame:
    """(key, result) for each row of a live stream; state lives in the state store."""
    schema = StructType([StructField("key", df.schema[key_by].dataType), *StructType.fromDDL(f"result {result_type}").fields])

    def step(state, row):
        state = function.update(state, row)
        return state, [(row[key_by], function.produce(state))]

    return live_scan(df, key_by, order, schema, function.initialize, step)
