"""Finite-state machines over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from streamloom.streaming.live import live_scan
from streamloom.streaming.scan import column_scan


def state_transition(
    df: DataFrame, initial: str, finals: set[str], table: dict[str, list[tuple[Column, str]]], ts: str = "ts", seq: str = "seq", key_by: str | None = None
) -> DataFrame:
    """The rows after which the machine is in a final state, with that state added as `state`.

    table lists (condition, next state) of each state in order; the first true one is taken, and
    without one the state stays. Conditions are evaluated as columns before the ordered pass, which
    only looks them up. A null condition is false. A column of df named state is replaced, after
    the conditions have seen it. Live streams keep the state in the state store.
    """
    conditions = [c for moves in table.values() for c, _ in moves]
    at, moves_of = 0, {}
    for state, moves in table.items():
        moves_of[state] = [(at + i, to) for i, (_, to) in enumerate(moves)]
        at += len(moves)
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit("1")).otherwise(F.lit("0")) for c in conditions]
    rows = df.withColumn("_flags", F.concat(F.lit(""), *flags))
    final, known = frozenset(finals), {}

    def move(state: str, flags: str) -> str:
        to = known.get((state, flags))
        if to is None:
            to = known[state, flags] = next((to for i, to in moves_of.get(state, ()) if flags[i] == "1"), state)
        return to

    result = StructField("state", StringType())
    if df.isStreaming:
        kept = [c for c in df.columns if c != "state"]

        def live_step(state, row):
            state = move(state, row["_flags"])
            return state, [(*(row[c] for c in kept), state)] if state in final else []

        return live_scan(rows, key_by, [ts, seq], StructType([*(df.schema[c] for c in kept), result]), lambda: initial, live_step)

    def step(state, flags):
        state = move(state, flags)
        return state, state, state in final

    return column_scan(rows, key_by, [ts, seq], ["_flags"], result, lambda: initial, step, drop=("_flags",))
