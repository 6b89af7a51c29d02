"""Live twins of the ordered operators: state in the state store, carried over micro-batches and restarts.

Every twin is a step function over rows in order. Rows of one micro-batch and key are put in order
before they are stepped through; across micro-batches arrival decides, as in any push engine. The
state store needs the RocksDB provider. Without a key all rows are one stream in one task.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from streamloom.session import ready
from streamloom.streaming.scan import as_keys, to_batch


class _Machine(StatefulProcessor):
    """start and step over the rows of a key, with the state pickled between micro-batches."""

    def __init__(self, names: list[str], order: list[str], start: Callable, step: Callable):
        self.names, self.order, self.start, self.step = names, order, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()
        make = Row(*self.names)
        first = lambda row: tuple((row[c] is not None, row[c]) for c in self.order)
        for row in sorted((r.asDict(True) for r in rows), key=first):
            state, out = self.step(state, row)
            for values in out:
                yield make(*values)
        self.state.update((pickle.dumps(state),))

    def close(self) -> None:
        pass


def live_scan(df: DataFrame, key, order: list[str], schema: StructType | str, start: Callable[[], object], step: Callable) -> DataFrame:
    """The rows that step gives for every row of a live stream, in order within each key; as sorted_scan."""
    ready(df.sparkSession)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    groups = df.groupBy(*as_keys(key)) if key else df.withColumn("_all", F.lit(0)).groupBy("_all")
    return groups.transformWithState(_Machine(schema.fieldNames(), order, start, step), schema, "Append", "None")


# --- windows ---------------------------------------------------------------------------------


def places(spec, point: int, t0: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of a fixed size that hold a point."""
    s, i, d = spec.size, spec.interval, point - t0
    if i > s:
        return [(t0 + d // i * i, t0 + d // i * i + s - 1)] if d % i < s else []
    return [(max(t0, t0 + j * i - s), t0 + j * i - 1) for j in range(d // i + 1, (d + s) // i + 1)]


def time_step(spec, value: Callable, ts: str, is_watermark: str | None):
    """(start, step) that collect rows into time windows and give those that a later point closes.

    State: first point, latest point, open windows. Rows join only windows that aren't closed yet.
    """

    def step(state, row):
        t0, top, open_windows = state
        point = row[ts]
        if point is None:
            return state, []
        t0, top = point if t0 is None else t0, point if top is None else max(top, point)
        closed = sorted(w for w in open_windows if w[1] < top)
        out = [(*w, open_windows.pop(w)) for w in sorted(closed, key=lambda w: (w[1], w[0]))]
        if not (is_watermark and row[is_watermark]):
            for w in places(spec, max(point, t0), t0) if point >= t0 else []:
                if w[1] >= top:
                    open_windows.setdefault(w, []).append((point, value(row)))
        return (t0, top, open_windows), out

    return lambda: (None, None, {}), step


def count_step(spec, value: Callable, ts: str, is_watermark: str | None):
    """(start, step) of count windows, given when their last row comes."""

    def step(state, row):
        n, open_windows = state
        if row[ts] is None or is_watermark and row[is_watermark]:
            return state, []
        n += 1
        for w in places(spec, n, 1):
            open_windows.setdefault(w, []).append((row[ts], value(row)))
        out = [(*w, open_windows.pop(w)) for w in sorted(open_windows) if w[1] <= n]
        return (n, open_windows), out

    return lambda: (0, {}), step


def session_step(spec, value: Callable, ts: str, is_watermark: str | None):
    """(start, step) of sessions, given by the first point more than the gap after their last row.

    A row more than the gap before the open session is late and dropped.
    """

    def step(state, row):
        point, out = row[ts], []
        if point is None:
            return state, out
        if state and point - state[1] > spec.gap:
            out.append((state[0], state[1], state[2]))
            state = None
        if is_watermark and row[is_watermark]:
            return state, out
        if state is None:
            state = (point, point, [(point, value(row))])
        elif state[0] - point <= spec.gap:
            state[2].append((point, value(row)))
            state = (min(state[0], point), max(state[1], point), state[2])
        return state, out

    return lambda: None, step


def live_windows(df: DataFrame, kind: Callable, spec, columns: list[str], ts: str, seq: str, key_by: str | None = None, is_watermark: str | None = None) -> DataFrame:
    """([key], win_start, win_end, data, ts) of each closed window; data are structs of the columns in order, ts the last row's.

    kind is one of the steps above. is_watermark names a boolean column: rows where it is true close
    windows and are no data.
    """
    row_type = StructType([df.schema[c] for c in columns])
    fields = [StructField("win_start", LongType()), StructField("win_end", LongType()), StructField("data", ArrayType(row_type)), StructField(ts, LongType())]
    schema = StructType([*([df.schema[key_by]] if key_by else []), *fields])
    make = Row(*columns)
    start, inner = kind(spec, lambda row: tuple(row[c] for c in columns), ts, is_watermark)

    def step(state, row):
        state, closed = inner(state, row)
        mine = [row[key_by]] if key_by else []
        return state, [(*mine, a, b, [make(*v) for _, v in data], max(p for p, _ in data)) for a, b, data in closed]

    return live_scan(df, key_by, [ts, seq], schema, start, step)


def each_window(windows: DataFrame, function: Callable, schema: StructType | str, keep: list[str]) -> DataFrame:
    """(*keep, fields of schema) of every row that function(win_start, win_end, data) gives; data are dicts.

    Works on stored and live windows; one window's data are held at a time.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = StructType([*(windows.schema[c] for c in keep), *schema.fields])
    arrow = to_arrow_schema(out)
    ready(windows.sparkSession)
    names = windows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # to_pylist would make the rows of all the batch's windows at once
                row = {n: c[i].as_py() for n, c in zip(names, batch.columns, strict=True)}
                rows += [(*(row[c] for c in keep), *r) for r in function(row["win_start"], row["win_end"], row["data"])]
            yield to_batch(rows, arrow)

    return windows.mapInArrow(run, out)


# --- the other operators ---------------------------------------------------------------------


def live_reduce(df: DataFrame, key: str, value: str, reduce: Callable, ts: str, seq: str, kind: DataType, counts: bool = False) -> DataFrame:
    """(key, value, ts, seq) after each row: the reduction of the key's values so far; nulls are passed over."""
    out = StructType([df.schema[key], StructField(value, kind), df.schema[ts], df.schema[seq]])

    def step(state, row):
        x = row[value]
        if counts:
            state = (state or 0) + (x is not None)
        elif x is not None:
            state = x if state is None else reduce(state, x)
        return state, [(row[key], state, row[ts], row[seq])]

    return live_scan(df, key, [ts, seq], out, lambda: None, step)


def live_punctuated(df: DataFrame, is_watermark: str, watermark: str, ts: str, seq: str, key_by: str | None) -> DataFrame:
    """Rows that aren't late with the watermark so far; rows come in order of seq."""
    kept = [c for c in df.columns if c not in (is_watermark, watermark, "watermark")]
    schema = StructType([*(df.schema[c] for c in kept), StructField("watermark", LongType())])

    def step(state, row):
        if row[is_watermark]:
            mark = row[watermark]
            return (mark if state is None else state if mark is None else max(state, mark)), []
        late = row[ts] is None or state is not None and row[ts] <= state
        return state, [] if late else [(*(row[c] for c in kept), state)]

    return live_scan(df, key_by, [seq], schema, lambda: None, step)


def live_drop_late(df: DataFrame, mark: str, ts: str, seq: str, key_by: str | None) -> DataFrame:
    """Rows that aren't late, watermark rows among them; rows come in order of seq."""

    def step(state, row):
        values, at = tuple(row[c] for c in df_columns), row[ts]
        if row[mark]:
            return (at if state is None else state if at is None else max(state, at)), [values]
        return state, [] if at is None or state is not None and at <= state else [values]

    df_columns = df.columns
    return live_scan(df, key_by, [seq], df.schema, lambda: None, step)


def live_union(df: DataFrame, side: str, ts: str, seq: str, is_watermark: str | None = None) -> DataFrame:
    """Rows of two tagged streams (side 0 or 1) in order of event time, left before right among equals.

    A row is given when both sides have come to its time; each side is in order. seq is made anew:
    1, 2, ... in the order given. is_watermark names rows that only move their side on.
    """
    kept = [c for c in df.columns if c not in (side, is_watermark)]
    schema = StructType([df.schema[c] for c in kept])
    at = kept.index(seq)

    def step(state, row):
        n, tops, held, serial = state
        s = row[side]
        if tops[s] is not None and row[ts] < tops[s]:
            raise ValueError(f"side {s} is out of order at {row[ts]}")
        tops = (row[ts], tops[1]) if s == 0 else (tops[0], row[ts])
        if not (is_watermark and row[is_watermark]):
            heapq.heappush(held, (row[ts], s, serial, [row[c] for c in kept]))
        out = []
        while held and None not in tops and held[0][0] <= min(tops):
            values = heapq.heappop(held)[3]
            n += 1
            values[at] = n
            out.append(tuple(values))
        return (n, tops, held, serial + 1), out

    return live_scan(df, None, [ts, side, seq], schema, lambda: (0, (None, None), [], 0), step)
