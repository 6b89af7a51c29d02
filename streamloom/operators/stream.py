"""The fluent API: a stream is a DataFrame with an event time in ms and an arrival number.

Every operator works on stored rows and, where df.isStreaming, on live ones. The live twins of
ordered operators keep their state in the state store and take rows of a micro-batch in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from streamloom.functions.ordered import numbered
from streamloom.operators import cep as _cep
from streamloom.operators import fsm as _fsm
from streamloom.operators.windows import MERGERS, REDUCERS, CountWindow, SessionWindow, assign, summarise
from streamloom.session import ready
from streamloom.streaming import live
from streamloom.streaming.scan import sorted_scan, to_batch
from streamloom.streaming.stateful import StatefulFunction, apply_stateful

#: The named reductions as functions of two values.
_PLAIN = {"sum": lambda a, b: a + b, "max": max, "min": min, "count": None}


def _reducer(how) -> Callable | None:
    if callable(how):
        return how
    if how not in _PLAIN:
        raise ValueError(f"unknown reduction {how}; known are {sorted(_PLAIN)} and functions of two values")
    return _PLAIN[how]


class Stream:
    """Rows with columns ts (long, ms) and seq (long, arrival order), batch or streaming.

    watermark names a boolean column of rows that only move time on (live windows and unions).
    """

    def __init__(self, df: DataFrame, ts: str = "ts", seq: str = "seq", watermark: str | None = None):
        missing = [c for c in (ts, seq, *([watermark] if watermark else [])) if c not in df.columns]
        if missing:
            raise ValueError(f"a stream needs the columns {missing}")
        self.df, self.ts, self.seq, self.watermark = df, ts, seq, watermark

    def _with(self, df: DataFrame) -> Stream:
        return Stream(df, self.ts, self.seq, self.watermark if self.watermark in df.columns else None)

    @property
    def _own(self) -> list[str]:
        return [self.ts, self.seq, *([self.watermark] if self.watermark else [])]

    def _rows(self, function: Callable, schema: str) -> Stream:
        """Rows that function(row) lists for each row, of the schema's fields, with the row's own ts and seq."""
        ready(self.df.sparkSession)
        own, columns = self._own, self.df.columns
        out = StructType([*(f for f in StructType.fromDDL(schema).fields if f.name not in own), *(self.df.schema[c] for c in own)])
        names, arrow = out.fieldNames()[: len(out) - len(own)], to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row = dict(zip(columns, values, strict=True))
                    for made in function(row):
                        fields = [made[n] for n in names] if isinstance(made, dict) else made if isinstance(made, (tuple, list)) else [made]
                        rows.append((*fields, *(row[c] for c in own)))
                yield to_batch(rows, arrow)

        return self._with(self.df.mapInArrow(run, out))

    def map(self, function: Callable[[dict], object] | None = None, schema: str | None = None, **columns: Column) -> Stream:
        """One row for one row: the named columns, event time and arrival kept.

        Instead of columns a function of a row (a dict) may give the fields of `schema`, as a dict,
        a tuple or a single value.
        """
        if function is not None:
            return self._rows(lambda row: [function(row)], schema)
        return self._with(self.df.select(*[c.alias(n) for n, c in columns.items() if n not in self._own], *self._own))

    def flat_map(self, function: Callable[[dict], list] | None = None, schema: str | None = None, **arrays: Column) -> Stream:
        """One row for each element of one array column, all other columns kept; a column of its name is replaced.

        Instead of the column a function of a row may give a list of rows of `schema`, as in map.
        Null and empty arrays give no row.
        """
        if function is not None:
            return self._rows(function, schema)
        if len(arrays) != 1:
            raise ValueError("flat_map takes one array")
        ((name, array),) = arrays.items()
        return self._with(self.df.select(F.explode(array).alias(name), *[F.col(f"`{c}`") for c in self.df.columns if c != name]))

    def filter(self, condition: Column | Callable[[dict], bool]) -> Stream:
        """The rows that a condition, or a function of a row, holds for."""
        if isinstance(condition, Column):
            return self._with(self.df.where(condition))
        ready(self.df.sparkSession)
        columns = self.df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                yield batch.filter(pa.array([bool(condition(dict(zip(columns, r, strict=True)))) for r in rows], pa.bool_()))

        return self._with(self.df.mapInArrow(run, self.df.schema))

    def route_if(self, *conditions: Column) -> list[Stream]:
        """Branches of rows whose first true condition is the first, second, ...; the rest goes."""
        return [self._with(self.routed(*conditions).df.where(F.col("branch") == i + 1).drop("branch")) for i in range(len(conditions))]

    def routed(self, *conditions: Column) -> Stream:
        """All rows that some condition holds for, with its 1-based number as branch."""
        branch = F.coalesce(*[F.when(c, F.lit(i + 1)) for i, c in enumerate(conditions)])
        return self._with(self.df.withColumn("branch", branch).where(F.col("branch").isNotNull()))

    def union(self, other: Stream, ordered: bool = False) -> Stream:
        """All rows of both; the schemas must agree.

        ordered merges them by event time, this stream's rows before the other's among equals, and
        numbers seq anew (1, 2, ...) in that order. Live rows then wait until both sides have come
        to their time, and the merge is one task.
        """
        if {(f.name, f.dataType) for f in self.df.schema} != {(f.name, f.dataType) for f in other.df.schema}:
            raise ValueError("streams of a union need one schema")
        if not ordered:
            return self._with(self.df.unionByName(other.df))
        both = self.df.withColumn("_side", F.lit(0)).unionByName(other.df.withColumn("_side", F.lit(1)))
        if self.df.isStreaming:
            return Stream(live.live_union(both, "_side", self.ts, self.seq, self.watermark), self.ts, self.seq)
        found = numbered(both, self.ts, "_side", self.seq, name="_n")
        return self._with(found.withColumn(self.seq, F.col("_n")).select(*self.df.columns))

    def window(self, spec, key_by: str | None = None, flush: bool = False) -> WindowedStream | LiveWindows:
        """Windows of the stream, or of each key. flush (stored rows only) gives those that aren't closed, too."""
        if self.df.isStreaming:
            return LiveWindows(self, spec, key_by)
        return WindowedStream(self.df, spec, self.ts, self.seq, key_by, flush)

    def join(self, other: Stream, on: Callable[[Callable, Callable], Column], spec, flush: bool = False) -> DataFrame:
        """Pairs of rows of one window that `on` holds for, columns prefixed l_ and r_.

        Windows are those of both streams together: rows are tagged and merged, windows assigned,
        and the two tags joined, so that count and session windows see both sides. Live, the pairs
        of a window come when it closes.
        """
        left, right = ({c: F.col(c).alias(f"{p}{c}") for c in s.df.columns} for p, s in (("l_", self), ("r_", other)))
        both = self.df.select(*left.values(), F.lit(0).alias("_side"), F.col(self.ts).alias("_ts"), F.col(self.seq).alias("_seq")).unionByName(
            other.df.select(*right.values(), F.lit(1).alias("_side"), F.col(other.ts).alias("_ts"), F.col(other.seq).alias("_seq")), allowMissingColumns=True
        )
        if both.isStreaming:
            names = [*(f"l_{c}" for c in self.df.columns), *(f"r_{c}" for c in other.df.columns)]
            closed = LiveWindows(Stream(both, "_ts", "_seq"), spec, None).collect("_side", *names)
            pairs = closed.select("win_start", "win_end", F.explode(F.filter("data", lambda d: d["_side"] == 0)).alias("_l"), F.filter("data", lambda d: d["_side"] == 1).alias("_r"))
            pairs = pairs.select("win_start", "win_end", "_l", F.explode("_r").alias("_r"))
            return pairs.where(on(lambda c: F.col(f"_l.l_{c}"), lambda c: F.col(f"_r.r_{c}"))).select(
                "win_start", "win_end", *[F.col(f"_l.l_{c}") for c in self.df.columns], *[F.col(f"_r.r_{c}") for c in other.df.columns]
            )
        placed = assign(both, spec, "_ts", "_seq", None, flush)
        a = placed.where("_side = 0").select("win_start", "win_end", *[f"l_{c}" for c in self.df.columns])
        b = placed.where("_side = 1").select("win_start", "win_end", *[f"r_{c}" for c in other.df.columns])
        same = (a.win_start == b.win_start) & (a.win_end == b.win_end)
        return a.join(b, same & on(lambda c: a[f"l_{c}"], lambda c: b[f"r_{c}"])).drop(b.win_start).drop(b.win_end)

    def reduce_by_key(self, key: str, value: str, how: str | Callable = "sum", mode: str = "changelog") -> DataFrame:
        """The reduction of the values so far of each key; how is a name or a function of two values.

        changelog: one row for each row, with the key's reduction after it. final: one row for each
        key (stored rows only). map: one row for each row with all keys' reductions as `state`, in
        one task; its output grows with the keys. Null values are passed over.
        """
        reduce = _reducer(how)
        counts = how == "count"
        if mode not in ("changelog", "final", "map"):
            raise ValueError(f"unknown mode {mode}")
        if mode == "map":
            return self._reduced_map(key, value, reduce, counts)
        if self.df.isStreaming:
            if mode == "final":
                raise ValueError("a live stream has no final reduction")
            return live.live_reduce(self.df, key, value, reduce, self.ts, self.seq, self._kind(value, reduce, counts), counts)
        if not callable(how):
            if mode == "final":
                return self.df.groupBy(key).agg(REDUCERS[how](value).alias(value))
            w = Window.partitionBy(key).orderBy(self.ts, self.seq).rowsBetween(Window.unboundedPreceding, 0)
            return self.df.select(key, REDUCERS[how](value).over(w).alias(value), self.ts, self.seq)
        last = mode == "final"
        fields = [self.df.schema[key], self.df.schema[value], *([] if last else [self.df.schema[self.ts], self.df.schema[self.seq]])]
        ts, seq = self.ts, self.seq

        def step(state, row):
            x, so_far = row[value], state[1]
            so_far = so_far if x is None else x if so_far is None else reduce(so_far, x)
            return (row[key], so_far), [] if last else [(row[key], so_far, row[ts], row[seq])]

        slim = self.df.select(*dict.fromkeys([key, value, ts, seq]))
        return sorted_scan(slim, key, [ts, seq], StructType(fields), lambda: (None, None), step, (lambda state: [state]) if last else None)

    def _kind(self, value: str, reduce: Callable | None, counts: bool) -> DataType:
        """The type of a reduction's results: sums are as wide as Spark's, functions keep the values' type."""
        wide = F.count(value) if counts else F.sum(value) if reduce is _PLAIN["sum"] else F.max(value)
        return self.df.select(wide).schema[0].dataType

    def _reduced_map(self, key: str, value: str, reduce: Callable | None, counts: bool) -> DataFrame:
        kind = self._kind(value, reduce, counts).simpleString()
        schema = StructType([*StructType.fromDDL(f"state map<{self.df.schema[key].dataType.simpleString()},{kind}>").fields, self.df.schema[self.ts], self.df.schema[self.seq]])
        ts, seq = self.ts, self.seq

        def step(state, row):
            x, k = row[value], row[key]
            if counts:
                state[k] = state.get(k, 0) + (x is not None)
            elif x is not None:
                state[k] = reduce(state[k], x) if k in state else x
            return state, [(dict(state), row[ts], row[seq])]

        rows = self.df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, value, ts, seq]))  # maps have no null keys
        scan = live.live_scan if self.df.isStreaming else sorted_scan
        return scan(rows, None, [ts, seq], schema, dict, step)

    def running(self, value: str, how: str = "max", key_by: str | None = None) -> DataFrame:
        """df with the reduction so far as `result`; common stateful functions without Python."""
        w = (Window.partitionBy(key_by) if key_by else Window.partitionBy(F.lit(0))).orderBy(self.ts, self.seq)
        return self.df.withColumn("result", REDUCERS[how](value).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def apply_stateful(self, function: StatefulFunction, result_type: str, key_by: str | None = None) -> DataFrame:
        return apply_stateful(self.df, function, result_type, self.ts, self.seq, key_by)

    def state_transition(self, initial: str, finals: set[str], table: dict, key_by: str | None = None) -> DataFrame:
        return _fsm.state_transition(self.df, initial, finals, table, self.ts, self.seq, key_by)

    def cep(self, patterns: list[_cep.Pattern], within: int, key_by: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        return _cep.cep(self.df, patterns, within, self.ts, self.seq, key_by, carry)


class _Windows:
    """What stored and live windows have in common: functions over the rows of one window.

    The rows of a window are one row's array while they are handed to a function, as the operators
    that take whole windows demand; aggregates that can be merged need none of it (`summarise`).
    """

    key_by: str | None

    def _keep(self) -> list[str]:
        return ["win_start", "win_end", *([self.key_by] if self.key_by else [])]

    def aggregate_function(self, function: Callable[[int, int, list[dict]], object], result_type: str, *columns: str) -> DataFrame:
        """Any function of (win_start, win_end, rows in order) as `result`, with the window's event time."""
        windows = self.collect(*columns, as_struct=True)
        keep = [*self._keep(), self.ts]
        return live.each_window(windows, lambda a, b, data: [(function(a, b, data),)], f"result {result_type}", keep)


class WindowedStream(_Windows):
    """Stored rows in windows; `df` has one row for each window that holds a row."""

    def __init__(self, df: DataFrame, spec, ts: str, seq: str, key_by: str | None = None, flush: bool = False):
        self.source, self.spec, self.ts, self.seq, self.key_by, self.flush, self._df = df, spec, ts, seq, key_by, flush, None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = assign(self.source, self.spec, self.ts, self.seq, self.key_by, self.flush)
        return self._df

    def _of(self, *columns: str) -> DataFrame:
        """df with no more columns than are needed, so that numbering writes no others."""
        slim = self.source.select(*dict.fromkeys([self.ts, self.seq, *([self.key_by] if self.key_by else []), *columns]))
        return assign(slim, self.spec, self.ts, self.seq, self.key_by, self.flush)

    def summarise(self, keys: tuple[str, ...] = (), **named: str | tuple[str, str]) -> DataFrame:
        """One row for each window (and key): name="count" or name=(sum | max | min | count, column).

        Rows are summed up in cells and cells in windows, so that long windows with short
        intervals cost no more than short ones.
        """
        return summarise(self.source, self.spec, named, self.ts, self.seq, self.key_by, keys, self.flush)

    def aggregate_window(self, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
        """One row for each window (and key) with any aggregates and the event time of its last row."""
        keys = tuple(dict.fromkeys([*([self.key_by] if self.key_by else []), *keys]))
        return self.df.groupBy("win_start", "win_end", *keys).agg(*aggregates, F.max(self.ts).alias(self.ts))

    def collect(self, *columns: str, as_struct: bool = False) -> DataFrame:
        """Each window's rows in order as the array `data`; the event time is the last row's."""
        row = F.struct(F.col(self.ts).alias("_0"), F.col(self.seq).alias("_1"), *[F.col(c).alias(f"_v_{c}") for c in columns])
        single = len(columns) == 1 and not as_struct
        pick = lambda r: r[f"_v_{columns[0]}"] if single else F.struct(*[r[f"_v_{c}"].alias(c) for c in columns])
        data = F.transform(F.sort_array(F.collect_list(row)), pick)
        return self._of(*columns).groupBy(*self._keep()).agg(data.alias("data"), F.max(self.ts).alias(self.ts))

    def reduce_function(self, key: str, value: str, reduce: Callable) -> DataFrame:
        """The reduction of each key's values in each window, in order, by a function of two values.

        Rows are streamed through; no window is held. Rows of one ts and seq come by their values.
        """
        keep = [c for c in self._keep() if c != key]
        rows = self._of(key, value)
        schema = StructType([*(rows.schema[c] for c in keep), self.source.schema[key], self.source.schema[value]])

        def step(state, row):
            group, so_far = state
            x = row[value]
            so_far = x if so_far is None else so_far if x is None else reduce(so_far, x)
            return (group or (*(row[c] for c in keep), row[key]), so_far), []

        order = [c for c in dict.fromkeys([self.ts, self.seq, value]) if c not in (*keep, key)]
        return sorted_scan(rows, [*keep, key], order, schema, lambda: (None, None), step, lambda state: [(*state[0], state[1])])

    def reduce_by_key_window(self, key: str, value: str, how: str | Callable = "sum", as_map: bool = False) -> DataFrame:
        """The reduction of each key in each window; as one map for each window if as_map."""
        _reducer(how)
        out = self.reduce_function(key, value, how) if callable(how) else self.summarise(keys=(key,), **{f"_{value}": (how, value)}).withColumnRenamed(f"_{value}", value)
        if not as_map:
            return out
        return out.groupBy(*self._keep()).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("data"))

    def apply_stateful_window(self, function: StatefulFunction, result_type: str) -> DataFrame:
        """The function's result over each window's rows in order, state made anew for each.

        Rows are streamed through; no window is held.
        """
        keep = self._keep()
        needs = getattr(function, "columns", None)
        rows = self._of(*needs) if needs else self.df
        schema = StructType([*(rows.schema[c] for c in keep), *StructType.fromDDL(f"result {result_type}").fields])

        def step(state, row):
            return (tuple(row[c] for c in keep), function.update(state[1], row)), []

        finish = lambda state: [(*state[0], function.produce(state[1]))]
        return sorted_scan(rows, keep, [self.ts, self.seq], schema, lambda: (None, function.initialize()), step, finish)


class LiveWindows(_Windows):
    """Windows of a live stream, each given once, when a later row or watermark closes it."""

    def __init__(self, stream: Stream, spec, key_by: str | None):
        self.stream, self.source, self.spec, self.ts, self.key_by = stream, stream.df, spec, stream.ts, key_by

    def collect(self, *columns: str, as_struct: bool = False) -> DataFrame:
        """([key], win_start, win_end, data, ts) of each closed window, its rows in order."""
        kind = live.session_step if isinstance(self.spec, SessionWindow) else live.count_step if isinstance(self.spec, CountWindow) else live.time_step
        out = live.live_windows(self.source, kind, self.spec, list(columns), self.ts, self.stream.seq, self.key_by, self.stream.watermark)
        return out.withColumn("data", F.transform("data", lambda d: d[columns[0]])) if len(columns) == 1 and not as_struct else out

    def summarise(self, keys: tuple[str, ...] = (), **named: str | tuple[str, str]) -> DataFrame:
        """As WindowedStream.summarise."""
        told = {n: (how, None) if isinstance(how, str) else how for n, how in named.items()}
        columns = list(dict.fromkeys([*keys, *(c for _, c in told.values() if c)])) or [self.ts]
        types = [self.source.select(MERGERS[how](c) if c and how != "count" else F.count("*")).schema[0].dataType.simpleString() for how, c in told.values()]
        schema = StructType([*(self.source.schema[c] for c in keys), *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in zip(told, types, strict=True))).fields])

        def run(_start, _end, data):
            groups: dict[tuple, list] = {}
            for row in data:
                groups.setdefault(tuple(row[k] for k in keys), []).append(row)
            out = []
            for mine, rows in groups.items():
                values = []
                for how, c in told.values():
                    known = [r[c] for r in rows if r[c] is not None] if c else rows
                    values.append(len(known) if how == "count" else None if not known else {"sum": sum, "max": max, "min": min}[how](known))
                out.append((*mine, *values))
            return out

        return live.each_window(self.collect(*columns, as_struct=True), run, schema, [c for c in self._keep() if c not in keys])

    def reduce_function(self, key: str, value: str, reduce: Callable) -> DataFrame:
        """The reduction of each key's values in each window by a function of two values."""
        windows = self.collect(key, value, as_struct=True)
        schema = StructType([self.source.schema[key], self.source.schema[value]])

        def run(_start, _end, data):
            out: dict = {}
            for row in data:
                k, x = row[key], row[value]
                if k not in out or out[k] is None:
                    out[k] = x
                elif x is not None:
                    out[k] = reduce(out[k], x)
            return list(out.items())

        return live.each_window(windows, run, schema, [c for c in self._keep() if c != key])

    def reduce_by_key_window(self, key: str, value: str, how: str | Callable = "sum") -> DataFrame:
        """As WindowedStream.reduce_by_key_window."""
        _reducer(how)
        return self.reduce_function(key, value, how) if callable(how) else self.summarise(keys=(key,), **{f"_{value}": (how, value)}).withColumnRenamed(f"_{value}", value)

    def apply_stateful_window(self, function: StatefulFunction, result_type: str) -> DataFrame:
        """As WindowedStream.apply_stateful_window."""
        columns = list(getattr(function, "columns", None) or self.source.columns)

        def run(_start, _end, data):
            state = function.initialize()
            for row in data:
                state = function.update(state, row)
            return [(function.produce(state),)]

        return live.each_window(self.collect(*columns, as_struct=True), run, f"result {result_type}", self._keep())
