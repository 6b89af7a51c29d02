"""Time, count and session windows in closed form.

Time and count windows are anchored at the first point t0 (the first event's time, or row 1), not
at the epoch. Of size S and interval I <= S, window j = 1, 2, ... ends at t0 + j*I - 1 and starts
at t0 + j*I - S, but not before t0; a point p lies in those from (p - t0) // I + 1 to
(p - t0 + S) // I. For I > S window m = 0, 1, ... is [t0 + m*I, t0 + m*I + S - 1], and points in
the gaps belong to none. Ends are inclusive.

All edges lie at multiples of gcd(S, I) from t0, so that rows can be summed up in cells of that
length before cells are given to windows; and rows of one gap-long stretch of time share a
session, so that sessions are found among stretches. Both keep rows out of shuffles where the
aggregates can be merged (`summarise`).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions.ordered import numbered


@dataclass(frozen=True)
class _Fixed:
    size: int
    interval: int

    def __post_init__(self):
        if self.size <= 0 or self.interval <= 0:
            raise ValueError("window size and interval must be positive")


class TimeWindow(_Fixed):
    """Windows of `size` ms, one every `interval` ms."""


class CountWindow(_Fixed):
    """Windows of `size` rows, one every `interval` rows."""


@dataclass(frozen=True)
class SessionWindow:
    """Windows that close after more than `gap` ms without a row."""

    gap: int

    def __post_init__(self):
        if self.gap <= 0:
            raise ValueError("session gap must be positive")


#: Aggregates that can be merged: of rows, and of partial results.
REDUCERS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
MERGERS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}


def aggregates(named: dict[str, str | tuple[str, str]], reducers: dict) -> list[Column]:
    """Columns of name="count" or name=(how, column)."""
    told = {n: (how, "*") if isinstance(how, str) else how for n, how in named.items()}
    return [reducers[how](c).alias(n) for n, (how, c) in told.items()]


def merged(named: dict) -> list[Column]:
    return [MERGERS[how if isinstance(how, str) else how[0]](n).alias(n) for n, how in named.items()]


def _placed(df: DataFrame, point: Column, t0: Column, spec: _Fixed) -> DataFrame:
    """A row for each window that the point lies in, with win_start and win_end."""
    s, i = spec.size, spec.interval
    df = df.withColumn("_d", (point - t0).cast("bigint")).withColumn("_t0", t0.cast("bigint"))
    if i <= s:
        j = F.explode(F.sequence(F.expr(f"_d div {i} + 1"), F.expr(f"(_d + {s}) div {i}"))).alias("_j")
        df = df.select("*", j)
        start, end = F.greatest(F.col("_t0"), F.col("_t0") + F.col("_j") * i - s), F.col("_t0") + F.col("_j") * i - 1
        return df.withColumn("win_start", start).withColumn("win_end", end).drop("_d", "_t0", "_j")
    df = df.where(F.col("_d") % i < s)
    start = F.col("_t0") + F.expr(f"_d div {i}") * i
    return df.withColumn("win_start", start).withColumn("win_end", start + s - 1).drop("_d", "_t0")


def _pointed(df: DataFrame, spec: _Fixed, ts: str, seq: str, key_by: str | None) -> DataFrame:
    """df with _point, _first (t0) and _last (what a window must end before, or up to, to be closed)."""
    if isinstance(spec, TimeWindow):
        df = df.where(F.col(ts).isNotNull()).withColumn("_point", F.col(ts).cast("bigint"))
        if key_by:
            w = Window.partitionBy(key_by)
            return df.withColumn("_first", F.min("_point").over(w)).withColumn("_last", F.max("_point").over(w) - 1)
        edge = df.agg(F.struct(F.min("_point").alias("first"), F.max("_point").alias("last"))).scalar()
        return df.withColumn("_edge", edge).withColumn("_first", F.col("_edge.first")).withColumn("_last", F.col("_edge.last") - 1).drop("_edge")
    df = df.where(F.col(ts).isNotNull())
    if key_by:
        w = Window.partitionBy(key_by)
        df = df.withColumn("_point", F.row_number().over(w.orderBy(ts, seq)).cast("bigint")).withColumn("_last", F.count("*").over(w))
    else:
        df = numbered(df, ts, seq, name="_point")
        df = df.withColumn("_last", df.agg(F.max("_point")).scalar())
    return df.withColumn("_first", F.lit(1).cast("bigint"))


def assign(df: DataFrame, spec, ts: str = "ts", seq: str = "seq", key_by: str | None = None, flush: bool = False) -> DataFrame:
    """df with win_start and win_end, a row for each window.

    ts is in ms. Without key_by all rows form one stream. Windows that the input doesn't close
    are left out unless flush: a time window is closed by a later point, a count window when it
    is full or the rows pass its end, a session by a row more than the gap later. Rows with a null
    ts belong to no window; a null key is a key like others.
    """
    if isinstance(spec, SessionWindow):
        df = df.where(F.col(ts).isNotNull())
        return _within(df.withColumn("_stretch", _stretch(ts, spec)), _bounded(df, spec, ts, key_by, flush), key_by).drop("_stretch")
    placed = _placed(_pointed(df, spec, ts, seq, key_by), F.col("_point"), F.col("_first"), spec)
    return (placed if flush else placed.where(F.col("win_end") <= F.col("_last"))).drop("_point", "_first", "_last")


def summarise(df: DataFrame, spec, named: dict, ts: str = "ts", seq: str = "seq", key_by: str | None = None, keys: tuple[str, ...] = (), flush: bool = False) -> DataFrame:
    """(win_start, win_end, *keys, *named) of each window, for aggregates that can be merged.

    named gives each result "count" or (how, column). Rows are aggregated in cells, and cells in
    windows: a row is counted once, however many windows hold it.
    """
    keys = [*dict.fromkeys([*([key_by] if key_by else []), *keys])]
    df = df.select(*dict.fromkeys([ts, seq, *keys, *(c for c in (h[1] for h in named.values() if not isinstance(h, str)) if c != "*")]))
    if isinstance(spec, SessionWindow):
        df = df.where(F.col(ts).isNotNull())
        mine = [key_by] if key_by else []
        if keys == mine:  # stretches are summed up and joined in one go
            marked = _marked(df, spec, ts, key_by, named)
            found = marked.groupBy(*mine, "_s").agg(F.min("_lo").alias("win_start"), F.max("_hi").alias("win_end"), *merged(named))
            return _closed(found, mine, flush).select("win_start", "win_end", *keys, *named)
        parts = df.withColumn("_stretch", _stretch(ts, spec)).groupBy("_stretch", *keys).agg(*aggregates(named, REDUCERS))
        return _within(parts, _bounded(df, spec, ts, key_by, flush), key_by).groupBy("win_start", "win_end", *keys).agg(*merged(named))
    step = gcd(spec.size, spec.interval)
    rows = _pointed(df, spec, ts, seq, key_by).withColumn("_cell", F.expr(f"(_point - _first) div {step}"))
    cells = rows.groupBy("_cell", *keys).agg(*aggregates(named, REDUCERS), F.first("_first").alias("_first"), F.first("_last").alias("_last"))
    placed = _placed(cells, F.col("_first") + F.col("_cell") * step, F.col("_first"), spec)
    if not flush:
        placed = placed.where(F.col("win_end") <= F.col("_last"))
    return placed.groupBy("win_start", "win_end", *keys).agg(*merged(named))


def _stretch(ts: str, spec: SessionWindow) -> Column:
    """The number of the gap-long stretch of time that a row lies in; its rows share a session."""
    return F.floor(F.col(ts) / spec.gap).cast("bigint")


def _marked(df: DataFrame, spec: SessionWindow, ts: str, key_by: str | None, named: dict) -> DataFrame:
    """Stretches that hold rows (_stretch, first and last time _lo and _hi, aggregates), each with its session's number _s.

    The window runs over stretches, not rows.
    """
    mine = [key_by] if key_by else []
    stretches = df.withColumn("_stretch", _stretch(ts, spec)).groupBy(*mine, "_stretch").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), *aggregates(named, REDUCERS))
    w = Window.partitionBy(*mine).orderBy("_stretch")
    apart = F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > spec.gap).cast("int"), F.lit(0))
    return stretches.withColumn("_new", apart).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _closed(sessions: DataFrame, mine: list[str], flush: bool) -> DataFrame:
    """Without each key's last session, unless flush."""
    return sessions if flush else sessions.withColumn("_top", F.max("_s").over(Window.partitionBy(*mine))).where("_s < _top").drop("_top")


def _bounded(df: DataFrame, spec: SessionWindow, ts: str, key_by: str | None, flush: bool) -> DataFrame:
    """(_of, _key, win_start, win_end) of each stretch that lies in a closed session."""
    mine = [key_by] if key_by else []
    w = Window.partitionBy(*mine, "_s")
    found = _closed(_marked(df, spec, ts, key_by, {}), mine, flush)
    return found.select(F.col("_stretch").alias("_of"), *[F.col(c).alias("_key") for c in mine], F.min("_lo").over(w).alias("win_start"), F.max("_hi").over(w).alias("win_end"))


def _within(rows: DataFrame, bounded: DataFrame, key_by: str | None) -> DataFrame:
    on = F.col("_stretch") == F.col("_of")
    if key_by:
        on = on & F.col(key_by).eqNullSafe(F.col("_key"))
    return rows.join(bounded, on).drop("_of", "_key")
