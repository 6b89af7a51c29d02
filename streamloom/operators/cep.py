"""Complex-event patterns: a non-deterministic automaton over ordered rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from streamloom.streaming.live import live_scan
from streamloom.streaming.scan import sorted_scan

STRICT, RELAXED, ANY = "strict", "relaxed", "non_deterministic_relaxed"


@dataclass(frozen=True)
class Pattern:
    """One element of a pattern sequence.

    contiguity says what may lie between the element before and this one: nothing (STRICT), rows
    that don't match (RELAXED), any rows (ANY). inner says the same between repeats of a loop. stop
    ends a loop without upper bound for good.
    """

    name: str
    condition: Column
    contiguity: str = STRICT
    least: int = 1
    most: int | None = 1
    is_optional: bool = False
    inner: str | None = None
    stop: Column | None = None
    counted: bool = field(default=False, repr=False)

    def __post_init__(self):
        if not self.name or self.condition is None:
            raise ValueError("a pattern needs a name and a condition")
        if self.contiguity not in (STRICT, RELAXED, ANY) or self.inner not in (None, STRICT, RELAXED, ANY):
            raise ValueError("unknown contiguity")

    def optional(self) -> Pattern:
        if self.is_optional:
            raise ValueError("the pattern is optional already")
        return replace(self, is_optional=True)

    def _loop(self, least: int, most: int | None) -> Pattern:
        if self.counted:
            raise ValueError("the pattern has a quantifier already")
        if least < 1 or most is not None and most < least:
            raise ValueError("times must be positive and in order")
        return replace(self, least=least, most=most, counted=True)

    def times(self, least: int, most: int | None = None) -> Pattern:
        return self._loop(least, least if most is None else most)

    def at_least(self, n: int) -> Pattern:
        return self._loop(n, None)

    def within_loop(self, contiguity: str) -> Pattern:
        if not self.counted:
            raise ValueError("inner contiguity needs a quantifier")
        return replace(self, inner=contiguity)

    def until(self, condition: Column) -> Pattern:
        if not self.counted or self.most is not None:
            raise ValueError("a stop condition needs a loop without upper bound")
        return replace(self, stop=condition)


def next_elements(patterns: list[tuple], i: int) -> list[int]:
    """Elements that may come after element i: the following one, and those behind optional ones."""
    out = []
    for j in range(i + 1, len(patterns)):
        out.append(j)
        if not patterns[j][4]:
            break
    return out


def advance(partials: list[tuple], ts: int, event, flags: str, stops: str, patterns: list[tuple], within: int) -> tuple[list[tuple], list[tuple]]:
    """(partial matches after the event, matches that end with it).

    A partial match is (element, repeats, events, first ts, open ways); a way is -1 for the loop or
    the element it goes on to. A way that was open and not taken stays open if its contiguity lets
    the event pass.
    """
    after, found = [], []

    def take(j: int, repeats: int, events: tuple, first: int):
        _, _, least, most, _, inner = patterns[j]
        ways = ([-1] if most is None or repeats < most else []) + (next_elements(patterns, j) if repeats >= least else [])
        if repeats >= least and all(p[4] for p in patterns[j + 1 :]):
            found.append(events)
        if ways:
            after.append((j, repeats, events, first, tuple(ways)))

    for i, repeats, events, first, ways in partials:
        if first + within < ts:
            continue
        left = []
        for way in ways:
            j = i if way < 0 else way
            if way < 0 and stops[i] == "1":
                continue
            contiguity = patterns[i][5] if way < 0 else patterns[j][1]
            hit = flags[j] == "1"
            if hit:
                take(j, repeats + 1 if way < 0 else 1, (*events, (patterns[j][0], event)), first)
            if contiguity == ANY or contiguity == RELAXED and not hit:
                left.append(way)
        if left:
            after.append((i, repeats, events, first, tuple(left)))
    for j in next_elements(patterns, -1):
        if flags[j] == "1":
            take(j, 1, ((patterns[j][0], event),), ts)
    return after, found


def _chain(rows: DataFrame, names: list[str], within: int, key_by: str | None, carry: bool) -> DataFrame:
    """Matches of single elements that follow each other at once, by looking ahead instead of an automaton."""
    w = Window.partitionBy(*(["key"] if key_by else [])).orderBy("ts", "seq")
    n, kept = len(names), ["flags", "ts", "seq", *(["row"] if carry else [])]
    flat = rows.select("*", *[F.lead(c, i).over(w).alias(f"_{c}{i}") for i in range(1, n) for c in kept])
    hit = F.substring("flags", 1, 1) == "1"
    for i in range(1, n):
        hit = hit & (F.substring(f"_flags{i}", i + 1, 1) == "1")
    last = F.col(f"_ts{n - 1}") if n > 1 else F.col("ts")
    every = lambda c: F.array(c, *[f"_{c}{i}" for i in range(1, n)])
    return flat.where(hit & (last - F.col("ts") <= within)).select(
        "key", F.col("ts").alias("first_ts"), last.alias("ts"), F.array(*map(F.lit, names)).alias("names"), every("seq").alias("events"), *([every("row").alias("rows")] if carry else [])
    )


def cep(df: DataFrame, patterns: list[Pattern], within: int, ts: str = "ts", seq: str = "seq", key_by: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, first_ts, ts, names, events) of every match; events are seq numbers, names beside them.

    A match's last row is at most `within` ms after its first. With carry there are also `rows`,
    structs of those columns beside the events. Conditions are evaluated as columns before the
    ordered pass; null ones are false. ts and seq are long; rows without a ts take no part. The key
    has its own type, null keys are one key, and without key_by it is null (long). Chains of single
    strict elements over stored rows need no ordered pass. Live streams keep partial matches in the
    state store.
    """
    if len({p.name for p in patterns}) != len(patterns) or not patterns:
        raise ValueError("patterns need names of their own")
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit("1")).otherwise(F.lit("0"))
    rows = df.where(F.col(ts).isNotNull()).select(
        (F.col(key_by) if key_by else F.lit(None).cast("long")).alias("key"),
        F.col(ts).cast("long").alias("ts"),
        F.col(seq).cast("long").alias("seq"),
        F.concat(F.lit(""), *[flag(p.condition) for p in patterns]).alias("flags"),
        F.concat(F.lit(""), *[flag(p.stop) if p.stop is not None else F.lit("0") for p in patterns]).alias("stops"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    alone = all(not p.counted and not p.is_optional and p.least == p.most == 1 for p in patterns)
    if alone and all(p.contiguity == STRICT for p in patterns[1:]) and not df.isStreaming:
        return _chain(rows, [p.name for p in patterns], within, key_by, bool(carry))
    told = [(p.name, p.contiguity, p.least, p.most, p.is_optional, p.inner or RELAXED) for p in patterns]
    make = Row(*carry)

    def step(partials, row):
        event = (row["seq"], row["ts"], make(*(row["row"][c] for c in carry)) if carry else None)
        partials, found = advance(partials, row["ts"], event, row["flags"], row["stops"], told, within)
        out = []
        for events in found:
            more = [[e[2] if live else e[2].asDict() for _, e in events]] if carry else []
            out.append((row["key"], events[0][1][1], row["ts"], [n for n, _ in events], [e[0] for _, e in events], *more))
        return partials, out

    live = df.isStreaming
    fields = StructType.fromDDL("first_ts long, ts long, names array<string>, events array<long>").fields
    schema = StructType([rows.schema["key"], *fields, *([StructField("rows", ArrayType(rows.schema["row"].dataType))] if carry else [])])
    return (live_scan if live else sorted_scan)(rows, "key" if key_by else None, ["ts", "seq"], schema, list, step)


def by_name(matches: DataFrame, column: str = "events") -> DataFrame:
    """matches with `match`, a map from each pattern's name to its events (or rows) in order."""
    of = F.expr(f"map_from_entries(transform(array_distinct(names), n -> struct(n, filter({column}, (x, i) -> names[i] = n))))")
    return matches.withColumn("match", of)
