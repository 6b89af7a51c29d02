"""Whole queries from parts: text input, patterns or rules, and actions with sinks.

Builders check themselves when built, give their result as a DataFrame for stored or live input
(`result`), and run on an engine (`submit`), where each action's texts go to its sink.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.text import parse_delimited, template
from streamloom.operators.cep import Pattern, by_name
from streamloom.operators.fsm import state_transition
from streamloom.operators.stream import Stream
from streamloom.plans.rules import Action, Condition
from streamloom.sources.configs import KafkaSource, MqttSource, SocketSource
from streamloom.sources.readers import events


@dataclass(frozen=True)
class TextInput:
    """Lines of a source as typed fields; also of a DataFrame (value, ts, seq).

    fields are (name, INTEGER | LONG | DOUBLE | STRING); separator is a regular expression.
    """

    source: SocketSource | KafkaSource | MqttSource | DataFrame
    fields: tuple[tuple[str, str], ...]
    separator: str = ","

    def __post_init__(self):
        names = [n for n, _ in self.fields]
        if not names or len(set(names)) != len(names) or {"ts", "seq", "value"} & set(names):
            raise ValueError("an input needs fields of different names, other than value, ts and seq")

    def read(self, spark: SparkSession) -> Stream:
        lines = self.source if isinstance(self.source, DataFrame) else events(spark, self.source)
        return Stream(parse_delimited(lines, "value", list(self.fields), self.separator).drop("value"))


def _sent(df: DataFrame, actions: dict[object, tuple[Action, Callable | None]], by: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each action's texts (column message, told apart by `by`) to its sink."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, (_, sink) in actions.items():
                if sink is not None:
                    sink(batch.where(F.col(by) == name).select(F.col("message").alias("value")), number)
        finally:
            batch.unpersist()

    return write


@dataclass(frozen=True)
class CepQuery:
    """A pattern query: input, patterns, within, an optional qualifier, and an action with its sink.

    qualifier(match) gives a condition on `match`, the map from pattern names to arrays of rows (the
    input's fields). The action's text may hold $first_ts and $ts and, as $name.field, a field of
    the first row of a pattern. An action without a sink does nothing.
    """

    application: str
    input: TextInput | None = None
    patterns: tuple[Pattern, ...] = ()
    window: int | None = None
    condition: Callable[[Column], Column] | None = None
    act: Action | None = None
    sink: Callable | None = None
    key: str | None = None

    def read(self, source: TextInput, key_by: str | None = None) -> CepQuery:
        return replace(self, input=source, key=key_by)

    def sequence(self, *patterns: Pattern) -> CepQuery:
        if len({p.name for p in patterns}) != len(patterns):
            raise ValueError("patterns need names of their own")
        return replace(self, patterns=patterns)

    def within(self, ms: int) -> CepQuery:
        if ms <= 0:
            raise ValueError("the time a match may take must be positive")
        return replace(self, window=ms)

    def qualify(self, qualifier: Callable[[Column], Column]) -> CepQuery:
        return replace(self, condition=qualifier)

    def action(self, action: Action, sink: Callable | None = None) -> CepQuery:
        return replace(self, act=action, sink=sink)

    def _checked(self) -> CepQuery:
        missing = [n for n, v in (("application", self.application), ("input", self.input), ("patterns", self.patterns), ("within", self.window), ("action", self.act)) if not v]
        if missing:
            raise ValueError(f"the query lacks {', '.join(missing)}")
        return self

    def result(self, spark: SparkSession) -> DataFrame:
        """(key, first_ts, ts, names, events, rows, match, message) of each match that qualifies."""
        self._checked()
        fields = tuple(n for n, _ in self.input.fields)
        found = by_name(self.input.read(spark).cep(list(self.patterns), self.window, self.key, fields), "rows")
        if self.condition is not None:
            found = found.where(self.condition(F.col("match")))
        values = {f"{p.name}.{n}": F.get(F.try_element_at("match", F.lit(p.name)), F.lit(0))[n] for p in self.patterns for n in fields}
        text = template(list(self.act.parts), ["first_ts", "ts"], self.act.separator, values)
        return found.withColumn("message", text)

    def submit(self, engine, name: str | None = None, **trigger) -> str:
        result = self.result(engine.spark).withColumn("_one", F.lit(1))
        return engine.submit_stateful(self.application, result, _sent(result, {1: (self.act, self.sink)}, "_one"), name=name, **trigger)


@dataclass(frozen=True)
class RuleQuery:
    """Rules on one input: conditions with actions, or a state machine with an action for each final state."""

    application: str
    input: TextInput
    rules: tuple[tuple[Condition, Action, Callable | None], ...] = ()
    initial: str | None = None
    moves: tuple[tuple[str, Condition, str], ...] = ()
    finals: dict[str, tuple[Action, Callable | None]] = field(default_factory=dict)
    key: str | None = None

    def __post_init__(self):
        if not self.application:
            raise ValueError("a query needs an application")

    def rule(self, condition: Condition, action: Action, sink: Callable | None = None) -> RuleQuery:
        if self.initial is not None:
            raise ValueError("a query has rules or states, not both")
        return replace(self, rules=(*self.rules, (condition, action, sink)))

    def states(self, initial: str, key_by: str | None = None) -> RuleQuery:
        if self.rules:
            raise ValueError("a query has rules or states, not both")
        return replace(self, initial=initial, key=key_by)

    def move(self, state: str, condition: Condition, to: str) -> RuleQuery:
        return replace(self, moves=(*self.moves, (state, condition, to)))

    def final(self, state: str, action: Action, sink: Callable | None = None) -> RuleQuery:
        if state in self.finals:
            raise ValueError(f"{state} has an action already")
        return replace(self, finals={**self.finals, state: (action, sink)})

    def result(self, spark: SparkSession) -> DataFrame:
        """The input's rows with rule (number from 1) or state, and message."""
        if not self.rules and not (self.initial and self.moves and self.finals):
            raise ValueError("a query needs rules, or an initial state, moves and final states")
        stream = self.input.read(spark)
        df, names = stream.df, stream.df.columns
        if self.rules:
            hits = [F.when(c.column(df), F.struct(F.lit(i).alias("rule"), template(list(a.parts), names, a.separator).alias("message"))) for i, (c, a, _) in enumerate(self.rules, 1)]
            return df.withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))).select(*names, "_hit.rule", "_hit.message")
        table: dict[str, list] = {}
        for state, condition, to in self.moves:
            table.setdefault(state, []).append((condition.column(df), to))
        moved = state_transition(df, self.initial, set(self.finals), table, key_by=self.key)
        message = F.coalesce(*[F.when(F.col("state") == s, template(list(a.parts), names, a.separator)) for s, (a, _) in self.finals.items()])
        return moved.withColumn("message", message)

    def submit(self, engine, name: str | None = None, **trigger) -> str:
        result = self.result(engine.spark)
        actions = {i: (a, s) for i, (_, a, s) in enumerate(self.rules, 1)} if self.rules else self.finals
        return engine.submit_stateful(self.application, result, _sent(result, actions, "rule" if self.rules else "state"), name=name, **trigger)
