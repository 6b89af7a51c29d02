"""Condition and action rules over typed rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.predicates import all_of, any_of, compare
from streamloom.functions.text import template
from streamloom.operators.fsm import state_transition


@dataclass(frozen=True)
class Condition:
    """A comparison (field, op, value), or AND / OR of conditions."""

    op: str
    field: str | None = None
    value: object = None
    parts: tuple[Condition, ...] = ()

    def column(self, df: DataFrame) -> Column:
        if self.op in ("AND", "OR"):
            return (all_of if self.op == "AND" else any_of)(*[p.column(df) for p in self.parts])
        return compare(df, self.field, self.op, self.value)


@dataclass(frozen=True)
class Action:
    """Text parts with $field placeholders, joined by a separator."""

    parts: tuple[str, ...]
    separator: str = ","


def stateless_rules(df: DataFrame, rules: list[tuple[Condition, Action]], or_duplicates: bool = False) -> DataFrame:
    """df with rule (1-based) and message, a row for each rule whose condition holds, in one pass.

    With or_duplicates a top-level OR gives a row for each arm that holds.
    """
    hits = []
    for i, (condition, action) in enumerate(rules):
        arms = condition.parts if or_duplicates and condition.op == "OR" else (condition,)
        message = template(list(action.parts), df.columns, action.separator)
        hits += [F.when(arm.column(df), F.struct(F.lit(i + 1).alias("rule"), message.alias("message"))) for arm in arms]
    found = df.withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return found.select(*df.columns, "_hit.rule", "_hit.message")


def stateful_rules(
    df: DataFrame, initial: str, transitions: list[tuple[str, Condition, str]], actions: dict[str, Action], ts: str = "ts", seq: str = "seq", key_by: str | None = None
) -> DataFrame:
    """Rows after which the machine is in a state with an action, with state and message added.

    transitions are (from, condition, to) in the order in which they are tried.
    """
    table: dict[str, list[tuple[Column, str]]] = {}
    for source, condition, to in transitions:
        table.setdefault(source, []).append((condition.column(df), to))
    moved = state_transition(df, initial, set(actions), table, ts, seq, key_by)
    messages = reduce(
        lambda other, s: F.when(F.col("state") == s, template(list(actions[s].parts), df.columns, actions[s].separator)).otherwise(other), sorted(actions), F.lit(None).cast("string")
    )
    return moved.withColumn("message", messages)
