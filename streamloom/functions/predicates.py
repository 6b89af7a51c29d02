"""Comparison and boolean predicates over columns, checked against the schema when planned."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {int: (T.IntegerType, T.LongType), float: (T.DoubleType,), str: (T.StringType,)}
_OPS = {"EQ": "__eq__", "NEQ": "__ne__", "GT": "__gt__", "GE": "__ge__", "LT": "__lt__", "LE": "__le__"}


def compare(df: DataFrame, field: str, op: str, value) -> Column:
    """field op value. Ordering needs the field's own type; EQ of another type is false, NEQ true.

    Unknown fields and operators raise when planned. A null field satisfies none but NEQ.
    """
    if op not in _OPS:
        raise ValueError(f"unknown comparison {op}")
    if field not in df.columns:
        raise ValueError(f"no field {field}")
    same = isinstance(df.schema[field].dataType, _KINDS.get(type(value), ()))
    if not same:
        if op in ("EQ", "NEQ"):
            return F.lit(op == "NEQ")
        raise TypeError(f"{field} is {df.schema[field].dataType.simpleString()}, which doesn't order against {value!r}")
    if op in ("EQ", "NEQ"):
        equal = F.col(field).eqNullSafe(F.lit(value))
        return equal if op == "EQ" else ~equal
    return F.coalesce(getattr(F.col(field), _OPS[op])(F.lit(value)), F.lit(False))


def all_of(*conditions: Column) -> Column:
    """AND; true for none."""
    return reduce(and_, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    """OR; false for none."""
    return reduce(or_, conditions, F.lit(False))
