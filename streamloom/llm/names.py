"""Columns of a caller's table whose names an operator needs for its own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """df with the columns of the names in `taken` (in any case) renamed, and the columns that give df back."""
    taken = {t.lower() for t in taken}
    names = {c: f"_own{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in df.columns]
