"""Delimited text to typed columns, and rows to text by templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPES = {"INTEGER": "int", "LONG": "bigint", "DOUBLE": "double", "STRING": "string"}


def parse_delimited(df: DataFrame, column: str, fields: list[tuple[str, str]], separator: str = ",") -> DataFrame:
    """df with the fields (name, INTEGER | LONG | DOUBLE | STRING) of a text column added.

    The text is split by the separator as a regular expression; fields are trimmed and cast; more
    fields than named are ignored; too few, or one that doesn't cast, raise when run.
    """
    parts = F.split(F.col(column), separator)
    enough = F.when(F.size(parts) >= len(fields), parts).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.coalesce(column, F.lit("null")))))
    split = df.withColumn("_parts", enough)
    return split.withColumns({name: F.trim(F.col("_parts")[i]).cast(_TYPES[kind]) for i, (name, kind) in enumerate(fields)}).drop("_parts")


def template(parts: list[str], fields: list[str], separator: str = "", values: dict[str, Column] | None = None) -> Column:
    """The parts joined by the separator, each $name replaced by its value, longest names first.

    Names are fields of the rows, and those of values, which gives a column for each. Null values
    are written null. Values are taken as they are: a $name in one is not replaced.
    """
    known = {n: F.col(n) for n in fields} | (values or {})
    names = "|".join(re.escape(n) for n in sorted(known, key=len, reverse=True))
    text = separator.join(parts)
    pieces = re.split(rf"\$({names})", text) if names else [text]
    out = [F.lit(p) if i % 2 == 0 else F.coalesce(known[p].cast("string"), F.lit("null")) for i, p in enumerate(pieces) if p]
    return F.concat(F.lit(""), *out)
