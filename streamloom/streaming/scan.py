"""Ordered stateful passes: rows of each key in order, one at a time, state carried along.

Rows are dealt by key and sorted; a partition is streamed through in Arrow batches with the state
of the current key only, so that no group is held in memory. Values are Python's own, so that
integers keep all their digits beside nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from streamloom.session import ready

_NONE = object()


def as_keys(key: str | list[str] | tuple[str, ...] | None) -> list[str]:
    return [] if key is None else [key] if isinstance(key, str) else list(key)


def comparable(values) -> tuple:
    """Key values that compare as Spark groups them: null equals null, and NaN equals NaN."""
    return tuple("NaN" if v != v else v for v in values)


def _in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with the rows of each key in one partition, in order; without keys all in one task."""
    ready(df.sparkSession)
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sorted_scan(df: DataFrame, key, order: list[str], schema: StructType | str, start: Callable[[], object], step: Callable, finish: Callable | None = None) -> DataFrame:
    """The rows that step gives for every row of df, in order within each key.

    step(state, row) returns (state, list of output tuples); row is a dict. finish(state), if
    given, returns the tuples that end a key. Without a key all rows are one stream in one task, as
    an un-keyed operator demands. Null keys are one key. An empty table gives an empty result.
    """
    keys = as_keys(key)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, columns = to_arrow_schema(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = _NONE, None
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                mine = comparable(row[k] for k in keys)
                if mine != current:
                    if finish and current is not _NONE:
                        out += finish(state)
                    current, state = mine, start()
                state, rows = step(state, row)
                out += rows
            yield to_batch(out, arrow)
        if finish and current is not _NONE:
            yield to_batch(finish(state), arrow)

    return _in_order(df, keys, order).mapInArrow(run, schema)


def column_scan(df: DataFrame, key, order: list[str], inputs: list[str], result: StructField, start: Callable[[], object], step: Callable, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with a column that step makes of some columns, in order within each key; other columns pass untouched.

    step(state, *inputs) returns (state, value, whether the row stays). The columns in drop go, and
    so does one of df that has the result's name.
    """
    keys = as_keys(key)
    gone = {result.name, *drop}
    kept = [i for i, c in enumerate(df.columns) if c not in gone]
    schema = StructType([df.schema.fields[i] for i in kept] + [result])
    arrow, columns = to_arrow_schema(schema), df.columns
    at, mine_at = [columns.index(c) for c in inputs], [columns.index(c) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = _NONE, None
        for batch in batches:
            n = batch.num_rows
            groups = map(comparable, zip(*(batch.column(i).to_pylist() for i in mine_at), strict=True)) if keys else [()] * n
            values, stays = [], []
            rows = zip(*(batch.column(i).to_pylist() for i in at), strict=True) if at else [()] * n
            for mine, row in zip(groups, rows, strict=True):
                if mine != current:
                    current, state = mine, start()
                state, value, stay = step(state, *row)
                stays.append(stay)
                if stay:
                    values.append(value)
            mask = pa.array(stays, pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(mask) for i in kept), pa.array(values, arrow.field(len(kept)).type)], names=arrow.names)

    return _in_order(df, keys, order).mapInArrow(run, schema)
