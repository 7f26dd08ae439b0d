"""Runs plain row and group functions over Arrow batches."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Functions sent to executors travel by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules["voxframe"])


def _schema(ddl: str) -> tuple[StructType, pa.Schema]:
    kind = _parse_datatype_string(ddl)
    return kind, to_arrow_schema(kind)


def map_rows(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """One output row per input row: f gets the row's values, and gives the new row as a tuple."""
    kind, arrow = _schema(schema)

    def run(batches):
        for batch in batches:
            rows = [f(*r) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def flat_map_rows(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Any number of output rows per input row."""
    kind, arrow = _schema(schema)

    def run(batches):
        for batch in batches:
            rows = [out for r in zip(*[c.to_pylist() for c in batch.columns], strict=True) for out in f(*r)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def count_rows(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """The rows that f gives for each input row, a batch's equal ones once; their number is the schema's last column."""
    kind, arrow = _schema(schema)

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found.update(f(*r))
            cols = list(zip(*[(*row, n) for row, n in found.items()], strict=True)) if found else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def on_distinct(df: DataFrame, column: str, f: Callable, schema: str, name: str) -> DataFrame:
    """Adds ``name``: f of each distinct value, found once and joined back."""
    values = map_rows(df.select(column).distinct(), lambda v: (v, None if v is None else f(v)), f"{column} string, {name} {schema}")
    return df.join(values, column, "left")


def with_columns(df: DataFrame, f: Callable, schema: str, columns: dict[str, str]) -> DataFrame:
    """Adds, for each column named, another of f of its values; the rest goes by as it is."""
    kind, arrow = _schema(", ".join(f"{new} {schema}" for new in columns.values()))

    def run(batches):
        for batch in batches:
            more = [pa.array([None if x is None else f(x) for x in batch.column(c).to_pylist()], t.type) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *columns.values()])

    return df.mapInArrow(run, StructType([*df.schema, *kind]))
