"""Inserts: defaults, NOT NULL, coercion to the target's types; one atomic write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_CAP = 1000
_numeric = {"bigint", "double", "decimal(20,0)"}
_textual = {"string", "binary"}


class InsertError(ValueError):
    """Rows that do not fit the table."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    not_null: bool = False
    default: object = None


def _checked(value: Column, spec: ColumnSpec) -> Column:
    """The value, or an error for a null where none may be; checked as rows are written, without a pass of its own."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"NULL in column {spec.name}")).cast(spec.type)).otherwise(value) if spec.not_null else value


def rows_of_values(spark: SparkSession, schema: list[ColumnSpec], values: list[tuple], columns: list[str] | None = None, cap: int = BATCH_CAP) -> DataFrame:
    """INSERT ... VALUES: literals for `columns` (all, if None), defaults or nulls for the rest. All rows are checked before any is used."""
    if len(values) > cap:
        raise InsertError(f"more than {cap} rows")
    specs = {c.name.lower(): c for c in schema}
    names = [c.lower() for c in columns] if columns is not None else list(specs)
    if len(set(names)) < len(names):
        raise InsertError("a column is named twice")
    if unknown := [n for n in names if n not in specs]:
        raise InsertError(f"unknown columns: {unknown}")
    out = []
    for row in values:
        if len(row) != len(names):
            raise InsertError("a row has another number of values than columns")
        given = dict(zip(names, row, strict=True))
        full = [given.get(n, s.default) for n, s in specs.items()]
        for value, spec in zip(full, schema, strict=True):
            if value is None and spec.not_null:
                raise InsertError(f"NULL in column {spec.name}")
        out.append(tuple(_literal(v, s) for v, s in zip(full, schema, strict=True)))
    return spark.createDataFrame(out, T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in schema]))


def _literal(value, spec: ColumnSpec):
    """A literal as the column's type has it: numbers between numeric types, text as a number where it is one."""
    try:
        if value is None:
            return None
        if spec.type == "bigint":
            if isinstance(value, float) and not value.is_integer():
                raise ValueError
            return int(value)
        if spec.type == "double":
            return float(value)
        if spec.type == "boolean":
            return bool(value)
        if spec.type == "string":
            return value.decode() if isinstance(value, bytes) else str(value)
        return bytearray(value.encode() if isinstance(value, str) else value) if spec.type == "binary" else value
    except (ValueError, TypeError) as e:
        raise InsertError(f"{value!r} does not fit column {spec.name} {spec.type}") from e


def rows_of_select(source: DataFrame, schema: list[ColumnSpec]) -> DataFrame:
    """INSERT ... SELECT: columns by place, numbers to numbers and text to text; an overflow or a null where none may be fails the write."""
    if len(source.columns) != len(schema):
        raise InsertError("the query has another number of columns than the table")
    out = []
    for (name, have), spec in zip(source.dtypes, schema, strict=True):
        have = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}.get(have, have)
        if have != spec.type and not ({have, spec.type} <= _numeric or {have, spec.type} <= _textual):
            raise InsertError(f"{have} does not fit column {spec.name} {spec.type}")
        out.append(_checked(F.col(f"`{name}`").cast(spec.type), spec).alias(spec.name))
    return source.select(*out)


def insert(rows: DataFrame, path: str) -> None:
    """Appends in one atomic write."""
    rows.write.mode("append").parquet(path)
