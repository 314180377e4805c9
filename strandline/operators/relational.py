"""Relational operators as thin builders: Catalyst plans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, columns: list[str] | None = None, where: Column | None = None, lo: tuple[str, object] | None = None, hi: tuple[str, object] | None = None) -> DataFrame:
    """Columns and rows of a table; lo and hi bound a column to [lo, hi). All of it reaches the parquet reader."""
    if lo:
        df = df.filter(F.col(lo[0]) >= F.lit(lo[1]))
    if hi:
        df = df.filter(F.col(hi[0]) < F.lit(hi[1]))
    if where is not None:
        df = df.filter(where)
    return df if columns is None else df.select(*columns)


def point_get(df: DataFrame, **key) -> DataFrame:
    """The rows of one key."""
    for name, value in key.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def theta_join(left: DataFrame, right: DataFrame, on: Column | None, how: str = "inner") -> DataFrame:
    """Any condition, or none (a cross join)."""
    return left.crossJoin(right) if on is None else left.join(right, on, how)


def hash_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", residual: Column | None = None, strategy: str | None = None) -> DataFrame:
    """An equi-join, with more conditions if `residual`; nulls never match. Catalyst and adaptive execution pick the
    strategy from sizes (broadcast, hash or sort-merge, split where skewed); `strategy` names a hint for the right side."""
    return left.join(right.hint(strategy) if strategy else right, on if residual is None else on & residual, how)


def multiway_join(first: DataFrame, *rest: tuple[DataFrame, Column]) -> DataFrame:
    """Joins in the order given; Catalyst may reorder them."""
    for df, on in rest:
        first = first.join(df, on)
    return first


def aggregate(df: DataFrame, keys: list[Column | str], **aggs: Column) -> DataFrame:
    """Grouped or (without keys) global aggregation; without aggregates the distinct keys."""
    named = [c.alias(k) for k, c in aggs.items()]
    if not named:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*named) if keys else df.agg(*named)


def sort(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """(column, ascending) keys; nulls come first in ascending and last in descending order."""
    return df.orderBy(*[F.asc_nulls_first(k) if up else F.desc_nulls_last(k) for k, up in keys])


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows after `offset`, `limit` at most (0: none)."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def numbered(ordered: DataFrame, name: str, path: str) -> DataFrame:
    """An ordered frame with each row's place from 1, kept as a table at `path`: the rows stay in their range partitions,
    and one count for each of these comes to the driver. Written first, as a plan that ran twice could part them otherwise."""
    spark = ordered.sparkSession
    ordered.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    marked, part = spark.read.parquet(path), F.shiftrightunsigned(name, 33)
    bases, done = [], 0
    for k, n in sorted(tuple(r) for r in marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        bases.append((k, done))
        done += n
    known = F.broadcast(spark.createDataFrame(bases, "_part long, _before long"))
    return marked.join(known, part == F.col("_part")).withColumn(name, F.col("_before") + F.col(name).bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with `values` of the right row of the same `by` with the latest `at` not after its own (nulls where
    there is none). Both sides go into one sorted window, so a key's rows meet once, without a pair for each match."""
    none = [F.lit(None).cast(t).alias(n) for n, t in right.dtypes if n in values]
    asked = left.select(F.struct(*left.columns).alias("_row"), *by, at, *none, F.lit(1).alias("_side"))
    told = right.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), *by, at, *values, F.lit(0).alias("_side"))
    upto = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(upto)
    return asked.unionByName(told).withColumn("_found", last).filter("_side = 1").select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points with each range [lo, hi] that holds them: an equi-join on cells of `width`, then the bounds."""
    cell = F.floor(F.col(at) / width)
    cells = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    wide = ranges.filter(F.col(lo) <= F.col(hi)).withColumn("_cell", F.explode(cells))
    return points.withColumn("_cell", cell).join(wide, "_cell").filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_cell")
