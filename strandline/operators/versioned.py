"""Versioned tables: rows with `_version` and `_deleted`, read as of a version; changes are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MUTATION_CAP = 1000


class MutationError(ValueError):
    """A change that its guards refuse."""


def append(log: DataFrame, rows: DataFrame, version: int, deleted: bool = False) -> DataFrame:
    """The log with `rows` (its columns without the two of the version) added at `version`."""
    return log.unionByName(rows.withColumns({"_version": F.lit(version).cast("bigint"), "_deleted": F.lit(deleted)}))


def append_checked(log: DataFrame, rows: DataFrame, key: list[str], version: int, deleted: bool = False) -> DataFrame:
    """As append, but refused unless the version is above all in the log and the rows have whole keys, each once."""
    last = log.agg(F.max("_version")).first()[0]
    if last is not None and version <= last:
        raise MutationError(f"version {version} is not above {last}")
    check(rows, key)
    return append(log, rows, version, deleted)


def check(rows: DataFrame, key: list[str]) -> None:
    """Raises MutationError where a key has a null or stands twice; stops at the first such key."""
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    bad = rows.groupBy(*key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing).first()
    if bad is not None:
        raise MutationError(f"key {[bad[k] for k in key]} is not unique or not whole")


def _newest(log: DataFrame, key: list[str]) -> Column:
    # Tasks keep one row for each key before the shuffle. Catalyst sorts for that (a row is no fixed-size state), but
    # moves the newest versions only, where a window would move and sort all.
    return F.max_by(F.struct(*[c for c in log.columns if c not in key]), F.col("_version"))


def snapshot(log: DataFrame, key: list[str], as_of: int) -> DataFrame:
    """The newest version not after `as_of` of each key, without deleted rows."""
    newest = log.filter(F.col("_version") <= as_of).groupBy(*key).agg(_newest(log, key).alias("row"))
    return newest.filter("NOT row._deleted").select(*[F.col(c) if c in key else F.col(f"row.{c}") for c in log.columns if c not in ("_version", "_deleted")])


def vacuum(log: DataFrame, key: list[str], older_than: int) -> DataFrame:
    """Without versions that no read at or after `older_than` needs: the newest one not after it and all later ones
    stay; a key whose only trace is a deletion goes."""
    mine = Window.partitionBy(*key)
    marked = log.withColumn("_keep", F.max(F.when(F.col("_version") <= older_than, F.col("_version"))).over(mine)).withColumn("_last", F.max("_version").over(mine))
    needed = (F.col("_version") > older_than) | (F.col("_version") == F.col("_keep"))
    dead = F.col("_deleted") & (F.col("_version") == F.col("_last")) & (F.col("_version") <= older_than)
    return marked.filter(needed & ~dead).drop("_keep", "_last")


def _matched(log: DataFrame, key: list[str], as_of: int, where: Column | None, cap: int | None, allow_all: bool) -> DataFrame:
    if where is None and not allow_all:
        raise MutationError("a condition is required")
    rows = snapshot(log, key, as_of)
    rows = rows if where is None else rows.filter(where)
    if cap is not None and rows.limit(cap + 1).count() > cap:
        raise MutationError(f"more than {cap} rows match")
    return rows


def update(log: DataFrame, key: list[str], as_of: int, values: dict[str, object], where: Column | None, cap: int | None = MUTATION_CAP) -> DataFrame:
    """The log with the rows that match at `as_of` set to `values` (literals or columns) at version as_of + 1; keys cannot change."""
    if unknown := set(values) - set(log.columns):
        raise MutationError(f"unknown columns: {sorted(unknown)}")
    if set(values) & set(key):
        raise MutationError("key columns cannot change")
    rows = _matched(log, key, as_of, where, cap, allow_all=False)
    types = dict(rows.dtypes)
    return append(log, rows.withColumns({c: (v if isinstance(v, Column) else F.lit(v)).cast(types[c]) for c, v in values.items()}), as_of + 1)


def delete(log: DataFrame, key: list[str], as_of: int, where: Column | None, cap: int | None = MUTATION_CAP, allow_all: bool = False) -> DataFrame:
    """The log with deletions, at version as_of + 1, of the rows that match at `as_of`."""
    return append(log, _matched(log, key, as_of, where, cap, allow_all), as_of + 1, deleted=True)


def compact(spark: SparkSession, path: str, files: int) -> None:
    """Rewrites a parquet table of many small files as `files` ones: beside it first, then in its place. Readers that
    began before keep to files that are gone, so compact while none runs; the rows are counted before the old ones go."""
    jvm = spark.sparkContext._jvm
    at, fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", "-compacting", "-before"))
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    table = spark.read.parquet(path)
    table.repartition(files).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}-compacting")
    if spark.read.parquet(f"{path}-compacting").count() != table.count():
        raise MutationError("rows came or went while compacting")
    store.rename(at, old)
    store.rename(fresh, at)
    store.delete(old, True)
    spark.catalog.refreshByPath(path)
