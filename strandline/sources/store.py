"""Append-only stores of metric points and log records: parquet in day folders, so that time bounds skip whole days."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400
#: A hidden folder of a store, which readers of the rows skip.
_SCHEMA = "_schema"


def append(rows: DataFrame, path: str, sort: str = "time", codec: str = "zstd") -> None:
    """Adds rows (with epoch seconds `time`) to their days' folders, in order of time within a file, as one commit.

    Rows without a time get a folder of their own, which no bound and no retention touches. Rows are dealt by day and a slice of the day, so a day of any size is written by many tasks in few files."""
    day = F.expr(f"cast(floor(time / {DAY}) AS bigint)")
    dealt = rows.withColumn("day", day).repartition("day", F.expr(f"pmod(time, {DAY}) div 3600"))
    dealt.sortWithinPartitions("day", sort).write.mode("append").partitionBy("day").option("compression", codec).parquet(path)
    spark = rows.sparkSession
    if not _exists(spark, f"{path}/{_SCHEMA}"):
        spark.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}/{_SCHEMA}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of [start, end]: days outside are not listed, row groups outside are not read. schema: of the rows, needed
    where retention may have dropped every day; without it such a store is read from the schema that `append` kept."""
    kept = f"{path}/{_SCHEMA}"
    if schema is None and _exists(spark, kept):
        schema = T.StructType.fromJson(json.loads(spark.read.text(kept, wholetext=True).first()[0]))
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.LongType())]))
    rows = reader.parquet(path)
    if start is not None:
        rows = rows.filter((F.col("day") >= start // DAY) & (F.col("time") >= start))
    if end is not None:
        rows = rows.filter((F.col("day") <= end // DAY) & (F.col("time") <= end))
    return rows.drop("day")


def drop_before(spark: SparkSession, path: str, cutoff: int) -> int:
    """Deletes the day folders that end before `cutoff`; gives how many. A reader's own bound hides the rest of its day."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    store, gone = root.getFileSystem(conf), 0
    for entry in store.listStatus(root):
        name = entry.getPath().getName()
        if entry.isDirectory() and re.fullmatch(r"day=-?\d+", name) and (int(name[4:]) + 1) * DAY <= cutoff:
            store.delete(entry.getPath(), True)
            gone += 1
    return gone
