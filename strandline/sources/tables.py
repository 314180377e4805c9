"""Relational tables kept as parquet, one folder or file each, and a scratch folder for what queries write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; columns and filters used later reach the parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def within(df: DataFrame, column: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows whose timestamp `column` (UTC) lies in [start, end] epoch seconds, the last second whole; the bounds are
    literals of the column's own type, so that they reach the reader."""
    kind = dict(df.dtypes)[column]
    moment = lambda seconds: F.lit(datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").cast(kind)
    if start is not None:
        df = df.filter(F.col(column) >= moment(start))
    return df if end is None else df.filter(F.col(column) < moment(end + 1))


def scratch_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or (unset, with a local master) a temp
    folder. What queries write there is their result; the folder's owner empties it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/strandline-core"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strandline-core-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"
