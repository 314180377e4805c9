"""Time-series metrics: points, range and tag scans, tag postings, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.tags import has_tags, tags_to_map

SCHEMA = "time BIGINT, tags STRING, metric_name STRING, value DOUBLE"


def validate_schema(columns: dict[str, str]) -> None:
    """A metrics table has a 64-bit integer `time` and another numeric column."""
    types = {k.lower(): v.lower() for k, v in columns.items()}
    if types.get("time") not in ("bigint", "int64", "uint64", "long"):
        raise ValueError("a metrics table needs a 64-bit integer column 'time'")
    if not any(v in ("bigint", "int64", "uint64", "long", "double", "float64") for k, v in types.items() if k != "time"):
        raise ValueError("a metrics table needs a numeric value column")


def shape(df: DataFrame, time: Column, tags: Column, value: Column, metric_name: Column | str) -> DataFrame:
    """Points from any rows; a metric name given as text is that of all (as a table's name is by default)."""
    name = F.lit(metric_name) if isinstance(metric_name, str) else metric_name
    return df.select(time.cast("bigint").alias("time"), tags.alias("tags"), name.alias("metric_name"), value.cast("double").alias("value"))


def range_scan(points: DataFrame, start: int | None = None, end: int | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """Points of [start, end] (None: unbounded) that have all the tags. Bounds on a stored `time` reach the reader; for a
    computed one bound the stored column as well (`sources.tables.within`)."""
    if start is not None:
        points = points.filter(F.col("time") >= start)
    if end is not None:
        points = points.filter(F.col("time") <= end)
    if not tags:
        return points
    # A text without a wanted key and value cannot hold the tag (but for escapes in JSON): most rows end here, unparsed.
    text = F.col("tags")
    for part in (x for pair in tags.items() for x in pair):
        points = points.filter(F.contains(text, F.lit(part)) | F.contains(text, F.lit("\\")))
    return points.filter(has_tags(tags_to_map(text), tags))


def tag_postings(points: DataFrame, key: str) -> DataFrame:
    """(tag, tag_value, key): an inverted index of the points by `key`, a column that identifies them."""
    return points.select(key, F.explode(tags_to_map(F.col("tags"))).alias("tag", "tag_value")).select("tag", "tag_value", key)


def indexed_scan(points: DataFrame, postings: DataFrame, key: str, tags: dict[str, str], start: int | None = None, end: int | None = None) -> DataFrame:
    """As range_scan, through the intersection of the tags' postings."""
    out = range_scan(points, start, end)
    if not tags:
        return out
    pair = F.struct("tag", "tag_value")
    wanted = postings.filter(pair.isin([F.struct(F.lit(k), F.lit(v)) for k, v in tags.items()]))
    hit = wanted.groupBy(key).agg(F.count_distinct("tag").alias("found")).filter(F.col("found") == len(tags)).select(key)
    return out.join(hit, key, "left_semi")


def rollup(points: DataFrame, seconds: int, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """count, sum, min and max of each bucket (and of each series by the columns `by`)."""
    total = F.sum("value") if digits is None else F.round(F.sum("value"), digits)
    start = F.expr(f"time div {max(1, seconds)} * {max(1, seconds)}").alias("bucket")
    return points.groupBy(start, *(by or [])).agg(F.count("value").alias("count"), total.alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))


def rollups(points: DataFrame, resolutions: tuple[int, ...] = (60, 300), by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """All resolutions with a column `resolution_s`; each coarser one that is a multiple is made of the finest's buckets."""
    finest = min(resolutions)
    base = rollup(points, finest, by)
    out = []
    for r in sorted(resolutions):
        if r == finest:
            one = base
        elif r % finest == 0:
            one = base.groupBy(F.expr(f"bucket div {r} * {r}").alias("bucket"), *(by or [])).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
        else:
            one = rollup(points, r, by)
        out.append(one.withColumn("resolution_s", F.lit(r)))
    whole = reduce(DataFrame.unionByName, out)
    return whole if digits is None else whole.withColumn("sum", F.round("sum", digits))


def rollup_scan(buckets: DataFrame, start: int, end: int) -> DataFrame:
    """Buckets that begin in [start, end]."""
    return buckets.filter(F.col("bucket").between(start, end))
