"""Logs: shaping, substring and token search, postings, retention."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.logtext import parse_log_payload, tokenize

SCHEMA = "time BIGINT, severity STRING, attributes STRING, body STRING"
RETENTION_DAYS = 7


def validate_schema(columns: dict[str, str]) -> None:
    """A logs table has a 64-bit integer `time` and strings `severity` and `body`."""
    types = {k.lower(): v.lower() for k, v in columns.items()}
    if types.get("time") not in ("bigint", "int64", "uint64", "long"):
        raise ValueError("a logs table needs a 64-bit integer column 'time'")
    for name in ("severity", "body"):
        if types.get(name) != "string":
            raise ValueError(f"a logs table needs a string column '{name}'")


def shape(df: DataFrame, time: Column, raw: Column, severity: Column | None = None, attributes: Column | None = None) -> DataFrame:
    """Records from raw payloads; an explicit severity or attributes win over what the payload says."""
    seen = df.select(time.cast("bigint").alias("time"), parse_log_payload(raw).alias("p"), (F.lit(None).cast("string") if severity is None else severity).alias("s"), (F.lit(None).cast("string") if attributes is None else attributes).alias("a"))
    return seen.select("time", F.coalesce("s", "p.severity").alias("severity"), F.coalesce("a", "p.attributes").alias("attributes"), F.col("p.body").alias("body"))


def range_scan(logs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records of [start, end]; None is unbounded."""
    if start is not None:
        logs = logs.filter(F.col("time") >= start)
    return logs if end is None else logs.filter(F.col("time") <= end)


def search_substring(logs: DataFrame, part: str, body: str = "body") -> DataFrame:
    """Records whose body holds `part` as it stands; a `%` at either end is not part of it."""
    part = part[1:] if part.startswith("%") else part
    part = part[:-1] if part.endswith("%") else part
    return logs.filter(F.contains(F.col(body), F.lit(part)))


def search_tokens(logs: DataFrame, text: str, body: str = "body") -> DataFrame:
    """Records whose body has every token of `text`."""
    # The body is cut into tokens once a row; what remains of the query must be nothing.
    return logs.filter(F.size(F.array_except(tokenize(F.lit(text)), tokenize(F.col(body)))) == 0)


def token_postings(logs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(token, key): an inverted index, kept as a table partitioned or bucketed by token."""
    return logs.select(F.explode(tokenize(F.col(body))).alias("token"), key)


#: Folders of a postings table; a token's keys are in one of them.
POSTING_FOLDERS = 64


def _folder(token: Column) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(POSTING_FOLDERS)).cast("int")


def write_postings(postings: DataFrame, path: str) -> None:
    """Appends (token, key) to a table in folders by token, sorted by token: call it with the rows of each append of
    records, so that a search reads a few row groups of a few folders and cuts no body into tokens."""
    key = next(c for c in postings.columns if c != "token")
    dealt = postings.withColumn("folder", _folder(F.col("token"))).repartition("folder", F.pmod(F.xxhash64(key), F.lit(4)))
    dealt.sortWithinPartitions("folder", "token").write.mode("append").partitionBy("folder").option("compression", "zstd").parquet(path)


def read_postings(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """The postings of some tokens; other folders are not listed."""
    folders = sorted({zlib.crc32(t.encode()) % POSTING_FOLDERS for t in tokens})
    return spark.read.parquet(path).filter(F.col("folder").isin(folders) & F.col("token").isin(list(tokens))).drop("folder")


def search_postings(postings: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """Keys of the records that have all of `tokens`: one pass over the postings, one aggregation."""
    wanted = sorted(set(tokens))
    return postings.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.count_distinct("token").alias("found")).filter(F.col("found") == len(wanted)).select(key)


def retain(logs: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Records not older than `days` before `now` (epoch seconds); on a table partitioned by day old folders are not read."""
    return logs.filter(F.col("time") >= now - days * 86_400)


def expire_postings(postings: DataFrame, cutoff: int, time: str = "time") -> DataFrame:
    """An index without what lies before the cutoff."""
    return postings.filter(F.col(time) >= cutoff)
