"""Bounded training samples of labelled documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The held-out fold: rows whose crc32(doc_id as text) leaves 0 when divided by this.
FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % FOLDS == 0


def least(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows, those with the least hash of doc_id: the same rows whatever the partitioning.

    Of large tables only rows below a hash that about twice as many pass are sorted, so that the last task of the sort
    gets that many rows, however many tasks there are."""
    hashed, n = F.xxhash64("doc_id"), df.count()
    if n > 4 * rows:
        df = df.filter(hashed < F.lit(int(-(1 << 63) + (1 << 64) * (2 * rows / n))))
    return df.orderBy(hashed, "doc_id").limit(rows)


def sample(documents: DataFrame, labels: DataFrame, strata: list[tuple[int, Column]]) -> DataFrame:
    """doc_id, text and the labels' columns of labelled documents outside the held-out fold: at most so many rows for
    each condition. `labels` has one row for a doc_id. They are cut to size before they meet the texts, so that join
    moves no text; of several texts of one doc_id the least counts."""
    seen = labels.filter(F.col("doc_id").isNotNull() & ~held_out())
    # A label that no document has costs its place in the sample only.
    picked = reduce(DataFrame.unionByName, [least(seen.filter(condition), rows) for rows, condition in strata])
    joined = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return joined.groupBy(*picked.columns).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
