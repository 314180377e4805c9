"""A training corpus from `documents`: five stages, each reading what the one before wrote.

Rejected by quality, then by language, then all but one of each group of near-duplicates, then contaminated documents
leave; the rest is encoded. Each stage learns and counts over its own input only; labels and benchmark come from the
folder of the tables.

Cases: each operator's docstring has its rules for nulls, empty and long texts, ties and repeated rows; an empty table
gives an empty result of the same columns; columns beyond doc_id and text are optional, pass through all stages but the
last and are left out there but for lang and source, so that none can clash with its new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, minhash, quality, treebpe
from strandline.llm.common import discard, new_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a rating above the lowest is at least one half."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is told above the calibrated threshold."""
    return langid.kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group linked by a Jaccard of 0.8 of five-word shingles."""
    return minhash.kept(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows."""
    return decontam.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), their number, and whether they decode to the text."""
    own = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    tokens = treebpe.with_tokens(docs.select(*own, "text"))
    return tokens.select(
        *own, "ids", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Models, random hashes and components have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written as Parquet to the shared folder and read again. A stage's
    input goes when its result is written; the last result stays in a folder of its own, for the caller to empty."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        discard(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
