"""Sharding by Hilbert-curve order: rows near each other in several metadata dimensions land in the same files.

Each dimension is quantised into 2**BITS ranges of about equal row counts (cut points of numbers from approximate
percentiles, of strings from the counts of all their values, whole and in byte order), the ranges' numbers become one index along a Hilbert curve, and
rows sorted by (index, doc_id, text checksum) are cut into runs of equal counts (law `rows`: at most one apart). Each
shard is a folder of parquet files in curve order, so that a file's minima and maxima are tight in all dimensions.

Only small columns are sorted to find the cuts: a pass over (index, doc_id, checksum) gives the key at each cut, and
the texts move once, straight to their shard. What comes to the driver is one number for each partition and file and
one key for each cut.

Cases: null texts count 16 bytes and checksum 0; null dimension values come first; long texts are moved whole; rows
with equal keys are told apart by number when a cut falls among them; an empty table gives empty shards; other
columns are written with the texts, and `shard`, `slot` and the working columns are renamed out of the way of a clash.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import bound_batches, dealt, discard, new_path, staged
from strandline.llm.words import as_list

SHARDS = 40
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of `cells` (rows x dimensions, each below 2**bits): axes to transposed
    index by Skilling's transform, then its bits interleaved."""
    x = cells.T.astype(np.int64).copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def cut_points(df: DataFrame, names: list[str], bits: int = BITS) -> dict[str, list]:
    """For each of the columns the values that begin its ranges after the first."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    types = dict(df.dtypes)
    numbers = [n for n in names if types[n] != "string"]
    row = df.agg(*[F.percentile_approx(F.col(n), shares, 10_000).alias(n) for n in numbers]).first() if numbers else {}
    return {n: sorted(set(row[n] or [])) if n in numbers else string_cuts(df, n, 1 << bits) for n in names}


def string_cuts(df: DataFrame, column: str, ranges: int) -> list[str]:
    """The values at which each range of a string column begins, from the counts of all values; one row for each range
    and for each partition comes to the driver."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    numbered = counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("id", F.monotonically_increasing_id())
    ordered = staged(numbered.select("value", "n", F.shiftrightunsigned("id", 33).alias("part"), "id"), "hilbert-values")
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total, done, wanted = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        wanted += [(part, -(-k * total // ranges) - done) for k in range(1, ranges) if done <= -(-k * total // ranges) < done + sizes[part]]
        done += sizes[part]
    if not wanted:
        return []
    upto = ordered.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("id")))
    asked = F.broadcast(df.sparkSession.createDataFrame(wanted, "part long, rank long"))
    rows = upto.join(asked, "part").filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("value").distinct().collect()
    discard(df.sparkSession, ordered)
    least = df.agg(F.min(column)).first()[0]
    return sorted(r["value"] for r in rows if r["value"] != least)


def cells_of(column: pa.Array, cuts: list) -> np.ndarray:
    """The range of each value; nulls lie in the first."""
    if pa.types.is_string(column.type):
        coded = column.fill_null("").dictionary_encode()
        each = np.fromiter((bisect_right(cuts, v) for v in as_list(coded.dictionary)), np.int64, len(coded.dictionary))
        return each[coded.indices.to_numpy()] if len(column) else each
    return np.searchsorted(np.array(cuts, np.float64), np.asarray(column.fill_null(-np.inf)), side="right")


def curve(columns: list[Column], cuts: list[list], bits: int = BITS) -> Column:
    """The curve index of columns (strings or doubles) with the cut points of each."""

    @F.arrow_udf("long")
    def index(*values: pa.Array) -> pa.Array:
        return pa.array(hilbert_index(np.stack([cells_of(v, c) for v, c in zip(values, cuts, strict=True)], 1), bits))

    return index(*columns)


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def write_shards(documents: DataFrame, path: str, dimensions: dict[str, Column], shards: int = SHARDS, bits: int = BITS, text: str = "text", key: str = "doc_id") -> str:
    """Writes all columns of `documents` into folders `<name>=0..` under `path` and gives that name."""
    spark = documents.sparkSession
    shard = _free("shard", documents.columns)
    at, checksum = _free("curve", documents.columns), _free("checksum", documents.columns)
    own_key = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))
    bound_batches(spark)
    names = [f"d{i}" for i in range(len(dimensions))]
    types = dict(documents.select(*[d.alias(n) for n, d in zip(names, dimensions.values(), strict=True)]).dtypes)
    typed = [d if types[n] == "string" else d.cast("double") for n, d in zip(names, dimensions.values(), strict=True)]
    facts = staged(
        documents.select(own_key.alias("k"), F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("c"), *[d.alias(n) for n, d in zip(names, typed, strict=True)]), "hilbert-facts"
    )
    found = cut_points(facts, names, bits)
    cuts = [found[n] for n in names]
    keys = facts.select(curve([F.col(n) for n in names], cuts, bits).alias("h"), "k", "c")
    placed = staged(
        keys.repartitionByRange("h", "k", "c").sortWithinPartitions("h", "k", "c").withColumn("id", F.monotonically_increasing_id())
        .select("h", "k", "c", F.shiftrightunsigned("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place")),
        "hilbert-keys",
    )
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, bases, done = sum(sizes.values()), {}, 0
    for part in sorted(sizes):
        bases[part], done = done, done + sizes[part]
    wanted = []  # (part, place) of the first row of each shard but the first
    for s in range(1, shards):
        rank = -(-s * total // shards)
        part = max((p for p in bases if bases[p] <= rank < bases[p] + sizes[p]), default=None)
        wanted.append(None if part is None else (part, rank - bases[part]))
    found = {}
    if any(wanted):
        rows = placed.join(F.broadcast(spark.createDataFrame(sorted({w for w in wanted if w}), "part long, place long")), ["part", "place"]).collect()
        found = {(r["part"], r["place"]): (r["h"], r["k"], r["c"]) for r in rows}
    starts = [found[w] if w else None for w in wanted]
    # Rows equal to a start key that come before the cut: their number decides, and only theirs is counted.
    tied = {}
    if starts_set := {s for s in starts if s}:
        where = spark.createDataFrame(sorted(starts_set), "h long, k long, c long")
        ranks = placed.join(F.broadcast(where), ["h", "k", "c"]).groupBy("h", "k", "c", "part").agg(F.min("place").alias("place"), F.count("*").alias("n")).collect()
        least = {}
        for r in ranks:
            x = (r["h"], r["k"], r["c"])
            first, n = least.get(x, (total, 0))
            least[x] = (min(first, bases[r["part"]] + r["place"]), n + r["n"])
        tied = {x: first for x, (first, n) in least.items() if n > 1}
    discard(spark, facts, placed)

    cut_keys = [s for s in starts if s]
    lits = [F.struct(*[F.lit(v).cast("long") for v in s]) for s in cut_keys]
    number = F.size(F.filter(F.array(*lits), lambda b: b <= F.struct(F.col(at).alias("col1"), own_key.alias("col2"), F.col(checksum).alias("col3")))) if lits else F.lit(0)
    keyed = documents.withColumn(at, curve(typed, cuts, bits)).withColumn(checksum, F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    placed = keyed.withColumn(shard, number.cast("int"))
    if tied:
        is_tied = F.lit(False)
        for h, k, c in tied:
            is_tied = is_tied | ((F.col(at) == h) & (own_key == k) & (F.col(checksum) == c))
        count = _free("number", placed.columns)
        some = placed.filter(is_tied).withColumn(count, F.row_number().over(Window.partitionBy(at, own_key, checksum).orderBy(F.col(f"`{text}`"))) - 1)
        rank = F.lit(None).cast("long")
        for (h, k, c), first in tied.items():
            rank = F.when((F.col(at) == h) & (own_key == k) & (F.col(checksum) == c), F.col(count) + first).otherwise(rank)
        some = some.withColumn(shard, F.floor(rank * shards / total).cast("int")).drop(count)
        placed = placed.filter(~is_tied).unionByName(some)
    dealt(placed, shard, at, own_key, checksum).sortWithinPartitions(shard, at, own_key, checksum).drop(at, checksum).write.option("compression", "zstd").partitionBy(shard).parquet(path)
    return shard


def read_slots(documents: DataFrame, path: str, shard: str) -> tuple[DataFrame, str]:
    """(the rows of `write_shards`, whose input was `documents`, with their shard and their place in it from 0; that column's name)."""
    spark = documents.sparkSession
    slot, file, row, base = (_free(n, [*documents.columns, shard]) for n in ("slot", "file", "row", "base"))
    if documents.isEmpty():
        return documents.withColumn(shard, F.lit(0)).withColumn(slot, F.lit(0).cast("long")).limit(0), slot
    schema = T.StructType([*documents.schema.fields, T.StructField(shard, T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    files = sorted((r[shard], r[file], r["n"]) for r in rows.groupBy(shard, file).agg(F.count("*").alias("n")).collect())
    bases, last, done = [], None, 0
    for s, name, n in files:
        done = 0 if s != last else done
        bases.append((s, name, done))
        last, done = s, done + n
    # One row for each file written.
    known = spark.createDataFrame(bases, f"`{shard}` int, `{file}` string, `{base}` long")
    return rows.join(F.broadcast(known), [shard, file]).withColumn(slot, F.col(base) + F.col(row)).drop(file, row, base), slot


def document_dimensions() -> dict[str, Column]:
    """Language, source, size and id of a document."""
    return {
        "lang": F.col("lang"),
        "source": F.col("source"),
        "size": F.octet_length(F.coalesce("text", F.lit(""))),
        "doc_id": F.col("doc_id"),
    }


def digests(documents: DataFrame) -> DataFrame:
    """The contract's row for each document, from the files. These are the query's product; they stay in a new folder
    under the shared one, which its owner empties."""
    documents = documents.select("doc_id", "text", "lang", "source")
    path = new_path(documents.sparkSession, "shards")
    shard = write_shards(documents, path, document_dimensions())
    whole = F.coalesce("text", F.lit("")).cast("binary")
    rows, slot = read_slots(documents, path, shard)
    return rows.select(
        "doc_id",
        (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
