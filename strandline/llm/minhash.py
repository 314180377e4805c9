"""MinHash near-duplicates: many universal hash minima with banding, signature verification, connected components.

1. Each text becomes its set of distinct word shingles (64-bit hashes), of which only its size, a 128-bit name and the
   minima of `bands * rows` universal hashes stay. Texts with one set are one class, known by that name and by its least
   doc_id; from here on only classes meet.
2. Classes that share a band (`rows` minima) are a bucket. All members are paired with the bucket's least class
   (a star, so a bucket of k gives k - 1 pairs), pairs are verified on the signatures and then on the full sets,
   and the links' components are found.
3. A link that no star holds joins different components that meet in some bucket. Every bucket whose members but for the
   least one are in several components is compared: members outside the bucket's largest component with all the others, first on the signatures, then those
   members that some signature speaks for on the full sets. A pair that shares several bands is looked at in the first
   of them only: all its buckets would compare it, or have done so as stars. A bucket is cut into blocks (BLOCK members, BLOCK_SHINGLES
   shingles at most, by hash) and each pair of blocks that may hold such a link is one small group, which gives no more
   links than it joins components. Copies of one text that the stars have joined are not compared again. A bucket of m
   members, r of them outside its largest component, so sends each member's signature to at most r / BLOCK + m / BLOCK
   groups: the work of a verified join, in groups of bounded size.

Sets are made again from the text for classes in some pair only, which takes less room than keeping all. `plan` picks
rows and bands so that a pair at the threshold shares no band with a probability of MISS at most; pairs that share one
are compared exactly, at any bucket size. `linked` leaves one table in the shared folder, its result, which the folder's
owner empties; all other tables that it writes are deleted.

Cases: null and wordless texts have an empty set and stay alone; a text of fewer words than a shingle has one shingle,
all its words; texts are read whole; a null doc_id stays alone as its own component (null) and is kept; rows with one
doc_id count as one document with the union of their links; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bound_batches, discard, staged
from strandline.llm.components import components
from strandline.llm.words import LOWER_ASCII, Words, gathered, splitmix, text_slices

MISS = 1e-6
#: Members and shingles of a block. A group of two blocks gets signatures (about a megabyte), then sets of bounded size.
BLOCK, BLOCK_SHINGLES = 1024, 400_000


def plan(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the most rows of which at most 128 minima in bands miss a pair at the threshold no more often than `miss`."""
    for rows in range(8, 1, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
        if rows * bands <= 128:
            return rows, bands
    rows = 1
    return rows, math.ceil(math.log(miss) / math.log(1 - percent / 100)) if percent < 100 else 1


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, rising, end to end; where each text's start, and the end)."""
    words = Words(texts, LOWER_ASCII)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct()), np.uint64, len(words.words))
    own = each[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    n = words.counts
    mixed = np.zeros(len(own), np.uint64)
    for k in range(width):
        # The k-th word of the shingle that starts here; beyond the text's end a mark, so that short texts differ.
        at = np.arange(len(own)) + k
        inside = at < np.repeat(words.starts[1:], n)
        mixed = splitmix(mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, own[np.minimum(at, max(0, len(own) - 1))], np.uint64(0x5851F42D4C957F2D + k)))
    last = np.repeat(words.starts[:-1] + np.maximum(n - width + 1, np.minimum(n, 1)), n)
    keep = np.arange(len(own)) < last
    mixed, docs = mixed[keep], words.docs[keep]
    order = np.lexsort((mixed, docs))
    mixed, docs = mixed[order], docs[order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (docs[1:] != docs[:-1])
    mixed, docs = mixed[new], docs[new]
    return mixed, np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=len(n)))))


def universal(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of `count` multiply-add hashes of 64 bits, of which the high 32 count."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def signatures(sets: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """texts x count minima (32 bits); rows of empty sets are all ones."""
    a, b = universal(count)
    out = np.full((len(starts) - 1, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        at = starts[full]
        for k in range(count):
            out[full, k] = np.minimum.reduceat(((sets * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def set_names(sets: np.ndarray, starts: np.ndarray) -> list[bytes]:
    data = memoryview(sets).cast("B") if len(sets) else b""
    return [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _sketches(documents: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n (set size), name (of the set), minima (binary) and bands (hashes) of each row."""

    def sketch(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in text_slices(batch.column("text")):
                sets, starts = shingle_sets(texts, width)
                minima = signatures(sets, starts, rows * bands)
                keyed = np.zeros((len(texts), bands), np.uint64)
                for r in range(rows):
                    keyed = splitmix(keyed * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::rows].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(texts)),
                        pa.array(np.diff(starts)),
                        pa.array(set_names(sets, starts), pa.binary()),
                        pa.array([m.tobytes() for m in minima], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(keyed.ravel().view(np.int64))),
                    ],
                    ["doc_id", "n", "name", "minima", "bands"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n long, name binary, minima binary, bands array<long>")


def _sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """name and set (array of its shingles) of the classes in `wanted` (name, doc_id of one of its rows)."""

    def make(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                sets, starts = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(set_names(sets, starts), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64))),
                    ],
                    ["doc_id", "name", "set"],
                )

    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    # Rows that share a doc_id may have other sets; only the wanted ones count, each once.
    made = some.mapInArrow(make, "doc_id long, name binary, set array<long>")
    return made.join(wanted.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_semi").dropDuplicates(["name"]).select("name", "set")


def _least_equal(count: int, percent: int) -> int:
    """How many of `count` minima are equal at least: at the threshold their share is within 5.5 deviations of it."""
    t = percent / 100
    return max(0, math.floor(count * t - 5.5 * math.sqrt(count * t * (1 - t))))


def _agree(count: int, percent: int) -> Column:
    """Whether two signatures agree often enough."""
    least = _least_equal(count, percent)

    @F.arrow_udf("boolean")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(v.as_py() for v in col), np.uint32).reshape(len(col), count) for col in (a, b))
        return pa.array((x == y).sum(1) >= least)

    return agree(F.col("minima_a"), F.col("minima_b"))


def _likely_rows(rows: int, bands: int, percent: int):
    """The rows of a meet whose signature agrees with one that it is to be compared with, of another component, and
    shares no earlier band with it."""
    count = rows * bands
    least = _least_equal(count, percent)

    def likely(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        minima = np.frombuffer(b"".join(table["minima"].to_pylist()), np.uint32).reshape(len(table), count)
        n, seed = table["n"].to_numpy(), table["seed"].to_numpy(zero_copy_only=False)
        component, inner, band = table["component"].to_numpy(), table["inner"][0].as_py(), table["band"][0].as_py()
        others = np.arange(len(table)) if inner else np.flatnonzero(~seed)
        found = np.zeros(len(table), bool)
        for s in np.flatnonzero(seed):
            sized = 100 * np.minimum(n[others], n[s]) >= percent * np.maximum(n[others], n[s])
            near = others[sized & (component[others] != component[s])]
            same = minima[near] == minima[s]
            first = same.reshape(-1, bands, rows).all(2).argmax(1)
            near = near[(same.sum(1) >= least) & (first == band)]
            if len(near):
                found[near] = found[s] = True
        return table.drop_columns(["minima", "n", "band"]).filter(pa.array(found))

    return likely


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, width: int, percent: int, count: int, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, as (u, v), staged."""
    spark = pairs.sparkSession
    side = lambda k: classes.select(F.col("doc_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "name", "minima")])
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = staged(sized.filter(_agree(count, percent)).select("a", "b", "n_a", "n_b", "name_a", "name_b"), f"{name}-pairs")
    wanted = likely.select(F.explode(F.array(*[F.struct(F.col(k).alias("doc_id"), F.col(f"name_{k}").alias("name")) for k in "ab"])).alias("w")).select("w.*").distinct()
    sets = staged(_sets(documents, wanted, width), f"{name}-sets")
    of = lambda k: sets.select(F.col("name").alias(f"name_{k}"), F.col("set").alias(f"set_{k}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    links = likely.join(of("a"), "name_a").join(of("b"), "name_b").filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
    out = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-links")
    discard(spark, likely, sets)
    return out


def _meets(members: DataFrame) -> DataFrame:
    """(meet, band, inner, seed, doc_id, name, n, component) from members (bucket, band, doc_id, name, component, n) of buckets: `meet`
    names a pair of blocks, `seed` rows are to be compared with the others, and where `inner` is set with each other too."""
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    buckets = parts.groupBy("bucket").agg(
        F.max(F.struct("members", "component", "shingles")).alias("core"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts")
    )
    blocks = lambda m, n: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    sized = buckets.filter("parts > 1").select(
        "bucket", F.col("core.component").alias("core"), blocks(F.col("core.members"), F.col("core.shingles")).alias("p"), blocks(F.col("members") - F.col("core.members"), F.col("shingles") - F.col("core.shingles")).alias("q")
    )
    here = members.join(sized, "bucket").withColumn("in_core", F.col("component") == F.col("core"))
    here = here.withColumn("block", F.pmod(F.xxhash64("name", "bucket"), F.when(F.col("in_core"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("block").alias("i"), j.alias("j"), F.lit(False).alias("seed")))
    with_core = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("seed")))
    among = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("q") - 1), lambda j: j != F.col("block")),
        lambda j: F.struct(F.lit(1).alias("kind"), F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"), (j < F.col("block")).alias("seed")),
    )
    sent = here.withColumn("m", F.explode(F.when(F.col("in_core"), with_rest).otherwise(F.concat(with_core, among))))
    inner = (F.col("m.kind") == 0) & (F.col("m.i") == 0)
    return sent.select(F.xxhash64("bucket", "m.kind", "m.i", "m.j").alias("meet"), "band", inner.alias("inner"), F.col("m.seed").alias("seed"), "doc_id", "name", "n", "component")


def _joining_links(percent: int):
    """What a meet gives: links (u, v) between its rows' sets that join different components, one for each joining."""

    def compare(table: pa.Table) -> pa.Table:
        docs, seed = table["doc_id"].to_numpy(), table["seed"].to_numpy(zero_copy_only=False)
        root, inner = table["component"].to_numpy().copy(), table["inner"][0].as_py()
        sets = table["set"].combine_chunks()
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, shingle = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(n)))
        owner = np.repeat(np.arange(len(docs)), n)
        if not inner:  # only the other side is looked up
            keep = ~seed[owner]
            owner, posted = owner[keep], shingle[keep]
        else:
            posted = shingle
        order = np.argsort(posted, kind="stable")
        owner, counts = owner[order], np.bincount(posted, minlength=int(shingle.max(initial=-1)) + 1)
        at = np.cumsum(counts) - counts
        out = []
        for s in np.flatnonzero(seed):
            both = np.bincount(gathered(owner, at, counts, shingle[starts[s] : starts[s + 1]]), minlength=len(docs))
            close = np.flatnonzero((100 * both >= percent * (n[s] + n - both)) & (root != root[s]))
            for c in np.unique(root[close], return_index=True)[1]:
                t = close[c]
                out.append((docs[s], docs[t]))
            root[np.isin(root, root[close])] = root[s]
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return compare


def linked(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n, component) of each row, staged."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows, bands = plan(percent)
    sketched = staged(_sketches(documents, width, rows, bands), "minhash-sketches")
    # The least doc_id of each set, found with sums that tasks make before the shuffle.
    # Staged, so that the joins on a set with very many copies have two plain exchanges and can be split.
    names = staged(sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("doc_id")), "minhash-names")
    # One set has one least doc_id, so both name it; the join has dealt the rows by both.
    classes = staged(sketched.join(names, ["name", "doc_id"]).dropDuplicates(["name", "doc_id"]).select("doc_id", "name", "n", "minima", "bands"), "minhash-classes")
    thin = staged(sketched.select("doc_id", "n", "name"), "minhash-thin")
    discard(spark, sketched)
    banded = classes.select("doc_id", "name", "n", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "band", "doc_id", "name", "n")
    stars = banded.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("members")).filter("members > 1")
    filed = staged(banded.join(stars.select("bucket", "a"), "bucket"), "minhash-filed")
    pairs = staged(filed.filter("a != doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "minhash-stars")
    links = _verified(pairs, classes, documents, width, percent, rows * bands, "minhash-star")
    found = components(links, "minhash-found")

    # What the stars leave: buckets that hold several components. Every pair with a bucket's least class is done.
    mine = filed.filter("a != doc_id").drop("a").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mine = staged(mine, "minhash-members")
    signed = _meets(mine).join(classes.select("name", "minima"), "name")
    schema = "name binary, meet long, inner boolean, seed boolean, doc_id long, component long"
    meets = staged(signed.groupBy("meet").applyInArrow(_likely_rows(rows, bands, percent), schema), "minhash-meets")
    sets = _sets(documents, meets.select("doc_id", "name").distinct(), width)
    more = staged(meets.join(sets, "name").groupBy("meet").applyInArrow(_joining_links(percent), "u long, v long"), "minhash-more")

    # Rows with one doc_id are one document: what their sets are linked with is linked.
    own = thin.filter("doc_id IS NOT NULL").join(names.select("name", F.col("doc_id").alias("least")), "name", "left")
    own = staged(own.select("doc_id", "n", F.coalesce("least", "doc_id").alias("least")), "minhash-rows")
    bonds = own.filter("doc_id != least").select("doc_id", "least")
    repeated = thin.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    bonds = bonds.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    found_all = components(links.unionByName(more).unionByName(bonds), "minhash-found")
    known = own.join(found_all.withColumnRenamed("node", "least"), "least", "left").select("doc_id", "n", F.coalesce("component", "least").alias("component"))
    nameless = thin.filter("doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("component"))
    result = staged(known.unionByName(nameless), "minhash-result")
    discard(spark, thin, names, classes, filed, pairs, links, found, mine, meets, more, own, found_all)
    return result


def clusters(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept for each row of documents (doc_id, text)."""
    result = linked(documents.select("doc_id", "text"), width, percent)
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def kept(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that are the least of their component (rows of one doc_id stay together, a null one stays)."""
    gone = "_gone"
    while gone in documents.columns:
        gone += "_"
    out = clusters(documents, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(out, documents["doc_id"].cast("long") == out[gone], "left_anti")
