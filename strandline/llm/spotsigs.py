"""SpotSigs fingerprints with DataFrame functions only.

A spot signature is a common-word anchor with the chain of CHAIN content words that follow it (common words between
them are skipped); the set of a text's signatures is its fingerprint. Anchors are marked in the text by one regular
expression that glues each to the next content word, so signatures are neighbours in one split of the text. A text
with words but without a whole chain has its word sequence as its one signature, so texts that differ stay apart.

`pairs` joins documents on their signatures: set sizes are cut into ranges as wide as the threshold allows, a pair
can only match within one range or between neighbours, and a document is filed under only as many of its rarest
signatures as a match must share (prefix bound); candidates are compared by exact Jaccard.

Cases: null texts are empty and have an empty set (fingerprint of nothing, likeness 1 to another empty set); long
texts are handled whole; rows with equal keys keep their order by text; a null id sorts last; an empty table gives an
empty result; a lone document is its own next one; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import partitions, staged

CHAIN = 2
#: Common words of English, French, German and Spanish prose.
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au dans de des du en est et la le les pas pour que qui sur un une "
    "auf das dem den der die ein eine für im ist mit nicht und von zu "
    "con del el las los para por se su una y"
).split()

_MARK = "\x01"

#: So many sets filed under one (signature, size range) are a crowd, compared in blocks of BLOCK by all.
CROWD, BLOCK = 64, 1024


def _bound(value: Column, body) -> Column:
    """body(value) with `value` worked out once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any_of(words: set[str]) -> str:
    """A regular expression of `words` that branches letter by letter, so most other words fail at their first or second."""
    after: dict[str, set[str]] = {}
    for w in words - {""}:
        after.setdefault(w[0], set()).add(w[1:])
    body = "|".join(c + _any_of(rest) for c, rest in sorted(after.items()))
    return f"(?:{body})" + "?" * ("" in words) if body else ""


def signatures(text: Column, chain: int = CHAIN, common: list[str] = COMMON) -> Column:
    """The sorted distinct signature hashes (array of long) of a text column."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # Each common word is glued to what follows it; a run of them becomes marks before one content word.
    glued = F.regexp_replace(words, f"(?<= )({_any_of(set(common))}) ", f"$1{_MARK}")
    tokens = F.split(F.trim(glued), " ")

    def spots(ts: Column) -> Column:
        def spot(t: Column, i: Column) -> Column:
            follow = [F.substring_index(F.get(ts, i + k), _MARK, -1) for k in range(1, chain)]
            whole = F.contains(t, F.lit(_MARK)) & ~F.endswith(t, F.lit(_MARK))
            for f in follow:
                whole = whole & (f != "")
            return F.when(whole, F.xxhash64(t, *follow))

        found = F.sort_array(F.array_distinct(F.filter(F.transform(ts, spot), F.isnotnull)))
        alone = F.when(F.get(ts, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(ts, " "))))
        return _bound(found, lambda s: F.when(F.size(s) > 0, s).otherwise(alone))

    return _bound(tokens, spots)


def fingerprint(sigs: Column) -> Column:
    """A short name of a signature set: its size and the SHA-256 of its sorted hashes."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.sha2(F.array_join(sigs.cast("array<string>"), ",").cast("binary"), 256))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard coefficient of two signature sets; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _at_most(cuts: list[int], value: Column) -> Column:
    """How many of the rising `cuts` are not above `value`, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[step - 1 :: step]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    whole = F.size(F.filter(lits(coarse), lambda c: c <= value)) * step
    return _bound(whole, lambda k: k + F.size(F.filter(F.slice(lits(cuts), k + 1, F.lit(step)), lambda c: c <= value)))


def with_next(documents: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """`documents` (doc_id, text) with `next_text`, that of the next row in descending doc_id (after the last: the first).

    Rows are dealt to ranges of doc_id; the first row of each range is also sent, as a guest, to the range above, and
    the very first to the lowest, so that a window over one range sees every next row and texts move once. Guests
    (column `guest` = 1) are still in the result, for further windows over the one that is returned."""
    spark = documents.sparkSession
    n = buckets or 4 * partitions(spark)
    key = F.col("doc_id").cast("long")
    row = documents.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n).alias("cuts")).first()
    bucket = F.when(key.isNull(), -1).otherwise(_at_most(sorted(set(row["cuts"] or [])), key))
    placed = documents.select("doc_id", "text", bucket.cast("int").alias("own"))
    heads = sorted(placed.groupBy("own").agg(F.max("doc_id").alias("head")).collect(), reverse=True)
    # One row for each range: its first id, and the range above that also needs it.
    guests = [(r["own"], r["head"], heads[i - 1]["own"]) for i, r in enumerate(heads)]
    known = F.broadcast(spark.createDataFrame(guests, "own int, head long, above int"))
    at = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array("own", "above")).otherwise(F.array("own"))
    dealt = placed.join(known, "own").select("doc_id", "text", F.posexplode(at).alias("guest", "bucket"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return dealt.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("next_text", F.lead("text").over(order)), order


def digests(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    following, order = with_next(documents.select("doc_id", "text"))
    signed = following.withColumn("sigs", signatures(F.col("text"))).withColumn("next_sigs", F.lead("sigs").over(order)).filter("guest = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = signed.select("*", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sigs", "next_sigs", signatures(F.col("edited")).alias("edited_sigs"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, sigs, row of each row, staged: its signatures are worked out once; name, set, class of each distinct
    signature set). A set is told by the least `row` that has it, a short key without clashes; its class is its least doc_id."""
    sigs = documents.select("doc_id", signatures(F.col("text")).alias("sigs"), F.monotonically_increasing_id().alias("row"))
    signed = staged(sigs.select("doc_id", "row", "sigs", F.unhex(F.substring_index(fingerprint(F.col("sigs")), ":", -1)).alias("name")), "spots")
    return signed, signed.groupBy("name").agg(F.min("row").alias("set"), F.min("doc_id").alias("class"))


def _shared(signed: DataFrame, known: DataFrame) -> DataFrame:
    """(set, class, n, order), staged: of the sets with a class, n signatures and those `order` that other sets have too,
    (spread, sig) from the rarest on. Signatures of one set alone meet nothing and move no further than their count."""
    sets = signed.join(known.filter("class IS NOT NULL").select(F.col("set").alias("row"), "class"), "row").filter(F.size("sigs") > 0)
    each = sets.select(F.col("row").alias("set"), "class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    spread = each.groupBy("sig").agg(F.count("*").alias("spread")).filter("spread > 1")
    return staged(each.join(spread, "sig").groupBy("set").agg(F.first("class").alias("class"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("spread", "sig"))).alias("order")), "shared")


def _linked(shared: DataFrame, threshold: float) -> DataFrame:
    """(set_a, a, set_b, b, likeness): pairs of different sets that reach `threshold`, each once.

    Sets meet on (signature, size range); a pair is compared at the rarest signature that both are filed under only. A
    set's own signatures are the rarest of all: they take the first places of its prefix and are not filed. Where few meet,
    each pair fetches its sets. In a crowd (more sets than a prefix is long, so that sets sent to each of their signatures are
    less than sets sent to each of their pairs) the sets are there already, and blocks of one side are dealt to tasks."""
    spare = 1e-9  # for products of the threshold that are whole numbers but for rounding
    key = ["sig", "size_range"]
    ranked = shared.select("set", "n", F.transform("order", lambda p: p["sig"]).alias("sigs")).withColumn("own", F.col("n") - F.size("sigs"))
    length = F.greatest(F.col("n") - F.ceil(F.col("n") * threshold - spare) + 1 - F.col("own"), F.lit(0)).cast("int")
    width = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    filed = ranked.select("set", "n", "own", width.alias("size_range"), F.slice("sigs", F.lit(1), length).alias("prefix"))
    filed = filed.select("set", "n", "own", "size_range", "prefix", F.posexplode("prefix").alias("k", "sig"))
    filed = staged(filed.select("set", "n", *key, (F.col("own") + F.col("k")).alias("at"), F.slice("prefix", F.lit(1), F.col("k")).alias("before")), "filed")
    longest = (1 - threshold) * F.pow(F.lit(1 / threshold), F.col("size_range") + 1)
    crowds = filed.groupBy(*key).agg(F.count("*").alias("spread")).filter(F.col("spread") >= F.greatest(F.lit(CROWD), longest))
    crowds = staged(crowds.select(*key, F.ceil(F.col("spread") / BLOCK).cast("int").alias("blocks")), "crowds")

    left = filed.select("sig", *[F.col(c).alias(f"{c}_a") for c in ("set", "n", "before", "at")], F.explode(F.array("size_range", F.col("size_range") + 1)).alias("size_range"), F.col("size_range").alias("range_a"))
    right = filed.select("sig", *[F.col(c).alias(f"{c}_b") for c in ("set", "n", "before", "at")], "size_range")
    # Within one range a pair meets twice, once either way; between ranges once.
    once = (F.col("range_a") != F.col("size_range")) | (F.col("set_a") < F.col("set_b"))
    near = (F.col("n_a") >= threshold * F.col("n_b") - spare) & (F.col("n_b") >= threshold * F.col("n_a") - spare)
    # Positions: what both can still share from here on is not enough where too little is left of either.
    left_over = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = left_over * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - spare
    # Near copies mostly share one of the first few; only where they do not are all looked through.
    early = F.lit(False)
    for i, j in product(range(3), repeat=2):
        early = early | F.coalesce(F.get("before_a", F.lit(i)) == F.get("before_b", F.lit(j)), F.lit(False))
    likely = (F.col("set_a") != F.col("set_b")) & once & near & enough & ~early & ~F.arrays_overlap("before_a", "before_b")

    of = lambda k: shared.select(F.col("set").alias(f"set_{k}"), F.col("class").alias(k), F.transform("order", lambda p: p["sig"]).alias(f"sigs_{k}"))
    like = _bound(F.size(F.array_intersect("sigs_a", "sigs_b")), lambda both: both / (F.col("n_a") + F.col("n_b") - both))
    found = ["set_a", "a", "set_b", "b", like.alias("likeness")]
    few = left.join(crowds, key, "left_anti").join(right.join(crowds, key, "left_anti"), key).filter(likely).select("set_a", "n_a", "set_b", "n_b")
    few = few.join(of("a"), "set_a").join(of("b"), "set_b").filter(like >= threshold)
    block = F.pmod(F.xxhash64("set_a"), F.col("blocks")).cast("int").alias("block")
    ours = left.join(crowds, key).select(*left.columns, block).join(of("a"), "set_a")
    theirs = right.join(crowds, key).join(of("b"), "set_b").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = ours.join(theirs, [*key, "block"]).filter(likely & (like >= threshold))
    return few.select(*found).unionByName(many.select(*found))


def pairs(documents: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): pairs a < b of classes (rows with one signature set, named by their least doc_id) whose
    Jaccard coefficient reaches `threshold`, with `likeness`; and doc_id with its class. Empty sets are in no pair; a row
    without doc_id has the class of its set, none where no row with a doc_id has that set. Where one doc_id names several
    sets, a pair of classes has the best likeness of theirs."""
    signed, known = _classes(documents)
    close = _linked(_shared(signed, known), threshold).filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("likeness").alias("likeness"))
    return close, signed.select("doc_id", "name").join(known, "name").select("doc_id", "class")


def links(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id and n_links (other sets that reach `threshold`) of each row of `documents`."""
    signed, known = _classes(documents)
    met = _linked(_shared(signed, known), threshold)
    ends = met.select(F.explode(F.array("set_a", "set_b")).alias("set")).groupBy("set").agg(F.count("*").alias("n_links"))
    counted = known.join(ends, "set", "left").select("name", F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return signed.select("doc_id", "name").join(counted, "name").select("doc_id", "class_id", "n_links")
