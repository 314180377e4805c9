"""Benchmark decontamination: a prefix-filtered set join of item-sized windows with documents.

A window is a run of WINDOW words of a benchmark item (a shorter item is one window). A document can hold a window
only if it holds the window's rarest word, so that word alone is the window's prefix: words are ordered by how often
they occur in all documents, each window is filed under its rarest word with that word's place in it, and a document
meets only the windows of prefix words that it has. The length and positional bounds (the window must fit around the
place where the word stands) drop most of these pairs, the rest are compared word by word.

The benchmark side is handled in blocks of windows of BLOCK_BYTES at most; what a block sends to the executors has
that size whatever the benchmark's. Blocks after the first read what the earlier ones found from a staged table. The
documents are never shuffled.

Cases: null texts have no words (n_words 0, not contaminated); texts of any length are scanned whole; equal items
(by id and text) count once, an id with several texts counts once where any occurs; a null item id is read as an
empty string; an empty benchmark leaves every document clean; an empty table gives an empty result; repeated rows are
separate; other columns are ignored by `hits` and kept by `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bound_batches, discard, staged
from strandline.llm.words import ALNUM_ASCII, Words, text_slices

WINDOW = 13
BLOCK_BYTES = 32 << 20

_indexes: dict[str, tuple[dict, dict]] = {}


def words_of(text: str | None) -> list[str]:
    """The words of one text: A-Z lower-cased, cut at ASCII characters that are neither letters nor digits."""
    return [w.decode() for w in (text or "").encode().translate(ALNUM_ASCII.tobytes()).split()]


def windows_of(words: list[str], window: int) -> Iterator[tuple[str, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(item id, text) lists whose windows take about `block_bytes`; items come to the driver one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += 200 + 30 * len(text)  # a word of about six characters starts a window of about 180 bytes
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def word_counts(documents: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How often each word of `vocabulary` occurs in all documents."""

    def count(batches):
        held = np.zeros(len(names), np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                words = Words(texts, ALNUM_ASCII)
                at = words.words.to_pylist()
                n = np.bincount(words.codes, minlength=len(at))
                for k, w in enumerate(at):
                    if (p := place.get(w)) is not None:
                        held[p] += n[k]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["word", "n"])

    names = sorted(vocabulary)
    place = {w: k for k, w in enumerate(names)}
    rows = documents.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = dict.fromkeys(names, 0)
    out.update((names[w], n) for w, n in zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
    return out


def prefix_index(items: list[tuple[str, str]], counts: dict[str, int], window: int) -> dict[str, list[tuple[int, tuple[str, ...], frozenset[str]]]]:
    """rarest word -> [(its place in the window, the window, the items that have it)]."""
    owners: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        for w in windows_of(words_of(text), window):
            owners.setdefault(w, set()).add(item)
    index: dict[str, list] = {}
    for w, of in owners.items():
        at = min(range(len(w)), key=lambda k: (counts.get(w[k], 0), w[k], k))
        index.setdefault(w[at], []).append((at, w, frozenset(of)))
    return index


def found(words: Words, index: dict[str, list], prefix: dict[str, int]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """text number -> (spans of words hit, items) for the texts of `words` that hold a window."""
    names = words.words.to_pylist()
    codes = np.fromiter((k for k, w in enumerate(names) if w in prefix), np.int64)
    if not len(codes):
        return {}
    wanted = np.zeros(len(names), bool)
    wanted[codes] = True
    places = np.flatnonzero(wanted[words.codes])
    docs = np.searchsorted(words.starts, places, side="right") - 1
    code_of: dict[str, int] = {w: k for k, w in enumerate(names)}
    filed = {}  # windows with all words known here, as numbers
    for c in codes.tolist():
        own = [(at, np.array([code_of[x] for x in w], words.codes.dtype), items) for at, w, items in index[names[c]] if all(x in code_of for x in w)]
        if own:
            filed[c] = own
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for place, doc in zip(places.tolist(), docs.tolist(), strict=True):
        for at, w, items in filed.get(int(words.codes[place]), ()):
            start = place - at
            if start >= words.starts[doc] and start + len(w) <= words.starts[doc + 1] and np.array_equal(words.codes[start : start + len(w)], w):
                spans, seen = out.setdefault(doc, ([], set()))
                spans.append((start - int(words.starts[doc]), start + len(w) - int(words.starts[doc])))
                seen.update(items)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _search(text: Column, index: dict[str, list], window: int, before: Column | None) -> Column:
    """struct of _FOUND for a text column; before: what earlier blocks found, to be added to."""
    spark_index, prefix = index, dict.fromkeys(index)

    @F.arrow_udf(_FOUND)
    def search(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        n_words, spans, items = [], [], []
        for first, part in text_slices(texts):
            words = Words(part, ALNUM_ASCII)
            hits = found(words, spark_index, prefix)
            n_words += words.counts.tolist()
            for i in range(len(part)):
                a, b = hits.get(i, ([], set()))
                old = earlier[first + i].as_py()
                if old:
                    a, b = a + [(s["start"], s["end"]) for s in old["spans"]], b | set(old["items"])
                spans.append([{"start": s, "end": e} for s, e in _merged(a)] if a else [])
                items.append(sorted(b))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return search(F.coalesce(text, F.lit("")), before if before is not None else F.lit(None).cast(f"struct<{_FOUND.replace(' long', ':long').replace(' array', ':array')}>"))


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, column: str = "found") -> DataFrame:
    """`documents` with a struct column: n_words, spans (merged runs of words hit, from 0) and items (ids that occur)."""
    bound_batches(documents.sparkSession)
    done = copy = None
    for block in _blocks(benchmark, window, block_bytes):
        vocabulary = {w for _, text in block for w in words_of(text)}
        index = prefix_index(block, word_counts(documents, vocabulary), window)
        if done is not None:
            # What earlier blocks found goes on from a staged copy; the copy before it has been read for the last time.
            before, copy = copy, staged(done, "decontam")
            done = copy
            discard(documents.sparkSession, before)
        source = documents if done is None else done
        done = source.withColumn(column, _search(F.col("text"), index, window, None if done is None else F.col(column)))
    return documents.withColumn(column, _search(F.col("text"), {}, window, None)) if done is None else done


def n_hit(column: str = "found") -> Column:
    return F.expr(f"aggregate({column}.spans, 0L, (n, s) -> n + s.end - s.start)")


def contaminated(column: str = "found") -> Column:
    """At least one word hit and a twentieth of all words."""
    return (n_hit(column) > 0) & (20 * n_hit(column) >= F.col(f"{column}.n_words"))


def digests(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    seen = hits(documents.select("doc_id", "text"), benchmark)
    return seen.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("found.items")).cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def kept(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    column = "_found"
    while column in documents.columns:
        column += "_"
    return hits(documents, benchmark, column=column).filter(~contaminated(column)).drop(column)


__all__ = ["contaminated", "digests", "hits", "kept"]
