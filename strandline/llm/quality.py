"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(score - threshold k) with one score for all grades: hashed-text weights (words, word shapes
and endings, averaged over the text; words that the text has at all, most of whose weights L1 sets to zero) plus weights
of a few text-wide buckets, and thresholds in rising order. The averages tell bad text from good, whose toxic part is a
few words only: those move the score by being there, which sets the middle grade apart. The weights come from a bounded
sample (SAMPLE labelled rows) by full-batch gradient steps in numpy. Each document gets its expected grade and the tail
probability P(grade >= least) by which it is selected.

Cases: a null text is an empty one, which has only the empty text's bucket; texts are scored whole; rows are
independent; an empty table gives an empty result; without a rated row (or with one grade alone) nothing can be told
apart: the tail probability is that grade's share (1 without any) and nothing is rejected; rows with a null rating
are not learned from; a doc_id with several labels has the worst grade of them, one with several texts the least text;
other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WordCache, bound_batches, held
from strandline.llm.labelled import sample
from strandline.llm.words import Words, text_slices

SAMPLE = 8000
BUCKETS = 1 << 18
#: A document is rejected where its tail probability is below this.
REJECT = 0.5

_kinds = re.compile(r"([^\W\d_]+)|(\d+)|(\s+)|(.)", re.S)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def shape(word: str) -> str:
    """Runs of lower-case, capital, capitalised or mixed letters as a, A, C or M, digits as 0, signs as they are, each run once."""
    out = []
    for letters, digits, _, sign in _kinds.findall(word):
        if letters:
            out.append("a" if letters.islower() else "A" if letters.isupper() and len(letters) > 1 else "C" if letters.istitle() else "M")
        elif digits:
            out.append("0")
        elif not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


def word_features(word: str) -> list[int]:
    """Three buckets that are averaged over a text, and one, from BUCKETS on, that counts once in it."""
    core = word.strip(".,;:!?\"'()").lower()
    own = _bucket(f"w {core}")
    return [own, _bucket(f"s {shape(word)}"), _bucket(f"e {core[-3:]}"), BUCKETS + own]


def held_once(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, number of the word) of each distinct word of each text."""
    n = max(1, len(words.words))
    pairs = np.unique(words.docs.astype(np.int64) * n + words.codes)
    return pairs // n, pairs % n


def text_features(words: Words, once: np.ndarray) -> np.ndarray:
    """Buckets of each text as a whole: how many words, how often they repeat, how long they are. once: the text of each
    distinct word."""
    n = words.counts
    distinct = np.bincount(once, minlength=len(n))
    size = np.minimum(np.log2(np.maximum(n, 1)).astype(int), 16)
    fresh = (10 * distinct / np.maximum(n, 1)).astype(int)
    chars = np.array([len(w) for w in words.distinct()], np.float64)
    long_ = np.minimum(words.sums(chars) / np.maximum(n, 1), 30).astype(int) if len(chars) else np.zeros(len(n), int)
    one = {k: _bucket(f"empty {k}") for k in (0, 1)}
    return np.array(
        [[one[int(m > 0)], _bucket(f"fresh {a} {b}"), _bucket(f"fresh {b}"), _bucket(f"long {c}")] for m, a, b, c in zip(n, size, fresh, long_, strict=True)], np.int64
    ).reshape(-1, 4)


@dataclass
class Model:
    name: str
    weights: np.ndarray  # of averaged buckets, then of those that count once
    thresholds: np.ndarray  # rising; grade > k has the k-th
    grades: list[int]

    def word(self, word: str) -> complex:
        """What a word adds: to the average, and by being there."""
        *average, once = word_features(word)
        return complex(self.weights[average].sum(), self.weights[once])

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        cache = held(self.name, lambda: WordCache(self.word))
        names = words.distinct()
        each = np.fromiter((cache[w] for w in names), np.complex128, len(names))
        docs, which = held_once(words)
        mean = words.sums(each.real) / np.maximum(words.counts, 1) if len(each) else np.zeros(len(texts))
        # Words that differ in capitals and signs only share a bucket; it counts once.
        some = each.imag[which] != 0
        buckets = {k: word_features(names[k])[-1] for k in np.unique(which[some]).tolist()}
        pairs = np.unique(np.array([(d, buckets[k]) for d, k in zip(docs[some].tolist(), which[some].tolist(), strict=True)], np.int64).reshape(-1, 2), axis=0)
        there = np.bincount(pairs[:, 0], weights=self.weights[pairs[:, 1]], minlength=len(texts))
        return mean + there + self.weights[text_features(words, docs)].sum(1)

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - self.scores(texts)[:, None], -500, 500)))


def fit(columns: np.ndarray, rows: np.ndarray, values: np.ndarray, grades: np.ndarray, steps: int = 200, rate: float = 0.15, decay: float = 1e-4, l1: float = 0.004, rare: int = 8) -> Model:
    """columns, rows, values: the sparse features of text `rows`; grades: the rating of each text. Adam on the mean
    log-likelihood; weights of words that count once move at a third of the rate, under L1, and are 0 where fewer than
    `rare` texts have the word."""
    known = sorted(set(grades.tolist()))
    name = f"quality-{len(grades)}-{zlib.crc32(columns.tobytes())}-{zlib.crc32(grades.tobytes())}"
    weights = np.zeros(2 * BUCKETS)
    if len(known) < 2:
        return Model(name, weights, np.zeros(0), known)
    y = np.searchsorted(known, grades)
    above = np.array([np.clip((y > k).mean(), 1e-3, 1 - 1e-3) for k in range(len(known) - 1)])
    thresholds = np.maximum.accumulate(-np.log(above / (1 - above)))
    # Thresholds are the first and positive steps, so that they stay in order.
    first, gaps = thresholds[0], np.log(np.maximum(np.diff(thresholds), 1e-2))
    some = (columns < BUCKETS) | (np.bincount(columns, minlength=2 * BUCKETS)[columns] >= rare)
    columns, rows, values = columns[some], rows[some].astype(np.int32), values[some].astype(np.float32)
    used, n = np.unique(columns), len(y)
    at, w = np.searchsorted(used, columns).astype(np.int32), np.zeros(len(used))
    # The features twice, by text and by column, so that both products are sums over runs; a text or column has some.
    by_row = np.argsort(rows, kind="stable").astype(np.int32) if (np.diff(rows) < 0).any() else slice(None)
    by_column = np.argsort(at, kind="stable").astype(np.int32)
    text_at, text_values, texts = at[by_row], values[by_row], np.unique(rows)
    text_starts = np.searchsorted(rows[by_row], texts)
    column_rows, column_values, column_starts = rows[by_column], values[by_column], np.searchsorted(at[by_column], np.arange(len(used)))
    del columns, rows, values, at, some, by_row, by_column
    once = used >= BUCKETS
    rates = np.where(once, rate / 3, rate)
    state = [[np.zeros_like(np.atleast_1d(x)), np.zeros_like(np.atleast_1d(x))] for x in (w, first, gaps)]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, steps + 1):
        thresholds = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        s = np.zeros(n)
        s[texts] = np.add.reduceat(text_values * w.astype(np.float32)[text_at], text_starts)
        cut = np.concatenate(([-np.inf], thresholds, [np.inf]))
        hi, lo = sig(cut[y + 1] - s), sig(cut[y] - s)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (d_hi - d_lo) / n
        g_t = np.array([(d_lo[y == k + 1].sum() - d_hi[y == k].sum()) / n for k in range(len(thresholds))])
        g_gaps = np.array([g_t[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps)
        g_w = np.add.reduceat(column_values * g_s.astype(np.float32)[column_rows], column_starts) + decay * w
        g_w = np.where(once, np.where(w != 0, g_w + l1 * np.sign(w), np.sign(g_w) * np.maximum(np.abs(g_w) - l1, 0)), g_w)
        grads = (g_w, np.array([g_t.sum()]), g_gaps)
        moves = []
        for (m, v), g in zip(state, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            moves.append((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        moved = w - rates * moves[0]
        w = np.where(once & (w * moved < 0), 0, moved)  # L1 stops a weight at 0
        first, gaps = first - rate * moves[1][0], gaps - rate * moves[2]
    weights[used] = w
    return Model(name, weights, first + np.concatenate(([0], np.cumsum(np.exp(gaps)))), known)


def grade(quality: Column, toxic: Column) -> Column:
    """How fit for training a document was rated: 0 where its quality is low, 1 where it is good but for toxic words, 2 where it is good."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fits on at most `rows` rated documents outside the held-out fold, drawn by hash alone so that shares of grades stay."""
    bound_batches(documents.sparkSession)
    rated = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))

    def features(batches):
        for batch in batches:
            grades = batch.column("grade").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for first, texts in text_slices(batch.column("text")):
                words = Words(texts)
                each = np.array([word_features(w) for w in words.distinct()], np.int64).reshape(-1, 4)
                wide = text_features(words, held_once(words)[0])
                out = []
                for i in range(len(texts)):
                    own = each[words.codes[words.starts[i] : words.starts[i + 1]]]
                    cols, count = np.unique(own[:, :3], return_counts=True)
                    whole = np.concatenate((np.unique(own[:, 3]), wide[i]))
                    out.append((np.concatenate((cols, whole)).astype(np.int32), np.concatenate((count / max(1, len(own)), np.ones(len(whole)))).astype(np.float32)))
                to = first + len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:to], pa.int64()), pa.array(grades[first:to], pa.int32()), pa.array([c for c, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float32()))],
                    ["doc_id", "grade", "cols", "vals"],
                )

    table = sample(documents, rated, [(rows, F.lit(True))]).select("doc_id", "grade", "text").mapInArrow(features, "doc_id long, grade int, cols array<int>, vals array<float>").toArrow().combine_chunks().sort_by("doc_id")
    if not len(table):
        return Model("quality-none", np.zeros(2 * BUCKETS), np.zeros(0), [])
    cols, vals = table["cols"].combine_chunks(), table["vals"].combine_chunks()
    lengths = cols.value_lengths().to_numpy(zero_copy_only=False)
    return fit(cols.flatten().to_numpy(), np.repeat(np.arange(len(table), dtype=np.int32), lengths), vals.flatten().to_numpy(), table["grade"].to_numpy())


def rated(text: Column, model: Model, least: int = 1) -> Column:
    """struct(expected_grade, tail) of a text column; tail: P(grade >= least)."""

    @F.arrow_udf("expected_grade double, tail double")
    def quality(texts: pa.Array) -> pa.Array:
        expected, tail = [np.zeros(0)], [np.zeros(0)]
        for _, part in text_slices(texts):
            tails = model.tails(part)
            steps = np.diff(np.array(model.grades, float))
            expected.append((model.grades[0] if model.grades else 0.0) + tails @ steps if tails.shape[1] else np.full(len(part), float(model.grades[0] if model.grades else 0)))
            # The tail of `least` is that of the highest known grade below it.
            below = [k for k, g in enumerate(model.grades[:-1]) if model.grades[k + 1] >= least > g]
            tail.append(tails[:, below[0]] if below else np.full(len(part), 1.0 if not model.grades or model.grades[0] >= least else 0.0))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(expected)), pa.array(np.concatenate(tail))], ["expected_grade", "tail"])

    return quality(F.coalesce(text, F.lit("")))


def ratings(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """doc_id, expected_grade, tail (probability of grade 1 or more) and whether it selects the document."""
    model = train(documents, labels, rows)
    seen = documents.select("doc_id", "text").select("doc_id", rated(F.col("text"), model).alias("q"))
    return seen.select("doc_id", F.col("q.expected_grade").alias("expected_grade"), F.col("q.tail").alias("tail_probability"), (F.col("q.tail") >= reject).alias("selected"))


def kept(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """The documents, all columns, that the tail probability selects."""
    model = train(documents, labels, rows)
    return documents.filter(rated(F.col("text"), model)["tail"] >= reject)
