"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' subwords (character n-grams with word ends, hashed into a
fixed table); a linear layer and softmax give the languages. Embeddings and layer are trained by stochastic gradient
descent in numpy on a bounded sample (SAMPLE rows) of labelled documents outside the held-out fold; a temperature and
two rejection thresholds are then fitted on a part of that sample that training did not see. As the network is linear
up to the softmax, a word's share of each language's score is one small vector, made in bulk for the distinct words of a
batch.

A text is rejected if the margin of its language (log-odds against all others) or the familiarity of its subwords
(average log share among the training texts' subwords, by the same buckets) is below what calibration texts have. The
softmax alone does not do: it is just as sure of many texts in a language that it never saw. Either threshold is the
MAY_REJECT quantile of the calibration texts, less SLACK times its distance from their median, as they are few.

Cases: null texts and texts without a letter are `und` with score 0; texts are scored whole, of any length; rows are
independent (ties and repeated rows need no rule); an empty table gives an empty result; without a labelled row
everything is `und`; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bound_batches
from strandline.llm.labelled import held_out, least
from strandline.llm.words import Words, gathered, splitmix, text_slices

SAMPLE = 4000
BUCKETS = 1 << 16
WIDTH = 16
UND = "und"
#: Share of correctly predicted calibration texts that may be below a rejection threshold, and its slack.
MAY_REJECT, SLACK = 0.002, 0.25

#: Words whose subwords are made at a time.
CHUNK = 50_000


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, number of the word of each), some words at a time: for each run of letters in a lower-cased word its
    pieces of 2 to 4 characters, where what stands before and after the run counts as one mark (no piece has both), and
    the run itself."""
    for first in range(0, len(words), CHUNK):
        points = np.frombuffer(("\n" + "\n".join(words[first : first + CHUNK]).lower() + "\n").encode("utf-32-le"), np.uint32)
        owner = np.cumsum(points == 10) - 1 + first
        letter = _letters()[points]
        mixed = splitmix(np.where(letter, points, 0).astype(np.uint64) + np.uint64(1))
        out, whose = [], []
        for n in (2, 3, 4):
            stop = len(points) - n + 1
            inner = np.ones(stop, bool) if n == 2 else np.logical_and.reduce([letter[k : k + stop] for k in range(1, n - 1)])
            at = np.flatnonzero(inner & (letter[:stop] | letter[n - 1 : n - 1 + stop]))
            hashed = np.full(len(at), n, np.uint64)
            for k in range(n):
                hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + mixed[at + k]
            out.append(splitmix(hashed))
            whose.append(owner[at])
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        if len(starts):
            ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
            place = np.arange(len(points)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(points)]))))
            each = np.where(letter, splitmix(mixed + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.uint64(0))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
            out.append(splitmix(sums[ends] - sums[starts]))
            whose.append(owner[starts])
        yield (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(whose)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x (languages, familiarity): each subword's share, embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    least_margin: float = -np.inf
    least_familiar: float = -np.inf

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(scores before the softmax and, last, familiarity; number of subwords) of each text."""
        words, k = Words(texts), self.scores.shape[1]
        each = np.zeros((len(words.words), k + 1))
        for ids, owner in subwords(words.distinct()):
            low, high = int(owner.min(initial=0)), int(owner.max(initial=-1)) + 1
            for j in range(k):
                each[low:high, j] += np.bincount(owner - low, weights=self.scores[ids, j], minlength=high - low)
            each[low:high, k] += np.bincount(owner - low, minlength=high - low)
        sums = np.stack([words.sums(each[:, j]) for j in range(k + 1)], 1)
        n = sums[:, k]
        return sums[:, :k] / np.maximum(n, 1)[:, None] + np.append(self.bias, 0), n

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, probability, whether it is rejected) of each text without nulls."""
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, n = self.logits(texts)
        p = softmax(logits[:, :-1] / self.temperature)
        best = p.argmax(1)
        rejected = (n == 0) | (margins(logits[:, :-1] / self.temperature) < self.least_margin) | (logits[:, -1] < self.least_familiar)
        return [self.languages[b] if m else UND for b, m in zip(best, n, strict=True)], np.where(n > 0, p[np.arange(len(p)), best], 0.0), rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def margins(x: np.ndarray) -> np.ndarray:
    """The log-odds of the likeliest column of each row against all others."""
    if x.shape[1] < 2:
        return np.full(len(x), np.inf)
    ordered = np.sort(x, 1)
    top = ordered[:, -2:-1]
    return ordered[:, -1] - top[:, 0] - np.log(np.exp(ordered[:, :-1] - top).sum(1))


def _threshold(values: np.ndarray) -> float:
    if not len(values) or not np.isfinite(values).all():
        return -np.inf
    low = np.sort(values)[int(MAY_REJECT * len(values))]
    return float(low - SLACK * (np.median(values) - low))


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 6.0, seed: int = 7) -> Model:
    """rows: (subword ids, shares that sum to 1, language). Every tenth row only calibrates."""
    languages = sorted({y for _, _, y in rows})
    if not languages:
        return Model([], np.zeros((1, 1)), np.zeros(0))
    target = {y: k for k, y in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    train = [r for k, r in enumerate(rows) if k % 10] or rows
    held = [r for k, r in enumerate(rows) if k % 10 == 0 and len(r[0])]
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            ids, shares, y = train[k]
            lr, step = rate * (1 - step / steps), step + 1
            if not len(ids):
                continue
            hidden = shares @ embeddings[ids]
            gap = softmax((hidden @ layer + bias)[None])[0]
            gap[target[y]] -= 1
            back = layer @ gap
            layer -= 0.1 * lr * np.outer(hidden, gap)
            bias -= 0.01 * lr * gap
            embeddings[ids] -= lr * shares[:, None] * back
    mass = np.zeros(BUCKETS)
    for ids, shares, _ in train:
        mass[ids] += shares
    # Buckets that training texts lack have a twentieth of an even share.
    even = 0.05 * max(mass.sum(), 1e-9) / BUCKETS
    scores = np.column_stack((embeddings @ layer, np.log((mass + even) / (mass.sum() + even * BUCKETS)))).astype(np.float32)
    model = Model(languages, scores, bias)
    if held:
        every = np.array([shares @ model.scores[ids] for ids, shares, _ in held])
        logits = every[:, :-1] + bias
        truth = np.array([target[y] for _, _, y in held])
        at = np.arange(len(held))
        loss = {t: -np.log(np.maximum(softmax(logits / t)[at, truth], 1e-12)).mean() for t in np.geomspace(0.2, 5, 25)}
        model.temperature = float(min(loss, key=loss.get))
        right = logits.argmax(1) == truth
        model.least_margin = _threshold(margins(logits[right] / model.temperature))
        model.least_familiar = _threshold(every[right, -1])
    return model


def train(documents: DataFrame, rows: int = SAMPLE) -> Model:
    """Fits on the labelled documents (text, lang) outside the held-out fold, at most `rows` of them."""
    bound_batches(documents.sparkSession)
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    keys = least(documents.filter(usable).select("doc_id"), rows).distinct()
    picked = documents.filter(usable).select("doc_id", "text", "lang").join(F.broadcast(keys), "doc_id")

    def features(batches):
        for batch in batches:
            ids, shares = [], []
            for _, texts in text_slices(batch.column("text")):
                words = Words(texts)
                names, parts = words.distinct(), [(np.empty(0, np.int32), np.empty(0, np.int64))]
                flat, owner = (np.concatenate(x) for x in zip(*parts, *subwords(names), strict=True))
                flat = flat[np.argsort(owner, kind="stable")]
                lengths = np.bincount(owner, minlength=len(names))
                at = np.cumsum(lengths) - lengths
                for i in range(len(texts)):
                    found, n = np.unique(gathered(flat, at, lengths, words.codes[words.starts[i] : words.starts[i + 1]]), return_counts=True)
                    ids.append(found)
                    shares.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["doc_id", "lang", "ids", "shares"])

    table = picked.mapInArrow(features, "doc_id long, lang string, ids array<int>, shares array<float>").toArrow()
    keyed = [(d, y, i.values.to_numpy(), s.values.to_numpy()) for d, y, i, s in zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), table["ids"], table["shares"], strict=True)]
    keyed.sort(key=lambda r: (r[0], r[1], len(r[2])))
    return fit([(i, s, y) for _, y, i, s in keyed])


def predicted(text: Column, model: Model) -> Column:
    """struct(lang, score, rejected) of a text column; rejected: below a calibrated threshold, or no letter."""

    @F.arrow_udf("lang string, score double, rejected boolean")
    def language(texts: pa.Array) -> pa.Array:
        languages, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
        for _, part in text_slices(texts):
            found, p, out = model.predict(part)
            languages += found
            scores.append(p)
            rejected.append(out)
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], ["lang", "score", "rejected"])

    return language(text)


def predictions(documents: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The contract's row for each document, and whether the calibrated thresholds reject it."""
    model = train(documents, rows)
    seen = documents.select("doc_id", "text").select("doc_id", held_out().alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return seen.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def kept(documents: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The documents, all columns, whose language the model does not reject."""
    model = train(documents, rows)
    return documents.filter(~predicted(F.col("text"), model)["rejected"])
