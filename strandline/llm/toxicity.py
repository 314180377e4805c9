"""Toxicity of deobfuscated text: a noisy channel undone by Viterbi decoding, then a sparse linear score.

A disguised token is a lattice: a sign may stand for a letter (or for nothing), a run of one letter for one or two of
it, a gap between single characters for nothing or a word's end. The path of least channel cost plus character
trigram cost is its restored text; the trigrams are counted over all documents, in a table of fixed size. Every part with a digit or a sign is
decoded, however few letters it has; one more path takes it as it is written (a number, a code), of which only the
letters are words. Paths dearer than one already known are left early, which changes no result. Signs that are punctuation too are dropped at an end at a lower cost. Tokens of letters without
runs have one path and are taken as they are. Restored words and their first characters are hashed features, present or
not, of a logistic regression with L1 (FTRL-proximal), trained on a bounded sample (TOXIC and OTHER rows) outside the
held-out fold; its intercept is set back to the shares of all training labels. Most weights are zero, so long clean
texts gather no noise.

Cases: null and empty texts get the score of a text without features; texts are read whole and of any length; rows
are independent; an empty table gives an empty result; without labels of both kinds every score is the share of
toxic labels (0.5 without any); null labels are not learned from, and a
doc_id with several is toxic if one of them says so (the least of its texts counts); other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WordCache, bound_batches, held
from strandline.llm.labelled import held_out, sample
from strandline.llm.words import Words, text_slices

TOXIC, OTHER = 4000, 8000
BUCKETS = 1 << 20
#: Symbols of the language model: a blank, a to z, the small letters of Latin-1 (U+00DF to U+00FF), any digit, any other
#: letter, any sign.
SYMBOLS, DIGIT, LETTER, SIGN = 64, 60, 61, 62
#: Code points that are told apart within a symbol; the rest count as the last.
ALPHABET = 0x180
#: Sums that one trigram table takes: its own, and one for each code point.
ENTRIES = SYMBOLS**3 + ALPHABET

# Which letters a sign or digit commonly stands for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
ANY = "*"  # one hidden letter
SIGN_COST, SPLIT_COST, DOUBLE_COST = 0.5, 2.0, 1.0
HALVE_COST = 6.0  # two of a letter that stand for one
DROP_COST, EDGE_DROP_COST = 9.0, 5.0  # a digit or a sign within that stands for nothing, a sign at an end
OPEN_DROP_COST = 3.0  # a bracket that opens and is not closed in its token; closed ones and a last "!" cost nothing
KEEP_COST = 8.0  # a part with letters taken as it is written, beyond its trigrams; without letters this costs nothing
NUMBER_COST = math.log(10)  # at most this for each character of a number

_edges = ".,;:?!\"'`)]}([{…«»“”‘’"
_plain_edges = "".join(c for c in _edges if c not in STANDS_FOR)
_parts = re.compile(r"(?:[^\W_]|[@$!|+(<€£¥*])+")
_double = re.compile(r"(.)\1")
_long_run = re.compile(r"(.)\1\1")
_letter_runs = re.compile(r"[^\W\d_]+")


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point of lower-cased text."""
    out = np.full(0x110000, SIGN, np.uint8)
    out[np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = LETTER
    out[np.fromiter((chr(c).isdigit() for c in range(0x110000)), bool, 0x110000)] = DIGIT
    out[:33] = 0
    out[97:123] = np.arange(1, 27)
    out[0xDF:0x100] = np.arange(27, 60)
    return out


class CharModel:
    """Trigrams of symbols with their bigrams mixed in, times the share of a code point in its symbol; costs are negative
    log-probabilities. The table has a fixed size whatever the texts' characters."""

    def __init__(self, counts: np.ndarray):
        """counts: ENTRIES sums, of the trigrams of symbols and then of the code points."""
        three = counts[: SYMBOLS**3].reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(2), three.sum(0)
        low = (one + 0.5) / (one.sum(1, keepdims=True) + 0.5 * 60)
        self.table = -np.log((three + 5 * low[None]) / (two[:, :, None] + 5)).astype(np.float32)
        points = counts[SYMBOLS**3 :].astype(np.float64) + 0.5
        symbol = _symbols()[:ALPHABET].astype(np.int64)
        symbol[-1] = LETTER
        self.share = -np.log(points / np.bincount(symbol, weights=points, minlength=SYMBOLS)[symbol])
        self.costs: dict[str, float] = {}

    def cost(self, three: str) -> float:
        """Of the last of three characters after the other two; a bounded number is kept."""
        known = self.costs.get(three)
        if known is None:
            if len(self.costs) > 1 << 16:
                self.costs.clear()
            symbols = _symbols()
            a, b, c = (int(symbols[ord(k)]) for k in three)
            # A symbol with one code point has a share of 1.
            own = 0.0 if c < DIGIT else self.share[min(ord(three[2]), ALPHABET - 1)]
            known = self.costs[three] = float(self.table[a, b, c] + own)
        return known

    def price(self, text: str) -> float:
        """Of a text as it is written, standing between two blanks."""
        padded = f"  {text} "
        return sum(self.cost(padded[k : k + 3]) for k in range(len(padded) - 2))

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        return self.cheapest(lattice)[0]

    def cheapest(self, lattice: list[list[tuple[str, float]]], ceiling: float = math.inf) -> tuple[str, float]:
        """The cheapest text with its cost: one option of each place, the text standing between two blanks. No cost is
        below 0, so paths beyond `ceiling` are left; where none is within, the cost is infinite."""
        best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        left = ceiling - sum(min(cost for _, cost in options) for options in lattice) if ceiling < math.inf else math.inf
        for options in [*lattice, [(" ", 0.0)]]:
            left += min(cost for _, cost in options) if left < math.inf else 0.0  # what is left but for the places to come
            following: dict[str, tuple[float, tuple | None]] = {}
            for state, (spent, path) in best.items():
                for emitted, cost in options:
                    total, last = spent + cost, state
                    for c in emitted:
                        last += c
                        total += self.cost(last)
                        last = last[1:]
                    if total <= left and (last not in following or total < following[last][0]):
                        following[last] = (total, (path, emitted) if emitted else path)
            best = following
        if not best:
            return "", math.inf
        least, path = min(best.values(), key=lambda v: v[0])
        out = []
        while path is not None:
            path, emitted = path
            out.append(emitted)
        return "".join(reversed(out)).strip(), least


def drop_cost(c: str, first: bool, last: bool, closed: bool) -> float:
    if c == "!" and first and not last:
        return DROP_COST
    if c == "!" and last or c == "(" and first and closed:
        return 0.0
    if c == "(" and first:
        return OPEN_DROP_COST
    return EDGE_DROP_COST if (first or last) and not c.isdigit() else DROP_COST


def lattice_of(part: str, gaps: bool = False, closed: bool = False) -> list[list[tuple[str, float]]]:
    """The places of a disguised part and what each may stand for; gaps: its characters stood apart; closed: a bracket
    that opens it is closed."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(part):
        j = i
        while j < len(part) and part[j] == part[i]:
            j += 1
        c, run = part[i], j - i
        drop = [("", drop_cost(c, i == 0, j == len(part), closed))]
        if c == ANY:
            # Stars at an end are dropped together.
            each = [("", drop[0][1] / run)] if i == 0 or j == len(part) else drop
            out += [[(x, SIGN_COST + 1.0) for x in "abcdefghijklmnopqrstuvwxyz"] + each] * run
        elif c in STANDS_FOR:
            options = [(x * k, SIGN_COST + (DOUBLE_COST if k == 2 else 0)) for x in STANDS_FOR[c] for k in ((1, 2) if run > 1 else (1,))]
            out.append(options + drop)
        elif run > 2:
            out.append([(c, 0.0), (c * 2, DOUBLE_COST)])
        elif run == 2 and c.isalpha():
            out.append([(c * 2, 0.0), (c, HALVE_COST)] + ([(f"{c} {c}", SPLIT_COST)] if gaps else []))
        else:
            out += [[(c, 0.0)]] * run
        if gaps and j < len(part):
            out.append([("", 0.0), (" ", SPLIT_COST)])
        i = j
    return out


@dataclass
class Scorer:
    chars: CharModel
    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0
    name: str = "toxicity"

    def restored(self, token: str) -> list[str]:
        """The words of one token between blanks, disguises undone."""
        token = token.lower()
        core = token.strip(_plain_edges)
        if core.isalpha():
            return self.plain(core)
        parts = _parts.findall(core)
        bare = [p.strip(_edges) or p for p in parts]
        if len(parts) > 1 and all(len(p) == 1 for p in bare):
            return self.spaced("".join(bare))
        return [w for p in parts for w in (self.plain(p) if p.isalpha() else self.decoded(p, closed=")" in token))]

    def plain(self, word: str) -> list[str]:
        """A word of letters: decoded if it has a long run, or a double letter that costs more than one of it."""
        if not _double.search(word):
            return [word]
        if _long_run.search(word):
            return self.chars.decode(lattice_of(word)).split()
        doubles = [m.start() + 2 for m in _double.finditer(word)]
        cost, p = self.chars.cost, f"  {word} "
        near = any(b - a < 3 for a, b in zip(doubles, doubles[1:]))
        if near or any((two := cost(p[k - 1 : k + 2]) + cost(p[k : k + 3])) > HALVE_COST and two - cost(p[k - 1 : k + 1] + p[k + 2]) > HALVE_COST for k in doubles):
            return self.chars.decode(lattice_of(word)).split()
        return [word]

    def decoded(self, part: str, gaps: bool = False, closed: bool = False) -> list[str]:
        """The words of a part with signs or digits: of its lattice, or its letters where it is cheaper as written."""
        if not any(c.isalnum() or c in STANDS_FOR and c not in _edges for c in part):
            return []
        lettered = any(c.isalpha() for c in part)
        kept = math.inf
        if not (gaps and lettered):
            kept = self.chars.price(" ".join(part) if gaps else part) + (KEEP_COST if lettered else 0.0)
            if not lettered and any(c.isdigit() for c in part):
                kept = min(kept, NUMBER_COST * len(part))
        lattice, ceiling = lattice_of(part, gaps, closed), math.inf if lettered else kept
        if ANY in part:
            _, without = self.chars.cheapest([options[-1:] if len(options) > 26 else options for options in lattice], kept)
            ceiling = min(kept, without) + 1e-6
        text, cost = self.chars.cheapest(lattice, ceiling)
        return text.split() if cost < kept else _letter_runs.findall(part)

    def spaced(self, run: str) -> list[str]:
        """The words of characters that stood apart."""
        return self.decoded(run, gaps=True)

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of each feature of each text, once."""
        words = Words(texts)
        token_cache, run_cache = held(self.name, lambda: (WordCache(lambda t: self.known(self.restored(t))), WordCache(lambda r: self.known(self.spaced(r)), limit=4 << 20)))
        names = words.distinct()
        each = [token_cache[w] for w in names]
        some = np.fromiter((bool(e) for e in each), bool, len(each))
        docs = words.docs
        found: list[tuple[int, int]] = []
        if some.any():
            used = np.flatnonzero(some[words.codes])
            pairs = np.unique(docs[used].astype(np.int64) * len(names) + words.codes[used])
            found += [(p // len(names), f) for p in pairs.tolist() for f in each[p % len(names)]]
        # Two and more single characters in a row, whatever punctuation stands at them, are one disguised run.
        alone = [lone(w) for w in names]
        single = np.fromiter((a != "" for a in alone), bool, len(names))
        if single.any():
            is_single = single[words.codes]
            change = np.flatnonzero(np.concatenate(([True], (is_single[1:] != is_single[:-1]) | (docs[1:] != docs[:-1]), [True]))) if len(docs) else np.zeros(1, int)
            for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
                if b - a > 1 and is_single[a]:
                    run = "".join(alone[c] for c in words.codes[a:b].tolist()).lower()
                    found += [(int(docs[a]), f) for f in run_cache[run]]
        both = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def known(self, words: list[str]) -> list[int]:
        own = {f for w in words for f in word_features(w)}
        return sorted(own) if self.name.startswith("training") else sorted(f for f in own if f in self.weights)

    def scores(self, texts: pa.Array) -> np.ndarray:
        docs, features = self.features(texts)
        sums = np.bincount(docs, weights=np.array([self.weights[f] for f in features.tolist()]), minlength=len(texts)) if len(docs) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -500, 500)))


def lone(token: str) -> str:
    """The one character of a token that is a single letter, digit or sign but for punctuation at its ends, or ""."""
    core = token if len(token) == 1 else token.strip(_edges)
    return core if len(core) == 1 and (core.isalnum() or core in STANDS_FOR or core == ANY) else ""


def word_features(word: str) -> list[int]:
    """The word and its first three to seven characters."""
    return [zlib.crc32(x.encode()) % BUCKETS for x in ({f"w{word}"} | {f"p{word[:n]}" for n in range(3, 8) if len(word) >= n})]


def char_model(documents: DataFrame) -> CharModel:
    """Trigrams of the lower-cased characters of all texts, any white space one blank; ENTRIES sums whatever the texts."""

    def count(batches):
        held = np.zeros(ENTRIES, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column("text"), 1 << 20):
                points = np.frombuffer("\n\n".join(texts.to_pylist()).lower().encode("utf-32-le", "replace"), np.uint32)
                symbols = _symbols()[points].astype(np.int32)
                held[: SYMBOLS**3] += np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)
                held[SYMBOLS**3 :] += np.bincount(np.minimum(points, ALPHABET - 1), minlength=ALPHABET)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"code": pa.array(some), "n": pa.array(held[some])})

    table = documents.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ENTRIES, np.int64)
    counts[table["code"].to_numpy()] = table["n"].to_numpy()
    return CharModel(counts)


def fit(rows: list[np.ndarray], toxic: np.ndarray, epochs: int = 8, alpha: float = 2.0, l1: float = 5.0, l2: float = 0.01) -> tuple[dict[int, float], float]:
    """FTRL-proximal over rows of features that are present; (weights that are not 0, intercept)."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = nb = 0.0
    rng = np.random.default_rng(5)

    def weight(at):
        s = z[at]
        return np.where(np.abs(s) > l1, (np.sign(s) * l1 - s) / ((1 + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, w = rows[k], weight(rows[k])
            b = -zb / ((1 + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum() + b)))) - toxic[k]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    every = np.flatnonzero(np.abs(z) > l1)
    values = weight(every)
    return dict(zip(every.tolist(), values.tolist(), strict=True)), -zb / ((1 + math.sqrt(nb)) / alpha)


def train(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC, other_rows: int = OTHER) -> Scorer:
    """Fits on at most so many toxic and other documents outside the held-out fold."""
    bound_batches(documents.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.filter(~held_out()).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = shares.get(1, 0), shares.get(0, 0)
    chars = char_model(documents)
    if not n_toxic or not n_other:
        share = min(1 - 1e-6, max(1e-6, n_toxic / (n_toxic + n_other))) if n_toxic + n_other else 0.5
        return Scorer(chars, {}, math.log(share / (1 - share)), "toxicity-none")
    draft = Scorer(chars, name=f"training-{zlib.crc32(chars.table.tobytes())}")

    def features(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist()
            for first, texts in text_slices(batch.column("text")):
                docs, found = draft.features(texts)
                starts = np.searchsorted(docs, np.arange(len(texts) + 1)).astype(np.int32)
                to = first + len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:to], pa.int64()), pa.array(marks[first:to], pa.int32()), pa.ListArray.from_arrays(pa.array(starts), pa.array(found.astype(np.int32)))], ["doc_id", "toxic", "features"]
                )

    picked = sample(documents, known, [(toxic_rows, F.col("toxic") == 1), (other_rows, F.col("toxic") == 0)])
    table = picked.mapInArrow(features, "doc_id long, toxic int, features array<int>").toArrow().combine_chunks().sort_by("doc_id")
    marks = table["toxic"].to_numpy()
    weights, intercept = fit([x.values.to_numpy() for x in table["features"]], marks)
    drawn = max(1, int(marks.sum())) / max(1, int((marks == 0).sum()))
    return Scorer(chars, weights, intercept + math.log(n_toxic / n_other / drawn), f"toxicity-{zlib.crc32(repr(sorted(weights.items())).encode())}")


def scored(text: Column, scorer: Scorer) -> Column:
    """Probability (0 to 1) that a text is toxic."""

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(scorer.scores(part) for _, part in text_slices(texts))]))

    return toxicity(F.coalesce(text, F.lit("")))


def restored_text(text: Column, scorer: Scorer) -> Column:
    """The text with each token's disguise undone, words joined by blanks."""

    @F.arrow_udf("string")
    def restore(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else " ".join(w for token in t.split() for w in scorer.restored(token)) for t in texts.to_pylist()], pa.string())

    return restore(text)


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    scorer = train(documents, labels)
    seen = documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), scored(F.col("text"), scorer).alias("score"))
    return seen.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
