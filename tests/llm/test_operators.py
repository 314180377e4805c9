"""The corpus operators against brute force on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import bisect
import glob
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import components, decontam, hilbert, langid, minhash, quality, spotsigs, toxicity, treebpe, urllists, wavelet
from strandline.llm.common import shared_dir, tokenizer_path
from strandline.llm.labelled import held_out
from strandline.llm.words import Words

WORDS = "the of and river stone house light paper green water small bridge over under night day".split()


def some_texts(n=60, seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " ", "a", "The the", "x" * 3000, "Ünïcödé 日本 🙂 of the", "  two  blanks\n\nlines\t", *texts, texts[0], texts[0], texts[1] + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3, t, "en", f"s{k % 3}", "clash") for k, t in enumerate(some_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- BPE


def test_bpe_equals_library():
    engine = treebpe.TreeBpe.of("byte_bpe_50k.json")
    rng = random.Random(1)
    alphabet = "aabcdeéñ ü.,'s\n\t  1290!!??\x1c 日本語🙂ll're\xa0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", "a  b", "a\n b", "x<|endoftext|> y", "foo <|endoftext|>  bar", "!\x1c b", "the" * 3000, "日本" * 900, "!" * 5000, "12" * 2000, " " * 3000, "".join(rng.choice("thenrig") for _ in range(9000))]
    ids, starts = engine.encode_batch(pa.array(texts))
    for k, t in enumerate(texts):
        expected = engine.full.encode(t, add_special_tokens=False).ids
        own = ids[starts[k] : starts[k + 1]]
        assert own.tolist() == expected == engine.encode(t).tolist()
        assert engine.decode(own) == engine.full.decode(expected, skip_special_tokens=False)
    assert engine.decode_batch(ids, starts).to_pylist() == texts
    broken = np.array([237, 50256, 5], np.uint32)
    assert engine.decode_batch(broken, np.array([0, 1, 3])).to_pylist() == [engine.full.decode(x, skip_special_tokens=False) for x in ([237], [50256, 5])]


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_tree_joins_exactly(leaf):
    engine = treebpe.TreeBpe(tokenizer_path("byte_bpe_50k.json"), leaf)
    rng = random.Random(leaf)
    for _ in range(60):
        part = engine.mapped("".join(rng.choice(["the", "re", "in", "z", "é", "ing", "日"]) for _ in range(rng.randint(1, 80))))
        assert engine.tree(part) == engine.plain.encode(part).ids


def test_bpe_columns(docs, empty):
    got = {r["doc_id"]: r for r in treebpe.digests(docs).collect()}
    for r in docs.collect():
        ids = np.array(treebpe.TreeBpe.of("byte_bpe_50k.json").full.encode(r["text"] or "").ids, "<u4")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert treebpe.digests(empty).count() == 0


# --- wavelet shards


def test_wavelet_queries():
    rng = np.random.default_rng(0)
    ids = rng.choice([0, 1, 2, 7, 300, 49407], 5000).astype(np.uint32)
    shard = wavelet.WaveletShard(wavelet.pack(ids, np.array([5]), np.array([5000]), np.array([False]), 17))
    assert (shard.tokens() == ids).all() and shard.first == 17
    for i in range(0, 5000, 371):
        assert shard.access(i) == ids[i]
    for t in (0, 1, 2, 7, 300, 49407, 5, 70000):
        places = np.flatnonzero(ids == t)
        assert shard.count(t) == len(places) and shard.rank(t, 1234) == (places < 1234).sum()
        assert shard.occurrences(t)[:20] == places[:20].tolist() if len(places) < 900 else shard.select(t, 777) == places[777]
    with pytest.raises(IndexError):
        shard.select(5, 0)


def test_wavelet_files(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in wavelet.digests(docs).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.digests(empty).count() == 0
    path = wavelet.new_path(spark, "small")
    sizes = wavelet.write_shards(docs, path, shard_tokens=100)
    many = {r["doc_id"]: r["start"] for r in wavelet.read_shards(spark, path, sizes).collect()}
    assert many == {k: g["start"] for k, g in got.items()}


def test_wavelet_folder(spark, docs):
    """Counts and places over a folder equal a plain scan of the ids; null and repeated doc_ids are documents of their own."""
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "the stone"), (None, None), (0, "the of the")], "doc_id long, text string"))
    path = wavelet.new_path(spark, "folder")
    sizes = wavelet.write_shards(odd, path, shard_tokens=150)
    rows = sorted(wavelet.read_shards(spark, path, sizes).collect(), key=lambda r: r["start"])
    assert len(rows) == odd.count() and [r["doc_id"] for r in rows[:2]] == [None, None]
    flat = [(i, r["doc_id"], k, r["start"] + k) for r in rows for k, i in enumerate(np.frombuffer(r["ids"], "<u4").tolist())]
    common = [t for t, _ in Counter(i for i, *_ in flat).most_common(3)] + [41000]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(spark, path, common).collect()} == {t: sum(i == t for i, *_ in flat) for t in common}
    places = [tuple(r) for r in wavelet.token_places(spark, path, sizes, common[1:]).collect()]
    assert sorted(places, key=str) == sorted((x for x in flat if x[0] in common[1:]), key=str)


# --- decontamination


def brute_hits(text, items, window):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for item, other in items:
        for w in decontam.windows_of(decontam.words_of(other), window):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1, 1 << 25])
def test_decontamination(spark, docs, block_bytes):
    texts = [t for t in some_texts() if t and len(t.split()) > 30]
    items = [(1, "the of"), (2, texts[0][20:160]), (3, None), (4, "!!!"), (5, texts[1]), (5, texts[2]), (None, texts[3]), (6, "zebra"), (1, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    copies = lambda: len(glob.glob(shared_dir(spark).removeprefix("file://") + "/decontam-*"))
    before = copies()
    got = {r["doc_id"]: r["found"] for r in decontam.hits(docs, bench, window=5, block_bytes=block_bytes).collect()}
    assert copies() - before <= 1  # what the last of many blocks reads
    for r in docs.collect():
        f = got[r["doc_id"]]
        assert (f["n_words"], sum(s["end"] - s["start"] for s in f["spans"]), f["items"]) == brute_hits(r["text"], items, 5)


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.kept(docs, bench).count() == docs.count() and decontam.kept(docs, bench).columns == docs.columns
    assert decontam.digests(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- near-duplicates


def brute_components(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k in sorted(sets):
        for x in sets[k]:
            holders.setdefault(x, []).append(k)
    for a, b in {(min(p), max(p)) for ks in holders.values() for p in combinations(ks, 2)}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_minhash_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, key = [(k, t) for k, t in enumerate(some_texts(20))], 1000
    for _ in range(6):  # families of near copies at many distances, chains included
        text = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(rng.randint(5, 40)):
            if rng.random() < 0.7:
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((key, " ".join(text)))
            key += rng.randint(1, 3)
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.clusters(df, 3, 85).collect()}
    expected = brute_components(rows, 3, 85)
    assert got == {k: (n, c, k == c) for k, (n, c) in expected.items()}
    left = minhash.kept(df, 3, 85)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, (_, c) in expected.items() if k == c)


def test_minhash_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_minhash_equals_brute_force(spark)


def test_minhash_edges(spark, empty):
    assert minhash.clusters(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.clusters(odd).collect()), key=str)
    assert got == [(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True), (None, 2, None, True)]
    assert minhash.kept(odd).count() == 5
    rows, bands = minhash.plan(80)
    assert (1 - 0.8**rows) ** bands <= minhash.MISS


def test_minhash_repeated_ids(spark):
    """One doc_id with several texts is one document: (1, A) and (1, B) join what resembles A with what resembles B."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "ABCD"}
    near = {k: t + " end" for k, t in text.items()}
    rows = [(1, text["A"]), (1, text["B"]), (3, near["A"]), (4, near["B"]), (2, text["C"]), (7, text["C"]), (7, text["D"]), (9, near["D"]), (0, text["D"]), (5, None), (5, near["C"]), (8, "alone here")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.clusters(df).collect()} == {(1, 1, True), (3, 1, False), (4, 1, False), (0, 0, True), (2, 0, False), (7, 0, False), (9, 0, False), (5, 0, False), (8, 8, True)}


def test_minhash_recall(spark):
    """Every document of a table of the driver against brute force over all pairs that share a shingle."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for width, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in minhash.clusters(df, width, percent).collect()}
        assert got == {k: c for k, (_, c) in brute_components([tuple(r) for r in df.collect()], width, percent).items()}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7), (1, 0)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == root(x) for x in got) and {x for x in parent if Counter(a for e in edges if e[0] != e[1] for a in e)[x]} == set(got)


# --- sharding


def test_hilbert_curve():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        at = hilbert.hilbert_index(cells, bits)
        assert sorted(at.tolist()) == list(range(1 << (bits * d)))
        assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_hilbert_shards(spark, docs, empty):
    got = hilbert.digests(docs).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(got) == len(texts) and all(g["size"] == len(texts[g["doc_id"]]) + 16 and g["text_crc32"] == zlib.crc32(texts[g["doc_id"]]) for g in got)
    slots = {}
    for g in got:
        slots.setdefault(g["shard"], []).append(g["slot"])
    counts = [len(slots.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hilbert.digests(empty).count() == 0


def test_hilbert_equals_plain_sort(spark, docs):
    """All rows sorted by (curve index, doc_id, checksum) and cut into equal runs, with a clash of every working name."""
    path = wavelet.new_path(spark, "plain-shards")
    wide = docs.withColumn("source", F.concat(F.lit("https://a.example/"), "source")).selectExpr("*", "1 AS slot", "2 AS curve", "3 AS file", "'k' AS checksum")
    dimensions = hilbert.document_dimensions()
    name = hilbert.write_shards(wide, path, dimensions, shards=7, bits=3)
    rows, slot = hilbert.read_slots(wide, path, name)
    assert name == "_shard" and slot == "_slot" and set(wide.columns) < set(rows.columns)
    got = {r["doc_id"]: (r[name], r[slot], r["shard"], r["file"], r["source"]) for r in rows.collect()}
    all_ = wide.select("doc_id", "text", "source", *[d.alias(f"d{i}") for i, d in enumerate(dimensions.values())]).collect()
    cells = []
    for i in range(4):
        values = [r[f"d{i}"] for r in all_]
        ordered = sorted(v for v in values if v is not None)
        if isinstance(ordered[0], str):
            cuts = sorted({ordered[-(-k * len(ordered) // 8)] for k in range(1, 8)} - {ordered[0]})
        else:
            cuts = hilbert.cut_points(wide.select(list(dimensions.values())[i].cast("double").alias("x")), ["x"], 3)["x"]
        cells.append([0 if v is None else bisect.bisect_right(cuts, v) for v in values])
    at = hilbert.hilbert_index(np.array(cells).T, 3)
    order = sorted(range(len(all_)), key=lambda i: (at[i], all_[i]["doc_id"], zlib.crc32((all_[i]["text"] or "").encode())))
    slots = Counter()
    for rank, i in enumerate(order):
        shard = rank * 7 // len(order)
        assert got[all_[i]["doc_id"]] == (shard, slots[shard], "clash", 3, all_[i]["source"])
        slots[shard] += 1
    assert len(set(cells[1])) == 3  # sources that share their first bytes are in cells of their own


def test_hilbert_ties(spark):
    rows = spark.createDataFrame([(1, "same", "en", "s")] * 100 + [(None, None, None, None)] * 30, "doc_id long, text string, lang string, source string")
    counts = Counter(r["shard"] for r in hilbert.digests(rows).collect())
    assert sum(counts.values()) == 130 and max(counts.values()) - min(counts.get(k, 0) for k in range(40)) <= 1


# --- fingerprints


def brute_spots(text):
    import regex

    common, tokens, run = set(spotsigs.COMMON), [], []
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    for w in words:
        if w in common:
            run.append(w)
        else:
            tokens.append((tuple(run), w))
            run = []
    found = {(a, w, tokens[k + 1][1]) for k, (a, w) in enumerate(tokens) if a and k + 1 < len(tokens)}
    return found or ({tuple(words)} if words else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_spotsigs(docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in spotsigs.digests(docs).collect()}
    for k, (key, text) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(text)
        edited, g = text[: n - n // 2] + following[: n // 2], got[key]
        assert (g["n_chars"], g["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert g["near_edited"] == pytest.approx(jaccard(brute_spots(text), brute_spots(edited))) and g["near_next"] == pytest.approx(jaccard(brute_spots(text), brute_spots(following)))
    by_text = {}
    for key, text in rows:
        by_text.setdefault(text, set()).add(got[key]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and spotsigs.digests(empty).count() == 0
    assert spotsigs.digests(docs.limit(1)).count() == 1


def test_spotsigs_pairs(docs):
    close, member = spotsigs.pairs(docs, 0.5)
    got = {(r["a"], r["b"]) for r in close.collect()}
    sets, first = {r["doc_id"]: frozenset(brute_spots(r["text"])) for r in docs.collect()}, {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    named = {v: k for k, v in first.items() if k}
    assert got == {(a, b) for a in named for b in named if a < b and jaccard(named[a], named[b]) >= 0.5}
    assert {r["doc_id"]: r["class"] for r in member.collect()} == {k: first[s] for k, s in sets.items()}


def test_spotsigs_links(spark, docs, empty):
    family = [(900 + v, " ".join(f"the x{i if (i * 7) % 41 > v * 3 else 100 * v + i} y{i}" for i in range(40))) for v in range(6)]
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*family, (None, family[2][1]), (None, some_texts()[9]), (None, "no such text as this"), (0, some_texts()[10]), (3, None)], "doc_id long, text string"))
    for threshold in (0.3, 0.8):
        got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in spotsigs.links(odd, threshold).collect())
        rows = [(r["doc_id"], frozenset(brute_spots(r["text"]))) for r in odd.collect()]
        first = {}
        for k, s in rows:
            first[s] = min([x for x in (first.get(s), k) if x is not None], default=None)
        known = [s for s in first if s and first[s] is not None]
        n = {s: sum(jaccard(s, t) >= threshold for t in known if t != s) for s in known}
        assert got == sorted((str(k), str(first[s]), n.get(s, 0)) for k, s in rows)
        assert any(n.values())
    assert spotsigs.links(empty).count() == 0


def chain(*names):
    """A text with one signature for each name."""
    return " ".join(f"the {w}" for w in names)


def test_spotsigs_links_read_texts_once(docs):
    plan = spotsigs.links(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "text#" not in plan


def test_spotsigs_links_at_a_threshold_that_rounds_up(spark):
    # 14 signatures of 25: 0.56, though 0.56 * 25 is a little over 14 in binary.
    names = [f"w{i}" for i in range(26)]
    rows = spark.createDataFrame([(1, chain(*names)), (2, chain(*names[:15]))], "doc_id long, text string")
    assert [r["n_links"] for r in spotsigs.links(rows, 0.56).collect()] == [1, 1]


def test_spotsigs_links_in_crowds(spark, monkeypatch):
    """The same links where few meet, in crowds, and in crowds of many blocks; each pair once, none lost between the two ways."""
    rng = random.Random(5)
    texts = [chain(*(f"w{i}" if rng.random() > 0.06 else f"v{k}x{i}" for i in range(rng.choice((28, 30, 34))))) for k in range(45)]
    texts += [chain(*(f"q{rng.randrange(60)}" for _ in range(rng.randint(3, 30)))) for _ in range(45)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    sets = [frozenset(brute_spots(t)) for t in texts]
    for threshold in (0.3, 0.7):
        expected = [sum(jaccard(a, b) >= threshold for b in set(sets)) - 1 for a in sets]
        assert max(expected) > 20
        for crowd, block in ((1 << 30, 1024), (2, 4), (30, 16)):
            monkeypatch.setattr(spotsigs, "CROWD", crowd)
            monkeypatch.setattr(spotsigs, "BLOCK", block)
            assert [r["n_links"] for r in spotsigs.links(rows, threshold).orderBy("doc_id").collect()] == expected


# --- url lists


def test_url_lists(spark):
    changes = spark.createDataFrame(
        [("l", "bad.com", 10, True), ("l", "bad.com", 20, False), ("l", "bad.com", 30, True), ("m", "com", 15, True), ("m", "com", 15, False), ("l", "x.org", 5, True), ("l", "x.org", 6, True), (None, None, 1, True)],
        "list string, host string, at long, added boolean",
    )
    captures = spark.createDataFrame(
        [(1, "http://a.bad.com/x", 9), (2, "http://a.BAD.com:80/x", 10), (3, "https://u@bad.com", 20), (4, "http://bad.com./", 31), (5, "http://notbad.com/", 12), (6, "x.org", 9), (7, None, 9), (8, "http://x.org/?u=http://bad.com", 9), (8, "http://x.org/?u=http://bad.com", 9), (9, "http://x.org", None)],
        "page_id long, url string, fetched long",
    )
    got = [(r["page_id"], r["listed"], r["n_entries"], r["lists"]) for r in urllists.verdicts(captures, changes).orderBy("page_id").collect()]
    yes, no = lambda k: (k, True, 1, "l"), lambda k: (k, False, 0, "")
    assert got == [no(1), yes(2), no(3), yes(4), no(5), no(6), no(7), yes(8), yes(8), no(9)]
    assert not urllists.verdicts(captures, changes.limit(0)).filter("listed").count() and urllists.verdicts(captures.limit(0), changes).count() == 0


def test_url_list_names(spark):
    """Columns of the captures that have a working or a result name stay as they are."""
    changes = spark.createDataFrame([("l", "com", 5, True), ("m", "b.com", 0, True)], "list string, host string, at long, added boolean")
    captures = spark.createDataFrame([("http://a.b.com", 9, "h", "t", "n", 1, 2, 3), ("http://a.org", 9, "h", "t", "n", 1, 2, 3)], "url string, fetched long, _host string, _at string, _name string, listed int, n_entries int, lists int")
    got = urllists.verdicts(captures, changes)
    assert got.columns == [*captures.columns, "_listed", "_n_entries", "_lists"]
    assert sorted(tuple(r)[2:] for r in got.collect()) == [("h", "t", "n", 1, 2, 3, False, 0, ""), ("h", "t", "n", 1, 2, 3, True, 2, "l,m")]


# --- classifiers


@pytest.fixture(scope="module")
def corpus(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_language_held_out(corpus):
    docs, _ = corpus
    p = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (p["lang"] == p["lang_pred"]).mean() > 0.97 and p["rejected"].mean() < 0.02 and p["score"].between(0, 1).all()


def test_language_rejects_what_it_did_not_learn(corpus):
    docs, _ = corpus
    known, other = docs.filter("lang != 'de'"), docs.filter("lang = 'de'")
    model = langid.train(known)
    told = lambda df: model.predict(pa.array([r["text"] for r in df.collect()]))[2].mean()
    assert told(other) > 0.9 and told(known) < 0.02
    words = ["wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "все люди рождаются свободными и равными", "xq zzkw vvq jjx qpw kzzx"]
    assert model.predict(pa.array(words))[2].all()


def plain_language(model, text):
    """The definition: the average over all subwords of all words, one by one."""
    found = np.concatenate([np.empty(0, np.int32), *(ids for w in text.split() for ids, _ in langid.subwords([w]))])
    if not len(found):
        return langid.UND, 0.0
    x = (sum(model.scores[i, :-1].astype(float) for i in found) / len(found) + model.bias) / model.temperature
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_language_equals_plain_average(corpus):
    docs, _ = corpus
    model = langid.train(docs)
    texts = [t for t in some_texts() if t is not None]
    languages, p, _ = model.predict(pa.array(texts))
    for text, y, q in zip(texts, languages, p, strict=True):
        assert (y, pytest.approx(q, abs=1e-5)) == plain_language(model, text)


def test_subwords():
    """Pieces of 2 to 4 characters of a run of letters between two marks (but the whole of that), and the run: as many as
    the definition has, equal for equal pieces only."""

    def pieces(word):
        out = []
        for run in re.findall(r"[^\W\d_]+", word.lower()):
            marked = f"<{run}>"
            out += [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1) if n < len(marked)] + [f"whole {run}"]
        return out

    names = {}
    for word in ["The", "then", "été", "a", "x1yy2", "...", "nth", "Ünï"]:
        ids = np.concatenate([i for i, _ in langid.subwords([word])]).tolist()
        assert len(ids) == len(pieces(word))
        for n, i in zip(sorted(Counter(pieces(word)).values()), sorted(Counter(ids).values()), strict=True):
            assert n == i
        names[word] = set(ids)
    assert len(names["The"] & names["then"]) >= 3 and not names["a"] & names["Ünï"]


def test_language_edges(spark, docs, empty):
    got = {r["doc_id"]: r for r in langid.predictions(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx"))).collect()}
    assert got[0]["lang_pred"] == got[3]["lang_pred"] == langid.UND and got[0]["rejected"]
    assert {r["lang_pred"] for r in langid.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {langid.UND}
    assert langid.predictions(empty).count() == 0 and langid.kept(docs).columns == docs.columns


def test_quality_held_out(corpus):
    docs, labels = corpus
    q = quality.ratings(docs, labels).join(labels, "doc_id").toPandas()
    q = q[[zlib.crc32(str(k).encode()) % 5 == 0 for k in q["doc_id"]]]
    assert q["selected"][q["quality"] == 1].mean() > 0.98 and q["selected"][q["quality"] == 0].mean() < 0.4
    assert q["expected_grade"].between(0, 2).all()


def test_quality_grades_rise(spark):
    """On held-out documents each grade has a higher expected grade than the one below."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rated = quality.ratings(docs, labels).join(labels, "doc_id").withColumn("grade", quality.grade(F.col("quality"), F.col("toxic")))
    means = [r["m"] for r in rated.filter(held_out()).groupBy("grade").agg(F.avg("expected_grade").alias("m")).orderBy("grade").collect()]
    assert len(means) == 3 and means[1] - means[0] > 0.8 and means[2] - means[1] > 0.2


def test_quality_equals_plain_score():
    """The definition, text by text: averages over words, buckets that are there, and the ordinal curve."""
    rng = np.random.default_rng(3)
    model = quality.Model("plain-test", rng.normal(0, 1, 2 * quality.BUCKETS) * (rng.random(2 * quality.BUCKETS) < 0.5), np.array([-1.0, 0.5]), [0, 1, 2])
    texts = [t for t in some_texts() if t is not None] + ["The the THE. 'the' a a", "x1 Y2!"]
    tails = model.tails(pa.array(texts))
    for text, tail in zip(texts, tails, strict=True):
        words = text.split()
        every = [quality.word_features(w) for w in words]
        score = sum(model.weights[f] for x in every for f in x[:3]) / max(1, len(words)) + sum(model.weights[f] for f in {x[3] for x in every})
        score += model.weights[quality.text_features(Words(pa.array([text])), np.zeros(len(set(words)), int))].sum()
        assert tail == pytest.approx([1 / (1 + np.exp(t - score)) for t in model.thresholds])


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(k * 3, 1, 0) for k in range(9)] + [(30, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert quality.kept(docs, labels).count() == docs.count()
        assert quality.ratings(empty, labels).count() == 0


def test_ordinal_thresholds_rise():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 300)
    model = quality.fit(x + 10, np.arange(300), np.ones(300), np.clip(x + (rng.random(300) < 0.1), 0, 2))
    there = quality.fit(x + 10 + quality.BUCKETS, np.arange(300), np.ones(300), x)
    assert there.weights[10 + quality.BUCKETS] < there.weights[12 + quality.BUCKETS]
    assert (np.diff(model.thresholds) > 0).all() and model.weights[10] < model.weights[11] < model.weights[12]


def test_toxicity_held_out(corpus):
    docs, labels = corpus
    t = toxicity.scores(docs, labels).join(labels, "doc_id").toPandas()
    assert t["score"].between(0, 1).all() and (t["predicted"] == (t["score"] >= 0.5)).all()
    held = t[t["held_out"]]
    pos, neg = held["score"][held["toxic"] == 1].to_numpy(), held["score"][held["toxic"] == 0].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.75 and (neg >= 0.5).mean() < 0.05


def test_viterbi_equals_all_paths(corpus):
    docs, _ = corpus
    chars = toxicity.char_model(docs)
    rng = random.Random(9)
    for _ in range(150):
        part = "".join(rng.choice("aost01$@!e") for _ in range(rng.randint(1, 6)))
        lattice = toxicity.lattice_of(part, gaps=rng.random() < 0.4)
        paths = [("".join(x for x, _ in choice), sum(c for _, c in choice)) for choice in product(*lattice)]
        costs = {}
        for text, spent in paths:
            padded = f"  {text} "
            cost = spent + sum(chars.cost(padded[k : k + 3]) for k in range(len(padded) - 2))
            costs[text] = min(cost, costs.get(text, np.inf))
        text, cost = chars.cheapest(lattice)
        assert cost == pytest.approx(min(costs.values()))
        assert min(costs[t] for t in costs if t.strip() == text) == pytest.approx(cost)


def test_trigram_table(spark):
    model = toxicity.char_model(spark.createDataFrame([("Ab c1ß",), ("",), ("a\nb",), ("日x",), (None,)], "text string"))
    assert model.table.shape == (64, 64, 64) and (model.table > 0).all()
    assert model.cost("ab ") < model.cost("abz") and model.cost("  a") == model.cost("\n\na")


def test_toxicity_equals_plain_score(corpus):
    """The definition: features of all restored words, each once, under the weights."""
    docs, labels = corpus
    scorer = toxicity.train(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["", "you 1d10t !diot m o r o n", "a b", "i d"]
    for text, score in zip(texts, scorer.scores(pa.array(texts)), strict=True):
        found, run = set(), []
        for token in [*(text or "").split(), None]:
            found |= {f for w in scorer.restored(token or "") for f in toxicity.word_features(w)}
            one = toxicity.lone(token or "")
            if one:
                run.append(one)
                continue
            if len(run) > 1:
                found |= {f for w in scorer.spaced("".join(run).lower()) for f in toxicity.word_features(w)}
            run = []
        total = scorer.intercept + sum(scorer.weights.get(f, 0.0) for f in found)
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_deobfuscation(corpus):
    docs, _ = corpus
    scorer = toxicity.Scorer(toxicity.char_model(docs))
    for disguised, word in {"1d10t": "idiot", "idi0t": "idiot", "l0s3r!!": "loser", "$tup1d": "stupid", "m0r0n": "moron", "iiidiooot": "idiot", "i.d.i.o.t": "idiot", "scum%%%": "scum", "Trash,": "trash"}.items():
        assert scorer.restored(disguised) == [word], disguised
    assert scorer.spaced("idiot") == ["idiot"]
    draft = toxicity.Scorer(scorer.chars, name="training")
    features = lambda t: set(draft.features(pa.array([t]))[1].tolist())
    assert set(toxicity.word_features("moron")) <= features("you m o r o n now") and features("") == set()


def test_lattice_decides_for_signs_and_digits(corpus):
    docs, _ = corpus
    scorer = toxicity.Scorer(toxicity.char_model(docs))
    for disguised, words in {
        "1053r": ["loser"], "1d107": ["idiot"], "5(um": ["scum"], "!diot": ["idiot"], "(lown": ["clown"],
        "moroon": ["moron"], "worthless": ["worthless"], "(the)": ["the"], "the!!": ["the"], "the***": ["the"],
        "2023-05-01": [], "(017)": [], "$5": [], "***": [], "!!": [],
    }.items():
        assert scorer.restored(disguised) == words, disguised
    # "as" or "ass": what the corpus makes likelier.
    assert all(scorer.restored(x) in (["as"], ["ass"]) for x in ("a$$", "@$$"))


def test_spaced_words_with_punctuation(corpus):
    docs, _ = corpus
    draft = toxicity.Scorer(toxicity.char_model(docs), name="training-spaced")
    features = lambda t: set(draft.features(pa.array([t]))[1].tolist())
    for text, word in {"the s c u m. the": "scum", 'the "m o r o n." the': "moron", "the m, o, r, o, n! the": "moron", "the s u m the": "sum", "the s.u.m the": "sum"}.items():
        assert set(toxicity.word_features(word)) <= features(text), text


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(k * 3, 1, 0) for k in range(9)] + [(30, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.scores(docs, none).collect()} == {0.5}
    assert all(r["score"] < 0.01 for r in toxicity.scores(docs, one).collect()) and toxicity.scores(empty, one).count() == 0
