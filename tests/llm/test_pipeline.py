"""Each stage of the pipeline against a plain version of it, over what the stage before left."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandline.llm import langid, quality
from strandline.llm.common import new_path
from strandline.llm.treebpe import TreeBpe
from tests.llm.test_operators import brute_components, brute_hits

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input rows, output rows, columns) of each stage, as run() chains them."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, path = docs.collect(), new_path(spark, f"test-{name}")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs.collect(), docs.columns)
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "encoding"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(stages[n][2] == columns for n in list(stages)[:-1])
    rows = [set(map(tuple, stages[n][0])) >= set(map(tuple, stages[n][1])) for n in list(stages)[:-1]]
    assert all(rows) and len(stages["quality"][0]) > len(stages["quality"][1]) > 100


def test_model_stages(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before, after, _ = stages["quality"]
    model = quality.train(spark.createDataFrame(before), labels)
    keep = [r["doc_id"] for r in before if model.tails(pa.array([r["text"]]))[0, 0] >= quality.REJECT]
    assert sorted(keep) == ids(after)
    before, after, _ = stages["language"]
    model = langid.train(spark.createDataFrame(before))
    assert sorted(r["doc_id"] for r in before if not model.predict(pa.array([r["text"]]))[2][0]) == ids(after)


def test_near_dedup(stages):
    before, after, _ = stages["near_dedup"]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert ids(after) == sorted(k for k, (_, c) in groups.items() if k == c)


def test_decontamination(spark, stages):
    before, after, _ = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    clean = []
    for r in before:
        n, hit, _ = brute_hits(r["text"], items, 13)
        if not (hit > 0 and 20 * hit >= n):
            clean.append(r["doc_id"])
    assert sorted(clean) == ids(after)


def test_encoding(stages):
    before, after, _ = stages["encoding"]
    whole, texts = TreeBpe.of("byte_bpe_50k.json").full, {r["doc_id"]: r["text"] for r in before}
    assert ids(before) == ids(after)
    for r in after:
        expected = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected and r["n_tokens"] == len(expected) and r["round_trip"]
