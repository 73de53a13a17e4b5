"""The pipeline's stages on awkward rows, each against what its operator decides."""

import random
import struct

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cairn.llm import mixing, packing, quality_rules
from test_llm import awkward_texts, brute_components, brute_dedup, brute_padding, docs_of, prose, ws


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, awkward_texts()).drop("fail_bits", "p", "bucket").cache()


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, docs, labels):
    texts = awkward_texts()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    kept = {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").collect()}
    out = stages["quality_rules"](spark, docs, labels)
    assert out.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in out.collect()} == kept
    want = brute_dedup(texts)
    got = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, docs, labels).collect()}
    gone = {i for i, t in enumerate(want) if t != texts[i] and not (t or "").split()}
    assert got == {i: t for i, t in enumerate(want) if i not in gone} and 9 in gone and 8 not in gone
    first = {i for i, n, c in brute_components(texts) if i == c}
    assert {r["doc_id"] for r in stages["ngram_join"](spark, docs, labels).collect()} == first
    assert stages["mixing"](spark, docs, labels).count() == len(texts)  # one domain: nothing to weigh down
    assert stages["packing"](spark, docs, labels).count() == len(texts)


def test_mixing_stage_by_hand(spark, tmp_path):
    """The stage's rows against rates stepped in numpy from the classifier's posteriors, and hashes by hand."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(5, 60)) + (" scum idiot trash moron" * 4 if i % 3 == 0 else "") for i in range(240)]
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, texts).drop("fail_bits", "p", "bucket")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, str(tmp_path)).collect()}
    rows = {r["doc_id"]: r for r in mixing.mix(docs, mixing.domains_of(spark.read.parquet(f"{tmp_path}/labels.parquet")), max_rate=1.0).collect()}
    p = np.array([[rows[i]["p"]["clean"], rows[i]["p"]["toxic"]] for i in range(240)])
    n = np.array([len(t.split()) for t in texts])
    at_one = (n[:, None] * p).sum(axis=0)
    pull = np.minimum(at_one[0] / 0.9 * np.array([0.9, 0.02]), at_one)
    r = y = np.ones(240)
    for t in range(mixing.ITERATIONS):
        new = np.clip(y - p @ ((((n * y)[:, None] * p).sum(axis=0) - pull) / at_one), 0, 1)
        y, r = new + t / (t + 3) * (new - r), new
    chance = [(xxhash.xxh64_intdigest(struct.pack("<i", 7), xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) % (1 << 30)) / (1 << 30) for i in range(240)]
    sure = [i for i in range(240) if abs(r[i] + chance[i] - 1) > 0.02]
    assert len(sure) > 200 and {i for i in sure if i in kept} == {i for i in sure if r[i] + chance[i] >= 1}
    toxic = [i for i in range(240) if i % 3 == 0]
    assert len(kept & set(toxic)) < 20 and len(kept - set(toxic)) > 150


def test_packing_stage_by_hand(spark, docs, labels):
    few = docs.where("doc_id < 12")
    got = dict(corpus_pipeline.STAGES)["packing"](spark, few, labels).collect()
    assert sum(r["padding"] for r in got) == brute_padding([len(ws(awkward_texts()[i])) for i in range(12)], packing.BUCKETS)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == 12


def test_run(spark, tmp_path):
    """run() is its stages one after the other."""
    rng = random.Random(6)
    base = [prose(rng, 60) for _ in range(30)]
    texts = [*base, *base[:5], None, "", "too short", "word " * 300]
    docs_of(spark, texts).drop("fail_bits", "p", "bucket").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(30))


def test_empty(spark, docs, labels):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, labels).count() == 0
