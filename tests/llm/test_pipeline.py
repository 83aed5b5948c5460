"""The pipeline against brute force over the smallest scale, stage by stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import pii, toxicity
from tickloom.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    for one in stages[:-1]:
        assert one.columns == stages[0].columns


def test_toxic_documents_go(spark, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    scored = toxicity.score(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert kept == {r.doc_id for r in scored if r.score < corpus_pipeline.TOXIC}


def test_one_of_each_group_stays(stages):
    from tickloom.llm.simhash import fingerprint

    rows = sorted((r.doc_id, fingerprint((r.text or "").encode(), 3)) for r in stages[1].collect())
    label = {d: d for d, _ in rows}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((label[a], label[b]))
                label = {d: low if k == high else k for d, k in label.items()}
    assert {r.doc_id for r in stages[2].collect()} == {d for d, k in label.items() if d == k}


def test_benchmark_passages_go(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = set()
    for r in stages[2].collect():
        w = low(r.text)
        hit = {k for x in {len(x) for x in windows} for i in range(len(w) - x + 1) if tuple(w[i : i + x]) in windows for k in range(i, i + x)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(r.doc_id)
    assert {r.doc_id for r in stages[3].collect()} == clean


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    left = pii.find(stages[4]).agg(*[F.sum(F.size(k)).alias(k) for k in pii.BASE]).first()
    assert not any(left)
    for r in stages[4].collect():
        assert r.n_chars == len(r.text) and r.text.count("<email>") >= len(re.findall(r"[a-z.0-9]+@mail[0-9]+\.example\.com", before[r.doc_id]))


def test_ids_decode(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert {r.doc_id: r.decoded for r in got} == texts
    assert all(r.n_tokens == len(r.ids.split(",")) for r in got if r.ids)
