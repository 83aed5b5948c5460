"""The digest queries themselves over the smallest scale, against brute force where there is one."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tickloom.llm import queries
from tickloom.llm.simhash import fingerprint

from .test_text import BASE, hamming_components, valid

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op3(spark, texts):
    ids = sorted(texts)
    fps = [fingerprint(texts[d].encode(), 3) for d in ids]
    groups = [ids[k] for k in hamming_components(fps)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()}
    assert got == {d: (f"{f:016x}", c) for d, f, c in zip(ids, fps, groups)}


def test_op5(spark, texts):
    for r in queries.op5_pii(spark, SF).collect():
        want = {k: [(m.start(), m.end()) for m in re.finditer(p, texts[r.doc_id]) if valid(k, m.group())] for k, p in BASE.items()}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in ("email", "ip", "card", "phone"))
        line = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in want[k])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert {x for x in line.split(",") if x} <= set(r.spans.split(","))


def test_op6(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids.tolist()], np.float64)
    got = {}
    for r in queries.op6_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [i for i in ids.tolist() if i % 100 == 0 and any(rows[i])]
    assert sorted(got) == asked
    hit = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        assert sorted(got[q]) == list(range(1, len(want) + 1))
        assert all(s == d[ids == v][0] for v, s in got[q].values())
        hit += len({v for v, _ in got[q].values()} & set(want)) / len(want)
    assert hit / len(asked) >= 0.9


def secret_candidates(text):
    """Spans of quoted values, passwords in URLs and long runs, from left to right, character by character."""
    run = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    out, i = [], 0
    while i < len(text):
        if text[i] in "=:":
            j = i + 1 + (text[i + 1 : i + 2] in (" ", "\t") and text[i + 1 : i + 2] != "")
            quote = text[j : j + 1]
            if quote and quote in "\"'":
                k = j + 1
                while k < len(text) and not text[k].isspace() and text[k] not in "\"'":
                    k += 1
                if text[k : k + 1] == quote and 6 <= k - j - 1 <= 512:
                    out.append((j + 1, k))
                    i = k
                    continue
        if text[i - 3 : i] == "://" and i >= 3:
            part = re.split(r"[\s/@\"']", text[i : i + 400], maxsplit=1)[0]
            if part.count(":") == 1 and 0 < part.index(":") <= 64 and text[i + len(part) : i + len(part) + 1] == "@" and 1 <= len(part) - part.index(":") - 1 <= 256:
                out.append((i + part.index(":") + 1, i + len(part)))
                i += len(part)
                continue
        if text[i] in run and (i == 0 or text[i - 1] not in run):
            k = i
            while k < len(text) and text[k] in run:
                k += 1
            if k - i >= 16:
                end = k + min(2, len(text[k:]) - len(text[k:].lstrip("=")))
                out.append((i, end))
                i = end
                continue
        i += 1
    return out


def test_op8(spark, texts):
    for r in queries.op8_secrets(spark, SF).collect():
        spans, every = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s], secret_candidates(texts[r.doc_id])
        assert r.n_candidates == len(every) and set(spans) <= set(every) and r.n_secrets == len(spans)
        planted = {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r.doc_id])}
        assert planted == set(spans)


def test_op10(spark, texts):
    got = queries.op10_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
