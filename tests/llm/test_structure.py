"""Infilling, periodic runs and prefix hashes against brute force on small tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import infill, periodic, prefix_hash, queries
from tickloom.llm.common import joined

from .test_text import ODD, SCHEMA, frame, prose

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, tmp_path, rows):
    """A folder whose documents are ``rows`` (doc_id, text), with a clashing extra column."""
    spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- infilling


def infilled(doc_id, text, seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


MARKED = ["a<P>b", "<", "<P", "<<P>", "<S><", "x<M", "<M>", "é<S>", "P><S", "<P<S<M", "ends in <", "日<P本>"]


@pytest.mark.parametrize("block", [infill.BLOCK, 7])
def test_infill(spark, block):
    texts = [*ODD, *MARKED, *prose(3, 12), "日本語é😀" * 300, "x" * 5000, "😀" * 90 + "<S>"]
    docs = frame(spark, texts).union(spark.createDataFrame([(3, "again", 0, 0, ""), (3, "again", 0, 0, ""), (None, "none", 0, 0, ""), (-5, "<P", 0, 0, "")], SCHEMA))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.output, r.n, r.form, r.prefix_units, r.middle_units, r.restored) for r in infill.transform(docs, block=block).collect())
    want = []
    for i, t in rows:
        n, form, pre, mid, out = infilled(i, t)
        want.append((i is None, i or 0, out, n, form, pre, mid, t or ""))
    assert got == sorted(want, key=lambda r: r[:3])
    assert {r[4] for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(docs.limit(0), block=block).collect() == []


def test_infill_by_words(spark):
    docs = frame(spark, [*ODD, *prose(4, 20)])
    for block in (infill.BLOCK, 9):
        for r in infill.transform(docs, unit="word", plain_percent=0, block=block).collect():
            text = r.restored
            starts = [m.start() for m in WORDS.finditer(text)]
            assert r.n == len(starts)
            if r.form != "plain":
                a, b = r.prefix_units, r.prefix_units + r.middle_units
                place = lambda k: starts[k] if k < len(starts) else len(text)  # noqa: B023, E731
                pre, mid, suf = text[: place(a)], text[place(a) : place(b)], text[place(b) :]
                assert r.output == (f"<P>{pre}<S>{suf}<M>{mid}" if r.form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")


def test_functions_compose_associatively():
    rule = infill.automaton()
    parts = ["a<", "S>é".encode()[:3].decode("utf-8", "ignore"), "<P", "> x"]
    f = infill.Scan(pa.array(parts), rule).whole()
    one = lambda k: infill.Functions(*(x[k : k + 1] for x in f))
    left = infill.composed(infill.composed(one(0), one(1)), infill.composed(one(2), one(3)))
    right = infill.composed(one(0), infill.composed(one(1), infill.composed(one(2), one(3))))
    whole = infill.Scan(pa.array(["".join(parts)]), rule).whole()
    for x, y, z in zip(left, right, whole):
        assert (x == y).all() and x[0, 0] == z[0, 0]


def test_op11_over_documents(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = queries.op11_infill(spark, SF)
    want = con.execute(queries.oracle_sql()["op11_infill"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# --- periodic runs


def all_runs(words, power=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


@pytest.mark.parametrize("power,least", [(4, 6), (2, 2), (3, 7), (5, 1)])
def test_runs(power, least):
    draw = random.Random(power)
    docs = []
    for size in [0, 1, 2, 5, 6, 7, 8, 9, 30, 64, 100, 257]:
        for letters in (1, 2, 3, 40):
            words = [draw.randrange(letters) for _ in range(size)]
            if size > 20 and letters == 40:
                p, a = draw.randint(1, 9), draw.randint(0, 10)
                words[a:] = [words[a + (i % p)] for i in range(size - a)]
            docs.append(words)
    docs += [[1, 2] * 4 + [3], [1] * 6, [1] * 5, [0, 0, 1] * 30 + [0, 0, 0, 0, 0, 0] + [1, 0, 0] * 9]
    offsets = np.cumsum([0, *map(len, docs)])
    got = periodic.runs(np.array(sum(docs, []), np.int64), offsets, power, least)
    for k, words in enumerate(docs):
        assert [tuple(r) for r in got[got[:, 0] == k, 1:].tolist()] == all_runs(words, power, least), words


def periodic_row(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = all_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def keyed(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_op12(spark, tmp_path):
    texts = [*ODD, *prose(8, 60), "buy now " * 40, "a " * 6, "a " * 5, "x y z " * 4 + "x y", "é 日本 " * 9, " ".join(["a", "b"] * 3 + ["c"] * 7 + ["a", "b"] * 5)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a a a a a"), (None, None), (4, "again " * 8), (4, "again " * 8)]
    got = queries.op12_periodic(spark, table(spark, tmp_path, rows))
    assert keyed(tuple(r[c] for c in COLUMNS) for r in got.collect()) == keyed(periodic_row(*r) for r in rows)
    assert periodic.collapse(frame(spark, ODD).limit(0)).collect() == []


def test_op12_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic(spark, SF).collect()
    assert keyed(tuple(r[c] for c in COLUMNS) for r in got) == keyed(periodic_row(r.doc_id, r.text) for r in docs)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_a_text_above_a_slice_has_its_runs(spark):
    text = " ".join(prose(5, 1, 150_000)) + " one two three" * 60_000 + " end"
    rows = [(7, text), (8, "x")]
    got = {r.doc_id: r for r in periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max((r.length, r.start, r.period) for r in got[7].runs) == (180_000, 150_000, 3)
    assert got[7].collapsed.endswith(" one two three end")


# --- prefix hashes


def test_spans_and_extensions():
    draw = random.Random(1)
    data = bytes(draw.choice(b"ab") for _ in range(400))
    raw = np.frombuffer(data, np.uint8)
    h = [prefix_hash.Prefixes(raw, p) for p in prefix_hash.POINTS]
    a, b, size = (np.array([draw.randrange(200) for _ in range(3000)]) for _ in range(3))
    size = size % 12
    same = (h[0].spans(a, a + size) == h[0].spans(b, b + size)) & (h[1].spans(a, a + size) == h[1].spans(b, b + size))
    assert same.tolist() == [data[x : x + n] == data[y : y + n] for x, y, n in zip(a, b, size)]
    most = 400 - np.maximum(a, b)
    want = [next((k for k in range(m) if data[x + k] != data[y + k]), m) for x, y, m in zip(a, b, most)]
    assert prefix_hash.extension(h, a, h, b, most).tolist() == want


def test_long_texts_are_hashed_block_by_block(monkeypatch):
    texts = ["", "a", *prose(9, 6, 30), "日本語" * 50]
    whole = prefix_hash.sketches(*joined(pa.array(texts)))
    other = [t[: len(t) // 2] + "!" + t[len(t) // 2 :] for t in texts]
    want = [next((k for k, (x, y) in enumerate(zip(t.encode(), o.encode())) if x != y), len(t.encode())) for t, o in zip(texts, other)]
    assert prefix_hash.common_prefix(joined(pa.array(texts)), joined(pa.array(other))).tolist() == want
    monkeypatch.setattr(prefix_hash, "BLOCK", 17)
    small = prefix_hash.sketches(*joined(pa.array(texts)))
    assert all((x == y).all() for x, y in zip(whole, small))
    assert prefix_hash.common_prefix(joined(pa.array(texts)), joined(pa.array(other))).tolist() == want


def test_words_that_agree_modulo_a_power_of_two_differ():
    """Sequences by the parity of set bits and their complements collide modulo 2**64, not modulo the prime."""
    one = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    two = bytes(195 - x for x in one)
    total, _ = prefix_hash.sketches(*joined(pa.array([one.decode(), two.decode()])))
    assert (total[0] != total[1]).all()


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(order):
        own, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        out.append((i, len(own), sha(edited), own, edited, after))
    return out


def shares(text):
    data = text.encode()
    w = min(len(data), prefix_hash.WIDTH)
    return {data[k : k + w] for k in range(len(data) - w + 1)} if data else set()


def check_rows(got, rows):
    assert keyed((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == keyed(r[:3] for r in expected(rows))
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.edited_sha256), []).append(r)
    prints = {}
    for i, _, digest, own, edited, after in expected(rows):
        r = by[i, digest][0]
        for t, f in ((own, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, f) == f
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            x, y = shares(own), shares(other)
            exact = 2 * len(x & y) / max(1, len(x) + len(y)) if own != other else 1.0
            assert 0 <= near <= 1 and abs(near - exact) < 0.25, (own, other)
            assert (near == 1.0) >= (own == other)
    assert len(set(prints.values())) == len(prints)


def test_op13(spark, tmp_path):
    rows = [(3 * i, t) for i, t in enumerate([*ODD, *prose(6, 40), "same text here", "same text here", "日本語テキスト" * 40])]
    rows += [(None, "none"), (None, None), (9, "again"), (9, "again"), (9, "other"), (-4, "least")]
    check_rows(queries.op13_fingerprints(spark, table(spark, tmp_path, rows)).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(5, "alone and unlike others")], [(5, ""), (4, None)], [(None, "x"), (None, "y")]])
def test_op13_of_few_rows(spark, tmp_path, rows):
    check_rows(queries.op13_fingerprints(spark, table(spark, tmp_path, rows)).collect(), rows)


def test_op13_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_fingerprints(spark, SF).collect()
    check_rows(got, rows)
    long = [r for r in got if r.n_chars >= 100]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.3 > np.mean([r.near_next for r in long])


def test_fingerprints(spark):
    docs = frame(spark, ODD)
    got = {r.doc_id: r for r in prefix_hash.fingerprints(docs).collect()}
    assert got[0].fingerprint == got[1].fingerprint and got[0].n_chars == 0
    assert all(got[i].n_chars == len(t or "") for i, t in enumerate(ODD))
    assert F.col is not None


# --- repeated passages whose rolling hashes agree


def test_words_with_one_rolling_hash_are_told_apart(spark):
    """Words by the parity of set bits and their complements agree under every odd base modulo 2**64."""
    from tickloom.llm import rolling, substring

    one = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    two = bytes(195 - x for x in one)
    raw = np.frombuffer(one + two, np.uint8)
    a, b = rolling.word_hashes(raw, np.array([0, 2048]), np.array([2048, 4096]), rolling.BASES[0])
    assert a == b and one != two
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{one.decode()} {rest}"), (2, f"{two.decode()} {rest}"), (3, f"x {one.decode()} {rest}")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got == {1: (50, 0), 2: (50, 0), 3: (51, 50)}
