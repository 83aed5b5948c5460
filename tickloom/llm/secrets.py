"""Secret scans with a random forest that removes false findings.

Candidates are runs of 16 or more key-like characters, values of 6 or more characters in
quotes after an equals sign or colon, and passwords in URLs. Their features are
length, how often neighbouring characters change class, how rare their letter pairs
are among all letter pairs of the corpus, how much of them common words cover,
whether they stand in a path or URL, and the words before them. A random forest
trained from labelled findings accepts or rejects each.

The labelled findings are of two sorts, each in a stated number at most: made by rule, and
ordinary candidates of the table itself: bare words and numbers between spaces, which are no
secrets. ``quality`` measures on ids that the training leaves out (see ``held_out``): none are such
words and numbers, secrets are values of a published key form and values between quotes
assigned to a name for secrets (the training sees none of these from the table).

A null or empty text has no candidates. Rows that repeat are scanned each by
itself. A row with a null id is scanned, and takes part in the training. Extra columns
are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, joined, slices, written

#: Labelled findings made by rule, and at most so many bare words and numbers of the table, that the forest is trained from.
FINDINGS = 4_000
OWN_FINDINGS = 4_000
#: A password in a URL, a value in quotes, or a run of key characters (groups 1, 3 and 4).
CANDIDATE = re.compile(r"""(?<=://)[^\s/:@"']{1,64}:([^\s/:@"']{1,256})(?=@)|[=:][ \t]?(["'])([^\s"']{6,512})(?=\2)|(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,}={0,2})""")
#: Words before a finding that speak for a secret, and against (fixed values).
CUES_FOR = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "credential", "auth", "bearer")
CUES_AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "revision", "isbn", "card", "version", "etag", "hash")
#: Common parts of words and identifiers (fixed values).
DICTIONARY = ("the", "and", "ing", "tion", "ment", "ent", "ver", "con", "pro", "ter", "ies", "ción", "mente", "ado", "que", "eux", "keit", "heit", "lich", "schaft", "ein", "sch", "get", "set", "test", "main", "index", "user", "name", "file", "path", "data", "value", "list", "build", "src", "lib", "http", "www", "com", "org", "html", "example", "mail", "class", "function", "return")
#: Characters before a candidate in which cue words are looked for.
REACH = 24

#: A user name of a URL before its password.
_USER = re.compile(r"://[^\s/@]*:$")
#: Published forms of access keys (fixed values).
KEY_FORM = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}")
#: The name that a value is assigned to, right before the sign.
_NAME = re.compile(r"[A-Za-z0-9_]+(?=\s*$)")
#: Times that the pairs of the dictionary count beside those of the corpus.
PRIOR = 8
_PARTS = re.compile("|".join(sorted(map(re.escape, DICTIONARY), key=len, reverse=True)))
_LETTERS = np.full(256, 26, np.int64)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(26)
_WORDS = re.compile(r"[a-z0-9_]+")
FEATURES = ("length", "transitions", "digits", "upper", "entropy", "dictionary", "path", "cue_for", "cue_against", "hex", "numeric", "rarity", "credential")


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each letter (A-Z folded) follows each other one in all texts, 26 by 26."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(27 * 27, np.int64)
        for part in slices(batches):
            raw, begin = joined(part.column("text"))
            kind = _LETTERS[raw]
            pair = kind[:-1] * 27 + kind[1:]
            # no pair where one text meets the next
            inner = begin[(begin > 0) & (begin < len(raw))]
            pair[inner - 1] = 27 * 27 - 1
            count += np.bincount(pair, minlength=27 * 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count).astype(np.int32)), pa.array(count[count > 0])], names=["pair", "n"])

    out = np.zeros(27 * 27)
    for r in docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 729 rows at most
        out[r["pair"]] = r["n"]
    return out.reshape(27, 27)[:26, :26]


def pair_rarity(counts: np.ndarray | None = None) -> np.ndarray:
    """Bits that a letter takes after another: of the corpus counts, the dictionary and one of each pair."""
    own = np.ones((26, 26)) if counts is None else counts + 1.0
    for part in DICTIONARY:
        at = [ord(c) - 97 for c in part if "a" <= c <= "z"]
        for x, y in zip(at, at[1:]):
            own[x, y] += PRIOR
    return -np.log2(own / own.sum(1, keepdims=True))


def features(value: str, before: str, after: str, rarity: np.ndarray) -> list[float]:
    """Numbers in the order of FEATURES; ``rarity``: as ``pair_rarity`` gives it."""
    n = len(value)
    kinds = [_class(c) for c in value]
    low = value.lower()
    entropy = -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value)))
    covered = sum(len(m) for m in _PARTS.findall(low))
    pairs = [rarity[ord(x) - 97, ord(y) - 97] for x, y in zip(low, low[1:]) if "a" <= x <= "z" and "a" <= y <= "z"]
    near = _WORDS.findall(before.lower())[-3:]
    path = value.count("/") > 1 or before[-1:] in ("/", "\\", ".") or after[:1] in ("/", "\\")
    return [
        float(n),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        kinds.count(0) / n,
        kinds.count(2) / n,
        entropy,
        covered / n,
        float(path),
        float(any(w in CUES_FOR for w in near)),
        float(any(w in CUES_AGAINST for w in near)),
        float(all(c in "0123456789abcdef" for c in low)),
        float(value.isdigit()),
        float(sum(pairs) / len(pairs)) if pairs else math.log2(26),
        float(bool(_USER.search(before))),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Findings made by rule: value, text before, text after, and 1 if a secret. Half are secrets."""
    draw = random.Random(seed)
    some = lambda letters, a, b: "".join(draw.choice(letters) for _ in range(draw.randint(a, b)))
    lower, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    base62 = lower + lower.upper() + digit
    word = lambda: "".join(draw.choice(DICTIONARY[:22]) for _ in range(draw.randint(4, 9)))
    rows = []
    for k in range(n):
        cue = draw.choice(CUES_FOR) + draw.choice(("=", ": ", ' = "', " "))
        against = draw.choice(CUES_AGAINST) + draw.choice((" ", ": ", "="))
        plain = draw.choice(("the of ", "and in ", "de la ", "is a ", "", "see "))
        assigned = draw.choice(CUES_FOR) + draw.choice((' = "', '="', ": '", "='"))
        other = draw.choice(("class", "name", "title", "lang", "href", "id", "type", "label", "mode")) + draw.choice((' = "', '="', ": '", "='"))
        if k % 2 == 0:
            made = [("AKIA" + some(lower.upper() + digit, 16, 16), draw.choice((plain, cue))), (some(hexa, 16, 64), cue), (some(hexa, 16, 64), assigned), (some(base62, 20, 64), draw.choice((plain, cue))), (some(base62 + "+/", 32, 80) + "=", cue), ("ghp_" + some(base62, 36, 36), draw.choice((plain, cue))), (some(base62 + "!#$%&*", 8, 15), assigned), (some(base62 + "!#$%", 6, 20), draw.choice(("http", "ftp", "postgres", "amqp")) + "://" + some(lower, 3, 9) + ":")]
            rows.append((*draw.choice(made), draw.choice((" ", '"', "\n", "")), 1))
        else:
            made = [(word(), plain), (word().capitalize(), draw.choice((plain, cue))), (word().upper(), draw.choice((plain, "!! "))), (some(hexa, 32, 64), against), (some(digit, 16, 19), draw.choice((plain, "card "))), ("/".join(word() for _ in range(3)), "http://example.com/"), (word()[:30], other), (f"{some(hexa, 8, 8)}-{some(hexa, 4, 4)}-{some(hexa, 12, 12)}", draw.choice((plain, against))), ("_".join(word() for _ in range(2)), plain)]
            rows.append((*draw.choice(made), draw.choice((" ", ".", "\n", "")), 0))
    return rows


def held_out(key: str = "doc_id") -> Column:
    """Rows that the training leaves out: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


_FOUND = "array<struct<s:int,e:int,label:int,f:array<double>>>"


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]], rarity: np.ndarray | None = None, own: DataFrame | None = None) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, after, label) and from ``own``, candidates of texts.

    Of those in ``own`` (row, doc_id, s, label, f) that are no secrets at most OWN_FINDINGS are taken, least hash of doc_id and place first.
    """
    rarity = pair_rarity() if rarity is None else rarity
    rows = [(features(v, b, a, rarity), float(y)) for v, b, a, y in findings]
    table = spark.createDataFrame(rows, "f array<double>, label double")
    if own is not None:
        known = own.where((F.col("label") == 0) & ~held_out())
        table = table.union(known.orderBy(F.xxhash64("doc_id", "s"), "row", "s").limit(OWN_FINDINGS).select("f", F.col("label").cast("double")))
    table = table.select(array_to_vector("f").alias("features"), "label").coalesce(1)
    return RandomForestClassifier(numTrees=40, maxDepth=8, seed=11).fit(table)


def _label(text: str, m: re.Match) -> int | None:
    """1 for a value of a published key form or one between quotes that is assigned to a name for secrets, 0 for a word or
    number between spaces with no equals sign or colon before it, None for others."""
    value = m.group(3) or m.group(4)
    if value and KEY_FORM.fullmatch(value):
        return 1
    if m.group(3) is not None:
        named = _NAME.search(text[max(0, m.start() - REACH) : m.start()])
        return 1 if named and named.group().lower() in CUES_FOR else None
    if not value or not (value.isalpha() or value.isdigit()):
        return None
    before, after = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 1]
    return 0 if before[-1:] in ("", " ", "\n") and before[:1] not in ("=", ":") and after in ("", " ", "\n", ",", ".", "!") else None


def candidates(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Per row: a row number, doc_id and an array of structs of s, e (code points), label (may be null) and f (features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            found = []
            for text in part.column("text").to_pylist():
                at = [(m, *m.span(1 if m.group(1) is not None else 3 if m.group(3) is not None else 4)) for m in CANDIDATE.finditer(text)]
                found.append([{"s": s, "e": e, "label": _label(text, m), "f": features(text[s:e], text[max(0, s - REACH) : s], text[e : e + 1], rarity)} for m, s, e in at])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.int32()), ("f", pa.list_(pa.float64()))]))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + part.num_rows), pa.int64()), part.column("doc_id"), pa.array(found, kind)], names=["row", "doc_id", "found"])
            row += part.num_rows

    return docs.mapInArrow(run, f"row long, doc_id long, found {_FOUND}")


def _each(rows: DataFrame) -> DataFrame:
    return rows.select("row", "doc_id", F.explode("found").alias("x")).select("row", "doc_id", "x.*")


def _judged(docs: DataFrame, model: RandomForestClassificationModel | None) -> tuple[DataFrame, DataFrame]:
    """Candidates per row, and each candidate with its probability p."""
    # read for the pairs, and again for the candidates
    rarity = pair_rarity(pair_counts(docs))
    rows = written(candidates(docs, rarity), "candidates")
    model = model or train(docs.sparkSession, labelled_findings(), rarity, _each(rows))
    judged = model.transform(_each(rows).withColumn("features", array_to_vector("f")))
    return rows, judged.select("row", "doc_id", "s", "e", "label", vector_to_array("probability")[1].alias("p"))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings per document: doc_id, n_candidates, secrets (structs of s and e, code points, end exclusive).

    ``model``: as ``train`` gives it, with the rarities of these texts; trained here if there is none.
    """
    rows, judged = _judged(documents(docs, key, text), model)
    secrets = judged.where(F.col("p") >= threshold).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("secrets"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return rows.select("row", "doc_id", F.size("found").cast("long").alias("n_candidates")).join(secrets, "row", "left").select("doc_id", "n_candidates", F.coalesce("secrets", none).alias("secrets"))


def quality(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Held-out figures, one row: n_secrets and n_others (by label), found, wrong, precision and recall (null without any)."""
    _, judged = _judged(documents(docs, key, text), model)
    good, hit = F.col("label") == 1, F.col("p") >= threshold
    out = judged.where(held_out() & F.col("label").isNotNull()).agg(F.count_if(good).alias("n_secrets"), F.count_if(~good).alias("n_others"), F.count_if(good & hit).alias("found"), F.count_if(~good & hit).alias("wrong"))
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n))
    return out.withColumn("hits", F.col("found") + F.col("wrong")).select("n_secrets", "n_others", "found", "wrong", share("found", "hits").alias("precision"), share("found", "n_secrets").alias("recall"))
