"""Personal data by weak supervision, with DataFrame functions only.

Candidates are spans that a pattern finds. Labelers vote on each of them: the
pattern's own check (ranges, check digits), a gazetteer of given names and of
words that are no names, and the words before the span. Votes are for (1),
against (-1) or none (0). Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, and a final classifier - a
logistic curve over votes and shape, fitted to the estimated labels - accepts
or rejects a span. Its training table has one row per kind, votes and shape, so
its size does not depend on the documents.

Spans of the base kinds (email, ip, card, phone) that pass their check are always
kept; the classifier decides about names and identity numbers.

A null or empty text has no spans. Rows that repeat are searched each by itself.
Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents, written

#: Patterns of the base kinds, in the order of results. Possessive repeats match the same
#: and need no stack; a match can't begin inside a run that an earlier start would take whole.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the kinds that the classifier decides about.
ADDED = {
    "name": r"(?<![\p{L}])(?!(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame) )\p{Lu}\p{Ll}++ \p{Lu}\p{Ll}++(?![\p{L}])",
    "id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![0-9A-Za-z-])",
}
KINDS = [*BASE, *ADDED]

#: Given names that vote for a name (fixed values).
GIVEN_NAMES = ["alice", "anna", "carlos", "charles", "daniel", "david", "elena", "emma", "hans", "james", "jane", "jean", "john", "jose", "juan", "julia", "karl", "laura", "maria", "marie", "mary", "michael", "paul", "peter", "pierre", "robert", "sarah", "sofia", "thomas", "william"]
#: Words that vote against a name (fixed values).
NO_NAMES = ["the", "this", "that", "and", "for", "der", "die", "das", "und", "les", "des", "los", "las", "una", "new", "north", "south", "united", "general", "public", "version", "apache", "license"]
#: Words before a span that vote for it (fixed values).
CUES_FOR = ["mr", "mrs", "ms", "dr", "herr", "frau", "señor", "madame", "name", "contact", "call", "phone", "tel", "email", "mail", "ssn", "iban", "passport", "card", "born"]
#: Words before a span that vote against it (fixed values).
CUES_AGAINST = ["version", "release", "section", "chapter", "page", "isbn", "serial", "build", "figure", "table"]
#: Characters before a span in which cue words are looked for.
REACH = 24

_OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, as structs of s, e (code points), v and the text before (b)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<s:int,e:int,v:string,b:string>>"
    gaps = F.split(text, pattern, -1)  # what lies between matches gives their places

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        own = F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("v"), F.right(x["gap"], F.lit(REACH)).alias("b"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.concat(acc["out"], F.array(own)).cast(kind).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def placed(hits: Column) -> Column:
        steps = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
        return F.when(F.size(hits) > 0, F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))

    # a lambda's argument is computed once, however often it is used
    return F.get(F.transform(F.array(found), placed), F.lit(0))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = d.substr(n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, v: Column) -> Column:
    """The check of a kind."""
    n = F.length(_digits(v))
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "id":
        return ~v.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    return F.lit(True)


def _any_word(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike(r"(?<![\p{L}])(?:" + "|".join(words) + r")(?![\p{L}])")


def _vote(for_: Column, against: Column) -> Column:
    return F.when(against, -1).when(for_, 1).otherwise(0)


def _judged(kind: str, x: Column) -> Column:
    """A span with the votes of the labelers and its shape."""
    fits = passes(kind, x["v"])
    if kind == "name":
        gazetteer = _vote(_any_word(x["v"], GIVEN_NAMES), _any_word(x["v"], NO_NAMES))
        pattern = F.lit(0)
    else:
        gazetteer = F.lit(0)
        pattern = F.when(fits, 1).otherwise(-1)
    context = _vote(_any_word(x["b"], CUES_FOR), _any_word(x["b"], CUES_AGAINST))
    shape = F.when(F.length(x["v"]) < 12, 0).when(F.length(x["v"]) < 24, 1).otherwise(2)
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), fits.alias("fits"), pattern.alias("p"), gazetteer.alias("g"), context.alias("c"), shape.alias("l"))


def _each(kind: str, make: Callable[[str, Column], Column]) -> Column:
    """Apply ``make(kind, span)`` to the spans of a kind."""
    return F.transform(kind, lambda x: make(kind, x))


def candidates(docs: DataFrame, *others: str) -> DataFrame:
    """Per row: the named columns (doc_id if none) and, by kind, an array of judged spans."""
    others = others or ("doc_id",)
    found = docs.select(*others, *[spans(F.col("text"), p).alias(k) for k, p in (BASE | ADDED).items()])
    return found.select(*others, *[_each(k, _judged).alias(k) for k in KINDS])


_VOTES = ("p", "g", "c")


def vote_patterns(judged: DataFrame) -> list[dict]:
    """How often each kind, vote pattern and shape occurs, of spans with a vote: at most 6 * 26 * 3 rows."""
    each = F.concat(*[_each(k, lambda k, x: F.struct(F.lit(k).alias("kind"), *[x[c].alias(c) for c in ("p", "g", "c", "l")])) for k in KINDS])
    counted = judged.select(F.explode(each).alias("x")).where("x.p <> 0 OR x.g <> 0 OR x.c <> 0").groupBy("x.kind", "x.p", "x.g", "x.c", "x.l").agg(F.count("*").alias("n"))
    return [r.asDict() for r in counted.collect()]


def reliabilities(patterns: list[dict], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation: P(vote | class) of each labeler and each pattern's P(personal).

    Starts from labelers that are right four times out of five; counts are smoothed.
    """
    chance = {(j, z): {1: 0.4 if z else 0.1, 0: 0.5, -1: 0.1 if z else 0.4} for j in _VOTES for z in (0, 1)}
    prior, soft = dict.fromkeys(BASE, 0.5) | dict.fromkeys(ADDED, 0.1), {}
    for _ in range(rounds):
        for r in patterns:
            like = [math.prod(chance[j, z][r[j]] for j in _VOTES) * (prior[r["kind"]] if z else 1 - prior[r["kind"]]) for z in (0, 1)]
            soft[tuple(r[c] for c in ("kind", *_VOTES))] = like[1] / (like[0] + like[1])
        weight = lambda r, z: r["n"] * (soft[tuple(r[c] for c in ("kind", *_VOTES))] if z else 1 - soft[tuple(r[c] for c in ("kind", *_VOTES))])
        for k in KINDS:
            own = [r for r in patterns if r["kind"] == k]
            prior[k] = (1 + sum(weight(r, 1) for r in own)) / (2 + sum(r["n"] for r in own))
        for j in _VOTES:
            for z in (0, 1):
                start = {1: 4 if z else 1, 0: 5, -1: 1 if z else 4}
                mass = {v: start[v] + sum(weight(r, z) for r in patterns if r[j] == v) for v in (1, 0, -1)}
                chance[j, z] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return chance, soft


def _features(kind, p, g, c, l) -> list:  # noqa: E741
    """Indicators of kind, votes and shape, for numbers or for columns."""
    return [kind == k for k in KINDS[1:]] + [x == v for x in (p, g, c) for v in (1, -1)] + [l == 0, l == 2]


def train(patterns: list[dict], soft: dict, steps: int = 400) -> list[float]:
    """Weights (bias first) of the span classifier, fitted to the estimated labels."""
    rows = [([1.0, *map(float, _features(r["kind"], r["p"], r["g"], r["c"], r["l"]))], soft[tuple(r[c] for c in ("kind", *_VOTES))], r["n"]) for r in patterns]
    total = sum(n for *_, n in rows) or 1
    w = [0.0] * (1 + len(KINDS) - 1 + 6 + 2)
    for _ in range(steps):
        grad = [1e-4 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for k, a in enumerate(x):
                if a:
                    grad[k] += a * (p - y) * n / total
        w = [a - 2.0 * b for a, b in zip(w, grad)]
    return w


def accepted(kind: str, x: Column, w: list[float]) -> Column:
    """Whether a labeler votes for a span and the classifier takes it, that is P(personal) > 1/2."""
    sum_ = F.lit(w[0])
    for value, weight in zip(_features(kind, x["p"], x["g"], x["c"], x["l"]), w[1:]):
        sum_ = sum_ + (F.when(value, weight).otherwise(0.0) if isinstance(value, Column) else (weight if value else 0.0))
    return (sum_ > 0) & (F.greatest(x["p"], x["g"], x["c"]) > 0)


def _kept(kind: str, w: list[float]) -> Column:
    return F.filter(kind, lambda x: x["fits"] & accepted(kind, x, w))


def learn(judged: DataFrame) -> list[float]:
    """The span classifier that the votes of all candidates give."""
    patterns = vote_patterns(judged)
    return train(patterns, reliabilities(patterns)[1])


def _decided(judged: DataFrame, w: list[float], *others: str) -> DataFrame:
    place = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    keep = {k: F.filter(k, lambda x: x["fits"]) for k in BASE} | {k: _kept(k, w) for k in ADDED}
    return judged.select(*others, *[F.transform(v, place).alias(k) for k, v in keep.items()])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data: doc_id and, by kind, an array of structs of s and e (code points, end exclusive)."""
    judged = written(candidates(documents(docs, key, text)), "candidates")
    return _decided(judged, learn(judged), "doc_id")


def listed(kinds: list[str]) -> Column:
    """kind:start:end of some kinds' spans, joined by commas."""
    return F.array_join(F.concat(*[_each(k, lambda k, x: F.concat_ws(":", F.lit(k), x["s"], x["e"])) for k in kinds]), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by its kind in angle brackets.

    All columns stay as they are but ``text``. Spans that overlap are replaced as one, from
    the first start to the last end, named by the one that starts first (at one start, the
    longer) of the base kinds, or of all if none is of a base kind.
    """
    w = learn(written(candidates(documents(docs, key, text)), "candidates"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = _decided(candidates(whole, "doc", "text"), w, "doc", "text")
    every = F.sort_array(F.concat(*[_each(k, lambda k, x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"), F.lit(k).alias("kind"))) for k in KINDS]))

    def flushed(acc: Column) -> Column:
        """The text up to the end of the union of spans that ``acc`` holds back."""
        piece = F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, acc["s"] - acc["at"]), F.lit("<"), acc["kind"], F.lit(">"))
        return F.when(acc["kind"] == "", acc["out"]).otherwise(piece)

    def step(acc: Column, x: Column) -> Column:
        own, base = -x["minus_e"], lambda c: c["kind"].isin(*BASE)
        kind = F.when(base(acc) | ~base(x), acc["kind"]).otherwise(x["kind"])
        wider = F.struct(acc["at"].alias("at"), acc["out"].alias("out"), acc["s"].alias("s"), F.greatest(acc["e"], own).alias("e"), kind.alias("kind"))
        next_ = F.struct(acc["e"].alias("at"), flushed(acc).alias("out"), x["s"].alias("s"), own.alias("e"), x["kind"].alias("kind"))
        return F.when(x["s"] < acc["e"], wider).otherwise(next_)

    def end(acc: Column) -> Column:
        return F.concat(flushed(acc), F.col("text").substr(acc["e"] + 1, F.length("text")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("kind"))
    # marks are named once here, so that a plan that inlines them searches each text once
    clean = F.when(F.col(f"doc.`{text}`").isNotNull(), F.aggregate("marks", start, step, end))
    return marked.select("doc", "text", every.alias("marks")).select(*[clean.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
