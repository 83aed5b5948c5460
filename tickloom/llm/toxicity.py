"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of the bytes inside words, with
the seven bytes before each as its context, so what it gathers grows with the
labelled texts. Counts are tables of Spark: one row a sequence. Both models back
off to the same lower orders, built over 32 classes of symbols from how many
contexts a sequence follows in either class, so an expression too rare to tell
apart gets the same likelihood from both. So does what follows a context that no
toxic text holds: there neither model goes beyond the lower orders. A document has the length-normalised
log-likelihood ratio of its most toxic span (a few bytes of one word), that of the
whole text, and power means of its words' highest ratios, which grow with each
toxic expression; a logistic curve over these gives the score. The curve is
fitted to ratios of models that had not seen the document: learning rows are
dealt into two folds, each scored by the other's.

The most frequent contexts, with all that follows them (``HEAD`` sequences at most),
are broadcast and score most words while texts are read; a filter of ``FILTER`` bits
tells most contexts that the model does not hold. The distinct words with any context
that may be among the rest meet the other contexts in a join, and go back to their documents: by
broadcast the few that many documents hold, by a shuffle the others. Only rows that the
curve may be fitted to are scored by the model of a fold, all by that of both. Ratios are
multiples of 2**-16, so that sums do not depend on their order.

Counts are taken over all learning rows, a word once a document. Filters of the labelled
ids find the learning rows, so that texts are not shuffled; distinct words are summed
before their sequences are. The curve alone is fitted to at most
``CURVE_ROWS`` of them.

A null text is empty; a text without words has ratios zero. Rows that repeat are
scored each by itself. Labels that repeat an id count as toxic if one is; null
labels and labels without a document are ignored. If one class has no learning
rows, every ratio is zero. Extra columns are dropped; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents, forget, joined, lowered_words, mix64, slices, written

#: Learning rows that the curve is fitted to at most: those whose id hashes lowest.
CURVE_ROWS = 20_000
#: Bytes that a count spans.
ORDER = 8
#: Symbol classes of the shared lower orders, and symbols that their counts span.
SYMBOLS, LOWER = 32, 4
#: Bytes of a word whose likelihoods are compared at a time.
SPAN = 8
#: Power of a word's highest ratio in the evidence of a text: few strong words outweigh many weak ones.
POWER = 4
#: Sequences that are broadcast at most.
HEAD = 1 << 20
#: Bits of the filters of labelled ids (ordinary, toxic, mistaken) and of the contexts that are not broadcast. Fuller, they let more through to the joins.
FILTER = 1 << 26
#: Tail words that more than one in so many rows hold are broadcast.
HOT = 1 << 17
#: Distinct sequences that a counting task holds before it hands them on.
HELD = 1 << 20
#: Ratios are multiples of one over this.
GRAIN = 1 << 16

#: Class by byte: 0 stands between words.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[192:] = 28 + np.arange(64) % 2
_SYMBOL[128:192] = 30 + np.arange(64) % 2
#: Bytes that share a class, evenly.
_SHARE = np.array([1, *[1] * 26, 10, 32, 32, 32, 32], float)

#: Counts by fold and class, and the models: what they sum for either class.
COUNTS = ["o0", "t0", "o1", "t1"]
WORDS = "word string, " + ", ".join(f"{c} long" for c in COUNTS)
MODELS = [(["o0"], ["t0"]), (["o1"], ["t1"]), (["o0", "o1"], ["t0", "t1"])]
RATIOS, EXITS = ["r0", "r1", "r2"], ["e0", "e1", "e2"]
#: What words add up to in a text, and what the curve takes from that: the highest ratio of a
#: span, the mean ratio of a byte, and the evidence of all words, whole and by length.
SUMS = ["peak", "sum", "power"]
PARTS = [f"{what}{k}" for k in range(len(MODELS)) for what in SUMS]
FEATURES = ["peak", "mean", "strong", "dense"]
#: What a row is scored by: the model of the fold it is not in, if the curve may be fitted to it, and that of both folds.
SIDES = ["other", "both"]


def held_out(key: Column) -> Column:
    """Rows that labels are not learnt from."""
    return F.crc32(key.cast("string")) % 3 == 1


def fold(key: Column) -> Column:
    """The fold of a learning row: 0 or 1."""
    return F.when(F.crc32(key.cast("string")) % 3 == 0, 0).otherwise(1)


class Sequences:
    """Byte sequences of words: ``codes`` (eight bytes each, the predicted one last; zero
    before and after the word) and ``starts`` (where each word's codes begin)."""

    def __init__(self, words: pa.Array) -> None:
        raw, bounds = joined(words)
        size, pad = np.diff(bounds), ORDER - 1
        line = np.zeros(int((size + pad).sum()) + pad, np.uint64)
        first = np.cumsum(size + pad) - size
        line[np.arange(len(raw)) - np.repeat(bounds[:-1], size) + np.repeat(first, size)] = raw
        # each byte of a word is predicted, and the zero that ends it
        self.starts = np.cumsum(size + 1) - size - 1
        at = np.arange(int((size + 1).sum())) + np.repeat(first - self.starts, size + 1)
        self.codes = np.zeros(len(at), np.uint64)
        for back in range(pad, -1, -1):
            self.codes = (self.codes << np.uint64(8)) | line[at - back]
        self.sizes = size + 1

    def scores(self, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest sum over a span, sum, and what the word adds to its text's evidence, from a ratio for each code."""
        if not len(self.starts):
            return np.zeros(0), np.zeros(0), np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        at = np.arange(len(ratio))
        begin = np.maximum(at - SPAN + 1, np.repeat(self.starts, self.sizes))
        peak = np.maximum.reduceat(total[1:] - total[begin], self.starts)
        return peak, np.add.reduceat(ratio, self.starts), np.round(np.maximum(peak, 0) ** POWER)


def discount(one: int, two: int) -> float:
    """What is taken off each count, from how many counts are one and two."""
    return one / (one + 2 * two) if one and two else 0.5


def _interpolate(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted counts by context, topped up from the lower order; rows are contexts."""
    d = discount(int((counts == 1).sum()), int((counts == 2).sum()))
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    below = np.tile(lower, (len(counts) // len(lower), 1))  # a context's last symbols index the lower order
    return np.where(total > 0, (np.maximum(counts - d, 0) + d * kinds * below) / np.maximum(total, 1), below)


def shared_orders(seen: np.ndarray) -> np.ndarray:
    """Likelihood of a symbol class after two others, from which sequences of four occur."""
    seen = seen.reshape(SYMBOLS, -1)
    shared = np.full((1, SYMBOLS), 1 / SYMBOLS)
    kinds = seen.sum(0)  # contexts that a sequence of three symbols follows
    for order in range(1, LOWER):
        shared = _interpolate(kinds.reshape(SYMBOLS ** (LOWER - 1 - order), -1, SYMBOLS).sum(0), shared)
    return shared


def short(codes: np.ndarray, n: int = LOWER) -> np.ndarray:
    """The classes of the last ``n`` bytes of codes, as one number."""
    value = np.zeros(len(codes), np.int64)
    for back in range(n - 1, -1, -1):
        value = value * SYMBOLS + _SYMBOL[((codes >> np.uint64(8 * back)) & np.uint64(255)).astype(np.int64)]
    return value


def _bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter for each value."""
    mixed = mix64(values)
    return (mixed & np.uint64(FILTER - 1)).astype(np.int64), (mixed >> np.uint64(32) & np.uint64(FILTER - 1)).astype(np.int64)


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be one that a filter was made of."""
    one, two = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in _bits(values))
    return one & two


def bit_filter(values: DataFrame) -> np.ndarray:
    """A filter of the values of a table's only column, of FILTER bits at any size."""
    (name,), parts = values.columns, 1024

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER // 8, np.uint8)
        for b in batches:
            for at in _bits(b.column(name).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        bits = bits.reshape(parts, -1)
        some = np.flatnonzero(bits.any(1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(some), "bits": pa.array([bits[k].tobytes() for k in some], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([both.tobytes()], pa.binary())})

    found = np.zeros((parts, FILTER // 8 // parts), np.uint8)
    # FILTER bits at most
    for r in values.mapInArrow(mark, "part long, bits binary").groupBy("part").applyInArrow(merge, "part long, bits binary").toLocalIterator():
        found[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return found.ravel()


def learnt_labels(labels: DataFrame) -> DataFrame:
    """Labels that are learnt from: doc_id, toxic (the highest of an id)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    return written(known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "known")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that a label would be learnt from."""
    return docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).withColumn("doc_id", F.col("doc_id").cast("long"))


def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each fold and class hold each word, from their text, toxic and fold; a word may come again."""
    for part in slices(batches):
        _, found = lowered_words(part.column("text"))
        kind = part.column("fold").to_numpy() * 2 + (part.column("toxic").to_numpy() > 0)
        coded = found.values.dictionary_encode()
        doc = np.repeat(np.arange(part.num_rows), np.diff(found.offsets))
        # a word counts once a document, however often a text repeats it
        doc, of = np.divmod(np.unique(doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy()), max(1, len(coded.dictionary)))
        times = np.bincount(of * 4 + kind[doc], minlength=4 * len(coded.dictionary)).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *[pa.array(times[:, k]) for k in range(4)]], names=["word", *COUNTS])


def learning_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Words of labelled rows that are not held out: word, o0, t0, o1, t1, as ``spelt`` gives them.

    Filters of the ordinary and the toxic ids tell the label of a text while it is read.
    Ids alone are joined with the labels, to find those that the filters take for others.
    Texts of such ids are joined with the labels too: few, until the filters fill.
    """
    spark, some, texts = docs.sparkSession, learnable(docs).select("doc_id"), learnable(docs).select("doc_id", fold(F.col("doc_id")).alias("fold"), "text")
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    filters = spark.sparkContext.broadcast([bit_filter(known.where(F.col("toxic") == k).select("doc_id")) for k in (0, 1)])

    def guess(ids: np.ndarray) -> np.ndarray:
        """Label by the filters; -1 is none."""
        ordinary, toxic = (may_hold(bits, ids) for bits in filters.value)
        return np.where(toxic, 1, np.where(ordinary, 0, -1)).astype(np.int32)

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = guess(b.column("doc_id").to_numpy().view(np.uint64))
            yield b.append_column("guess", pa.array(kind)).filter(pa.array(kind >= 0))

    ids = some.mapInArrow(guessed, "doc_id long, guess int")
    # sorted and merged at every size: labels grow with the documents
    wrong = ids.join(known.hint("merge"), "doc_id", "left").where(~F.col("guess").eqNullSafe(F.col("toxic")))
    mistaken = bit_filter(wrong.select("doc_id"))
    doubt = spark.sparkContext.broadcast(mistaken)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("doc_id").to_numpy().view(np.uint64)
            kind = np.where(may_hold(doubt.value, key), -1, guess(key)).astype(np.int32)
            yield b.append_column("toxic", pa.array(kind)).filter(pa.array(kind >= 0))

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(doubt.value, b.column("doc_id").to_numpy().view(np.uint64))))

    # one Python worker a task tells labels and parts words
    found = texts.mapInArrow(lambda batches: spelt(sure(batches)), WORDS)
    if mistaken.any():
        found = found.unionByName(texts.mapInArrow(doubtful, "doc_id long, fold int, text string").join(known.hint("merge"), "doc_id").mapInArrow(spelt, WORDS))
    return found


def count(words: DataFrame) -> DataFrame:
    """How often each sequence occurs in each fold and class: code, o0, t0, o1, t1."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        n = np.concatenate([n for _, n in held])
        return code, np.column_stack([np.bincount(at, n[:, k], len(code)) for k in range(4)]).astype(np.int64)

    def batch(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *[pa.array(n[:, k]) for k in range(4)]], names=["code", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "word"):
            own = Sequences(part.column("word"))
            held.append((own.codes, np.repeat(np.column_stack([part.column(c).to_numpy() for c in COUNTS]), own.sizes, axis=0)))
            size += len(own.codes)
            if size > HELD:
                code, n = merged(held)
                held, size = [(code, n)], len(code)
                if size > HELD // 2:
                    yield batch(code, n)
                    held, size = [], 0
        if held:
            yield batch(*merged(held))

    kinds, sums = ", ".join(f"{c} long" for c in COUNTS), [F.sum(c).alias(c) for c in COUNTS]
    # words are summed first: a frequent one gives its sequences once, not in every task that reads it
    each = words.groupBy("word").agg(*sums).mapInArrow(run, f"code long, {kinds}")
    context = F.shiftrightunsigned("code", 8)
    # one shuffle, which carries no context, serves both groupings; a context has at most 256 sequences
    summed = each.repartition(context).withColumn("context", context).groupBy("context", "code").agg(*sums)
    return summed.groupBy("context").agg(F.collect_list(F.struct("code", *COUNTS)).alias("seen"))


class Model(NamedTuple):
    """``contexts``: those that toxic texts hold, with context, level (bits of its count), e0, e1, e2 (log-likelihood ratios, toxic
    over ordinary, of a byte never seen after it, by the models of fold 0, fold 1 and both) and
    seen (code, r0, r1, r2: those of the sequences seen); ``head``: the lowest level to broadcast."""

    contexts: DataFrame
    head: int


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Codes of a batch of contexts, their counts by side (ordinary and toxic of each model), where each context begins."""
    seen = batch.column("seen")
    flat = seen.flatten()
    of = {c: flat.field(c).to_numpy() for c in COUNTS}
    size = pc.list_value_length(seen).to_numpy()
    return flat.field("code").to_numpy().view(np.uint64), [sum(of[c] for c in side) for model in MODELS for side in model], np.cumsum(size) - size


def fit(rows: DataFrame) -> Model:
    """The ratio of each sequence of the learning rows: of their texts (text, toxic, fold) or of words that ``spelt`` has made of them."""
    counts = written(count(rows if "word" in rows.columns else rows.mapInArrow(spelt, WORDS)), "counts")
    table = SYMBOLS**LOWER

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sides, levels = np.zeros((2, table), np.int64), np.zeros((6, 3), np.int64), np.zeros(65, np.int64)
        for b in batches:
            code, n, begin = _flat(b)
            if not len(code):
                continue
            at = short(code)
            for k in range(2):
                seen[k, at[n[2 * k] + n[2 * k + 1] > 0]] = 1
            sides += [[(x == 1).sum(), (x == 2).sum(), x.sum()] for x in n]
            of = np.frexp(np.add.reduceat(n[4] + n[5], begin))[1]
            levels += np.bincount(of, np.diff(np.append(begin, len(code))) * (np.add.reduceat(n[5], begin) > 0), 65).astype(np.int64)
        every = np.concatenate([seen.ravel(), sides.ravel(), levels])
        yield pa.RecordBatch.from_pydict({"at": np.flatnonzero(every), "n": every[every > 0]})

    every = np.zeros(2 * table + 18 + 65, np.int64)
    # at most 2 * 32**4 + 83 rows
    for r in counts.mapInArrow(survey, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        every[r["at"]] = r["n"]
    seen = every[: 2 * table].reshape(2, -1) > 0
    sides, levels = every[2 * table : 2 * table + 18].reshape(6, 3), every[-65:]
    taken = [discount(int(one), int(two)) for one, two, _ in sides]
    usable = [sides[2 * m, 2] > 0 and sides[2 * m + 1, 2] > 0 for m in range(len(MODELS))]
    fits = np.flatnonzero(np.cumsum(levels[::-1])[::-1] <= HEAD)
    shared = [shared_orders(x).ravel() for x in (seen[0], seen[1], seen[0] | seen[1])]
    held = rows.sparkSession.sparkContext.broadcast(shared)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n, begin = _flat(b)
            if not len(code):
                continue
            per, ratio, gone = np.diff(np.append(begin, len(code))), [], []
            for m in range(len(MODELS)):
                below = held.value[m][short(code, LOWER - 1)] / _SHARE[short(code, 1)]
                log, left = [], []
                for k in (2 * m, 2 * m + 1):
                    total, kinds = np.add.reduceat(n[k], begin), np.add.reduceat((n[k] > 0).astype(np.int64), begin)
                    rest = np.where(total > 0, taken[k] * kinds / np.maximum(total, 1), 1.0)
                    left.append(np.log(rest))
                    log.append(np.log(np.maximum(n[k] - taken[k], 0) / np.maximum(np.repeat(total, per), 1) + np.repeat(rest, per) * below))
                met = usable[m] & (total > 0)  # by toxic texts
                ratio.append(np.round((log[1] - log[0]) * GRAIN * np.repeat(met, per)) / GRAIN)
                gone.append(np.round((left[1] - left[0]) * GRAIN * met) / GRAIN)
            level = np.frexp(np.add.reduceat(n[4] + n[5], begin))[1].astype(np.int32)
            follow = pa.StructArray.from_arrays([pa.array(code.view(np.int64)), *[pa.array(x) for x in ratio]], names=["code", *RATIOS])
            at = pa.array(np.append(begin, len(code)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("context"), pa.array(level), *[pa.array(x) for x in gone], pa.ListArray.from_arrays(at, follow)], names=["context", "level", *EXITS, "seen"])

    kinds = "context long, level int, " + ", ".join(f"{e} double" for e in EXITS) + ", seen array<struct<code: long, r0: double, r1: double, r2: double>>"
    toxic = F.exists("seen", lambda x: x["t0"] + x["t1"] > 0)
    contexts = written(counts.where(toxic).mapInArrow(weigh, kinds), "contexts")
    forget(rows.sparkSession, counts)
    return Model(contexts, int(fits[0]))


class Head:
    """Ratios of frequent contexts and what follows them, and a filter of the other contexts."""

    def __init__(self, rows: pa.Table, others: np.ndarray) -> None:
        self.others = others
        rows = rows.combine_chunks()
        context = rows.column("context").to_numpy().view(np.uint64)
        flat = pc.list_flatten(rows.column("seen")).combine_chunks()
        code = flat.field("code").to_numpy().view(np.uint64)
        # single precision is exact: multiples of 2**-16 below 2**8
        of = lambda columns, order: np.column_stack([c.to_numpy() for c in columns]).astype(np.float32)[order]
        order = np.argsort(context)
        self.contexts, self.exits = context[order], of([rows.column(e) for e in EXITS], order)
        order = np.argsort(code)
        self.codes, self.ratios = code[order], of([flat.field(r) for r in RATIOS], order)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the ratios of codes are sure, and what they are (zero for others)."""
        known, ratio = ~may_hold(self.others, codes >> np.uint64(8)), np.zeros((len(codes), len(RATIOS)))
        if not len(self.contexts) or not len(codes):
            return known, ratio
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        seen = self.codes[at] == codes
        known |= seen
        ratio[seen] = self.ratios[at[seen]]
        rest = np.flatnonzero(~seen)
        context = codes[rest] >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        exits = self.contexts[at] == context
        known[rest[exits]] = True
        ratio[rest[exits]] = self.exits[at[exits]]
        return known, ratio


def _scan(docs: DataFrame, head: Broadcast) -> DataFrame:
    """Per row: doc_id, other, row, size and sums by side over words of frequent contexts, other words and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, found = lowered_words(part.column("text"))
            coded = found.values.dictionary_encode()
            of, kinds = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            own = Sequences(coded.dictionary)
            known, ratio = head.value.of(own.codes)
            whole = np.logical_and.reduceat(known, own.starts) if len(own.starts) else np.zeros(0, bool)
            doc = np.repeat(np.arange(part.num_rows), np.diff(found.offsets))
            inside = whole[of]
            size = np.bincount(doc[inside], own.sizes[of[inside]], part.num_rows).astype(np.int64)
            cols, other = [], pc.fill_null(part.column("other"), -1).to_numpy()
            for model in (other, np.full(part.num_rows, 2)):
                best, sums = np.full(part.num_rows, -np.inf), np.zeros((2, part.num_rows))
                for k in np.unique(model[model >= 0]):
                    peak, *more = own.scores(ratio[:, k])
                    use = inside & (model == k)[doc]
                    np.maximum.at(best, doc[use], peak[of[use]])
                    sums += [np.bincount(doc[use], x[of[use]], part.num_rows) for x in more]
                cols += [pa.array(best), *[pa.array(x) for x in sums]]
            key, times = np.unique(doc[~inside] * kinds + of[~inside], return_counts=True)
            at = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * kinds), pa.int32())
            words = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(key % kinds)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("other"), part.column("row"), pa.array(size), *cols, words, pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64)))],
                names=["doc_id", "other", "row", "size", *names, "words", "times"],
            )

    names = [f"{what}_{side}" for side in SIDES for what in SUMS]
    kinds = "doc_id long, other int, row long, size long, " + ", ".join(f"{n} double" for n in names) + ", words array<string>, times array<long>"
    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, kinds)


def _tail_words(words: DataFrame, model: Model, head: Broadcast) -> DataFrame:
    """Size and parts of words with rare or unseen contexts: word, size, parts. A fold's model gives zeros for words that no row needs it for."""
    needs = ["need0", "need1"]

    def open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word"):
            own = Sequences(part.column("word"))
            free = np.flatnonzero(~head.value.of(own.codes)[0])
            word = np.searchsorted(own.starts, free, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(pa.array(word)) for c in ("word", *needs)], pa.array((free - own.starts[word]).astype(np.int32)), pa.array(own.codes[free].view(np.int64))], names=["word", *needs, "at", "code"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word"):
            own, filled = Sequences(part.column("word")), part.column("filled")
            flat, per = filled.flatten(), pc.list_value_length(filled).to_numpy()
            place = flat.field("at").to_numpy() + np.repeat(own.starts, per)
            ratio = head.value.of(own.codes)[1]
            for k, name in enumerate(RATIOS):
                ratio[place, k] = flat.field(name).to_numpy()
            for k, need in enumerate(needs):
                ratio[:, k] *= np.repeat(part.column(need).to_numpy(zero_copy_only=False), own.sizes)
            cols = [pa.array(x) for k in range(len(MODELS)) for x in own.scores(ratio[:, k])]
            yield pa.RecordBatch.from_arrays([part.column("word"), pa.array(own.sizes), *cols], names=["word", "size", *PARTS])

    free = words.select("word", *needs).mapInArrow(open_places, "word string, " + ", ".join(f"{n} boolean" for n in needs) + ", at int, code long")
    # a place is open only if its context is not broadcast; every word has one, and stays without any learnt context
    rare = model.contexts.where(F.col("level") < model.head).drop("level")
    met = free.join(rare.hint("merge"), F.shiftrightunsigned("code", 8) == F.col("context"), "left").withColumn("hit", F.get(F.filter("seen", lambda x: x["code"] == F.col("code")), F.lit(0)))
    asked = [*map(F.col, needs), F.lit(True)]
    places = met.select("word", *needs, "at", *[F.when(n, F.coalesce(f"hit.{r}", e, F.lit(0.0))).otherwise(0.0).alias(r) for n, r, e in zip(asked, RATIOS, EXITS)])
    filled = places.groupBy("word").agg(*[F.max(n).alias(n) for n in needs], F.collect_list(F.struct("at", *RATIOS)).alias("filled"))
    return filled.mapInArrow(add, "word string, size long, " + ", ".join(f"{p} double" for p in PARTS))


def ratios(docs: DataFrame, model: Model) -> DataFrame:
    """The features of each row by either side: doc_id, peak_other, mean_other and so on, peak_both and so on.

    ``docs`` has the columns doc_id, text and other: the fold whose model has not seen the row, null where it is not asked for.
    """
    spark = docs.sparkSession
    rare = bit_filter(model.contexts.where(F.col("level") < model.head).select("context"))
    head = spark.sparkContext.broadcast(Head(model.contexts.where(F.col("level") >= model.head).toArrow(), rare))
    scanned = written(_scan(docs, head), "scanned")
    tails = scanned.select("row", "other", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "other", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    needs = [F.coalesce(F.max(F.col("other") == k), F.lit(False)).alias(f"need{k}") for k in (0, 1)]
    words = written(tails.groupBy("word").agg(F.count("*").alias("rows"), *needs), "tail-words")
    parts = written(_tail_words(words, model, head), "tail-parts")
    # fewer than HOT words pass
    limit = (words.agg(F.sum("rows")).first()[0] or 0) / HOT
    often = words.where(F.col("rows") > limit).select("word", F.lit(True).alias("often"))
    tails = tails.join(F.broadcast(often), "word", "left")
    hot = parts.join(F.broadcast(often.select("word")), "word", "left_semi")
    met = tails.where("often").join(F.broadcast(hot), "word").unionByName(tails.where("often IS NULL").join(parts.hint("merge"), "word")).drop("often")
    by = {"other": lambda what: F.when(F.col("other") == 0, F.col(f"{what}0")).when(F.col("other") == 1, F.col(f"{what}1")), "both": lambda what: F.col(f"{what}2")}
    more = [(F.max(by[side](what)) if what == "peak" else F.sum(by[side](what) * F.col("times"))).alias(f"more_{what}_{side}") for side in SIDES for what in SUMS]
    rest = met.groupBy("row").agg(F.sum(F.col("size") * F.col("times")).alias("more_size"), *more)
    size = F.col("size") + F.coalesce("more_size", F.lit(0))
    out = []
    for k in SIDES:
        peak = F.greatest(f"peak_{k}", F.coalesce(f"more_peak_{k}", F.lit(float("-inf"))))
        total, power = (F.col(f"{what}_{k}") + F.coalesce(f"more_{what}_{k}", F.lit(0.0)) for what in ("sum", "power"))
        each = {"peak": peak / SPAN, "mean": total / size, "strong": F.pow(power, 1 / POWER) / SPAN, "dense": F.pow(power / size, 1 / POWER) / SPAN}
        asked = F.col("other").isNotNull() if k == "other" else F.lit(True)
        out += [F.when(asked, F.when(size > 0, each[what]).otherwise(0.0)).alias(f"{what}_{k}") for what in FEATURES]
    return scanned.drop("words", "times").join(rest.hint("merge"), "row", "left").select("doc_id", *out)


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias last) of a logistic curve, by Newton steps; classes weigh the same."""
    if len(set(y.tolist())) < 2:
        return np.append(np.zeros(x.shape[1]), -4.0)
    x = np.column_stack([x, np.ones(len(x))])
    each = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + ridge * w
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score (0 to 1) and the features.

    ``labels`` has the columns doc_id and toxic (0 or 1). Learns only from labels of
    rows that are not held out.
    """
    own, h = documents(docs, key, text), F.xxhash64("doc_id")
    known = learnt_labels(labels)
    model = fit(learning_rows(own, known))
    # CURVE_ROWS at most; only rows of these hashes are scored by the model of the other fold
    fitted = written(learnable(own).select("doc_id").join(known.hint("merge"), "doc_id").withColumn("h", h).orderBy("h").limit(CURVE_ROWS), "fitted")
    asked = ~held_out(F.col("doc_id")) & (F.xxhash64(F.col("doc_id").cast("long")) <= F.lit(fitted.agg(F.max("h")).first()[0]).cast("long"))
    found = written(ratios(own.withColumn("other", F.when(asked, 1 - fold(F.col("doc_id")))), model), "found")
    chosen = F.broadcast(fitted.select("doc_id", "toxic").distinct())
    unseen = found.where("peak_other IS NOT NULL").join(chosen, "doc_id").select(*[f"{f}_other" for f in FEATURES], "toxic", h.alias("h"))
    rows = np.array([[*r][:-1] for r in unseen.orderBy("h").limit(CURVE_ROWS).collect()], float).reshape(-1, len(FEATURES) + 1)
    *weights, bias = curve(rows[:, :-1], rows[:, -1]).tolist()
    value = 1 / (1 + F.exp(-sum((F.col(f"{f}_both") * w for f, w in zip(FEATURES, weights)), F.lit(bias))))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), value.alias("score"), *[F.col(f"{f}_both").alias(f) for f in FEATURES])
