"""Approximate nearest neighbours by NN-descent and greedy graph search.

The graph is that of landmarks: a sample of 2 * sqrt(n) distinct vectors, at most
LANDMARKS, those of the smallest hashes. Every row belongs to its nearest landmark.
A graph over all rows would send each vector to all neighbourhoods it is in, tens of
times the input in each round.

Landmarks start in groups dealt at random. Each round joins nodes that share a
neighbour - two nodes in the neighbourhood of a third are likely near - and keeps the
K nearest, until no edge changes. Of a node's new edges the nearer K/2 take part at
once, the others in later rounds, if they are still among the K nearest then: most of
the first ones are not. A large neighbourhood is dealt into blocks, and all pairs of
blocks are compared.

A search starts at a query's own landmark and a few others and keeps joining the
nearest landmarks not yet looked at with their graph neighbours, in both directions,
until the nearest ``beam`` do not change; every landmark met is kept with its distance, so
that a pair is compared once. The rows of these landmarks are compared with the query.
Some queries are also answered by comparing them with every row: the beam is the
narrowest that meets the landmarks of enough of their neighbours, and all landmarks
if none does.

Rows are dealt by their ids into blocks that fit a task, whatever landmarks they have,
and packets of queries go to every block. A block compares by matrix products, whose
rounding is allowed for, and takes the distances of what may be near from the vectors.

Vectors that are null, empty, zero, hold a null or non-finite component, have
another length than most, or have a null id take no part. Equal distances order
by id. Rows that repeat an id and its vector count once; an id with several
vectors is as many candidates. Extra columns are dropped; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, frexp, isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import forget, give_back, mix64, written

#: Neighbours that a node keeps.
K = 48
#: Nodes of a block, on average; up to two blocks are compared at a time.
GROUP = 128
#: Nodes that a search looks from at least.
BEAM = 96
#: Query nodes that are also answered by comparing all rows, and the share of their neighbours to find.
HELD, RECALL = 64, 0.98
#: Landmarks at most, and their components in all.
LANDMARKS, COMPONENTS = 4096, 1 << 22
#: Landmarks that every search starts from, besides the query's own.
ENTRIES = 32
#: Rows of a block and queries of a packet: parts that a table falls into, if they have at least and at most so many.
BLOCK, PACKET = (24, 1 << 12, 1 << 18), (12, 1 << 10, 1 << 13)

_EDGE = "u long, w long, d double"
_FOUND = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, int, int, float]:
    """Usable rows: vec_id, v (the vector as it is; array of float or double); their number, about how
    many vectors differ, components and the largest magnitude of one."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    good = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    good = good.where(F.forall("v", lambda x: x.isNotNull()))
    # NaN is above all numbers
    good = good.where((F.array_max("v") < float("inf")) & (F.array_min("v") > -float("inf")) & ((F.array_max("v") != 0) | (F.array_min("v") != 0)))
    most = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("v")).alias("different"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("largest")).orderBy(F.desc("rows"), "n").first()
    if not most:
        return good, 0, 0, 1, 1.0
    return good.where(F.size("v") == most["n"]), most["rows"], most["different"], most["n"], float(most["largest"])


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], dim: int) -> Iterator[dict]:
    """The rows of each group, from batches sorted by group (column ``g``)."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names if c != "v"}
        v = batch.column("v")
        got["v"] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        if held and got["g"][-1] == held[0]["g"][0]:
            held.append(got)
            continue
        got = {c: np.concatenate([*[h[c] for h in held], got[c]]) for c in names}
        bound = np.concatenate([[0], np.flatnonzero(np.diff(got["g"])) + 1])
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            yield {c: x[a:b] for c, x in got.items()}
        held = [{c: x[int(bound[-1]) :] for c, x in got.items()}]
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in names}


def _dealt(members: DataFrame) -> DataFrame:
    """Groups with a new member, those of over two blocks as all pairs of their blocks.

    Columns g, node, new and side: rows of one side (0 or 1) of a pair need not be
    compared with each other; the pair of a block with itself has side 2.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("any")
    blocks = F.when(F.col("n") > 2 * GROUP, F.ceil(F.col("n") / GROUP)).otherwise(1)
    placed = members.join(sizes, "g").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "g"), F.col("blocks")))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    g = F.when(F.col("blocks") == 1, F.xxhash64("g")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")))
    return each.select(g.alias("g"), "node", "new", side.cast("long").alias("side"))


def _nearest(u: np.ndarray, w: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct w of each u."""
    order = np.lexsort((w, d, u))
    u, w, d = u[order], w[order], d[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    u, w, d = u[new], w[new], d[new]
    first = np.searchsorted(u, u)
    keep = np.arange(len(u)) - first < k
    return u[keep], w[keep], d[keep]


def _local_join(members: DataFrame, dim: int, k: int) -> DataFrame:
    """Edges between members (g, node, v, new, side, far) of a group with a new one among
    them, where an end's farthest neighbour is farther."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0

        def best() -> tuple:
            u, w, d = (np.concatenate(c) for c in zip(*found))
            return _nearest(u, w, d, k)

        for run_ in _runs(batches, ["g", "node", "v", "new", "side", "far"], dim):
            node, x, new, side, far = run_["node"], run_["v"].astype(np.float64), run_["new"], run_["side"], run_["far"]
            if len(node) < 2 or not new.any():
                continue
            square = (x**2).sum(1)
            d = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))
            i, j = np.nonzero((d < far[:, None]) & (new[:, None] | new[None]) & (node[:, None] != node[None]) & ((side[:, None] != side[None]) | (side[:, None] == 2)))
            found.append((node[i], node[j], d[i, j]))
            held += len(i)
            if held > 1_000_000:
                found = [best()]
                held = len(found[0][0])
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], names=["u", "w", "d"])
                    found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], names=["u", "w", "d"])

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(run, _EDGE)


def _keep(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; an edge that has taken part is not new, and of the others the k / 2 nearest are ``next``."""
    each = edges.groupBy("u", "w").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    near = Window.partitionBy("u").orderBy("d", "w")
    turn = F.sum(F.col("new").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).withColumn("turn", turn)
    return each.select("u", "w", "d", "new", (F.col("new") & (F.col("turn") <= (k + 1) // 2)).alias("next"))


def graph(points: DataFrame, k: int = K) -> DataFrame:
    """NN-descent over distinct vectors ``points`` (node, v), which is read in each round: u, w, d."""
    spark = points.sparkSession
    row = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = row["n"], row["dim"] or 1
    far = F.lit(float("inf"))
    deals = [points.select(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(max(1, n // (k // 2)))).alias("g"), "node", "v", F.lit(True).alias("new"), F.lit(2).cast("long").alias("side"), far.alias("far")) for r in range(1, 4)]
    members = deals[0]
    for r, deal in enumerate(deals[1:], 1):
        members = members.union(deal.withColumn("g", F.col("g") + r * n))
    edges = written(_keep(_local_join(members, dim, k).withColumn("new", F.lit(True)), k), "knn")
    while not edges.where("new").isEmpty():
        part = edges.where("next OR NOT new")
        both = part.select(F.col("u").alias("g"), F.col("w").alias("node"), F.col("next").alias("new")).union(part.select(F.col("w").alias("g"), F.col("u").alias("node"), F.col("next").alias("new")))
        both = both.groupBy("g", "node").agg(F.max("new").alias("new"))
        # a node with k neighbours only wants nearer ones
        reach = edges.groupBy("u").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(far).alias("far"))
        about = points.join(reach, points.node == reach.u, "left").select("node", "v", F.coalesce("far", far).alias("far"))
        members = _dealt(both).join(about, "node")
        then = written(_keep(_local_join(members, dim, k).withColumn("new", F.lit(True)).union(edges.select("u", "w", "d", (F.col("new") & ~F.col("next")).alias("new"))), k), "knn")
        forget(spark, edges)
        edges = then
    return edges.select("u", "w", "d")


def _distances(pairs: DataFrame, dim: int) -> DataFrame:
    """q, w, d from q, w and their vectors qv and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for c in ("qv", "v"))
            # each from the vectors, not from a product of many, so that equal distances are equal
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("w"), pa.array(np.sqrt(((a - b) ** 2).sum(1)))], names=["q", "w", "d"])

    return pairs.select("q", "w", "qv", "v").mapInArrow(run, "q long, w long, d double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "w"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _links(edges: DataFrame) -> DataFrame:
    """Graph edges in both directions, written."""
    return written(edges.select("u", "w").union(edges.select("w", "u")).distinct(), "links")


def _aimed(seen: DataFrame, beam: int) -> DataFrame:
    """Nodes met (q, w, d, done) and ``ahead``: those of the nearest ``beam`` not yet looked from."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "w"))
    return seen.withColumn("rank", rank).select("q", "w", "d", "done", ((F.col("rank") <= beam) & ~F.col("done")).alias("ahead"))


def greedy(points: DataFrame, links: DataFrame, asked: DataFrame, start: DataFrame, beam: int, dim: int) -> DataFrame:
    """All nodes that a search from the nearest ``beam`` meets for each query node: q, w, d, done (its own node aside).

    ``asked``: q and its vector qv; ``start``: q, w, d of nodes to begin with and whether
    they were looked from before (done), as a search with a narrower beam leaves them.
    """
    spark = points.sparkSession
    state = written(_aimed(start, beam), "beam")
    while not state.where("ahead").isEmpty():
        ahead = state.where("ahead")
        near = ahead.join(links, ahead.w == links.u).select("q", links.w.alias("w")).where("q <> w").distinct()
        near = near.join(state.select("q", "w"), ["q", "w"], "left_anti")
        pairs = near.join(asked, "q").join(points.select(F.col("node").alias("w"), "v"), "w")
        kept = state.select("q", "w", "d", (F.col("done") | F.col("ahead")).alias("done"))
        then = written(_aimed(kept.union(_distances(pairs, dim).withColumn("done", F.lit(False))), beam), "beam")
        forget(spark, state)
        state = then
    return state.drop("ahead")


class Marks(NamedTuple):
    """Landmarks: ids, vectors, a power of two that keeps squares finite, the point that products are
    taken from, scaled, vectors from there (in ``near`` with one more component, which makes the
    nearest the greatest product) and links, a bit for each pair."""

    ids: np.ndarray
    v: np.ndarray
    scale: float
    centre: np.ndarray
    x: np.ndarray
    near: np.ndarray
    links: np.ndarray

    def centred(self, v: np.ndarray) -> np.ndarray:
        return (v if self.scale == 1 else v * v.dtype.type(self.scale)) - self.centre

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The nearest landmark of each centred vector."""
        out = np.empty(len(x), np.uint16)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            out[a : a + 1024] = (np.hstack([part, np.ones((len(part), 1), part.dtype)]) @ self.near.T).argmax(1)
        return out


def _sample(rows: DataFrame, count: int, different: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the landmarks: of all vectors those of the smallest hashes, each with its smallest id."""
    limit = -(2**63) + min(2**64 - 1, 2**64 * 3 * count // max(1, different))
    some = rows.withColumn("h", F.xxhash64("v")).where(F.col("h") <= F.lit(limit))
    table = some.groupBy("v", "h").agg(F.min("vec_id").alias("vec_id")).orderBy("h", "vec_id").limit(count).toArrow()
    v = table.column("v").combine_chunks()
    return table.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _points(spark, marks: Marks) -> DataFrame:
    return written(spark.createDataFrame(pa.table({"node": pa.array(np.arange(len(marks.ids))), "v": pa.array(list(marks.v))})), "points")


def _batches(batches: Iterator[pa.RecordBatch], dim: int, limit: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of rows (vec_id, v), in batches of about ``limit`` bytes."""
    held: list[tuple] = []
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
        if sum(v.nbytes for _, v in held) >= limit:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by products."""
    return (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T


def exact(rows: DataFrame, ids: np.ndarray, v: np.ndarray, marks: Marks, n: int) -> list[tuple[int, int]]:
    """The landmarks of the n nearest other rows of a few queries, by comparing all: pairs of a query's number and a landmark."""
    dim, x = v.shape[1], marks.centred(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, home = np.full((len(ids), n), np.inf), np.zeros((len(ids), n), np.int64)
        for own, vectors in _batches(batches, dim, 1 << 22):
            y = marks.centred(vectors)
            d = _squares(x, y).astype(np.float64)
            d[own[None] == ids[:, None]] = np.inf
            first = np.argpartition(d, n - 1, axis=1)[:, :n] if len(own) > n else np.tile(np.arange(len(own)), (len(ids), 1))
            d = np.hstack([near, np.take_along_axis(d, first, 1)])
            cells = np.hstack([home, marks.homes(y[first.ravel()]).reshape(first.shape)])
            order = np.argsort(d, axis=1, kind="stable")[:, :n]
            near, home = np.take_along_axis(d, order, 1), np.take_along_axis(cells, order, 1)
        i, j = np.nonzero(near < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(home[i, j]), pa.array(near[i, j])], names=["q", "w", "d"])

    # at most HELD * n pairs
    return [(r["q"], r["w"]) for r in _top(rows.mapInArrow(run, "q long, w long, d double"), n).collect()]


def _entries(marks: Marks, n: int) -> int:
    """Landmarks that every search starts from: each has a row, so that n rows are found if there are as many."""
    return min(len(marks.ids), max(ENTRIES, n + 1))


def _beam(rows: DataFrame, marks: Marks, points: DataFrame, links: DataFrame, held: DataFrame, n: int, beam: int) -> int:
    """The narrowest beam, at least ``beam``, that meets the landmarks of enough neighbours of the held queries."""
    spark, count = rows.sparkSession, len(marks.ids)
    table = held.toArrow()
    ids, v = table.column("vec_id").to_numpy(), table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    want = exact(rows, ids, v, marks, n)
    # numbers of queries are above those of landmarks
    asked = written(spark.createDataFrame(pa.table({"q": pa.array(count + np.arange(len(ids))), "qv": pa.array(list(v))})), "held")
    home = marks.homes(marks.centred(v))
    begin = [(count + i, int(w)) for i in range(len(ids)) for w in {*range(_entries(marks, n)), int(home[i])}]
    near = spark.createDataFrame(begin, "q long, w long").join(asked, "q").join(points.select(F.col("node").alias("w"), "v"), "w")
    state = written(_distances(near, v.shape[1]).withColumn("done", F.lit(False)), "start")
    need = ceil(RECALL * len(want))
    # the beam that would do if searches met all
    order = np.argsort(np.argsort(_squares(marks.centred(v), marks.x), axis=1), axis=1) + 1
    beam = max(beam, *sorted(int(order[p]) for p in want)[need - 1 : need]) if need else beam
    while True:
        start, state = state, greedy(points, links, asked, state, min(beam, count), v.shape[1])
        forget(spark, start)
        place = F.row_number().over(Window.partitionBy("q").orderBy("d", "w"))
        pairs = spark.createDataFrame([(count + q, w) for q, w in {*want}], "q long, w long")
        met = {(r["q"] - count, r["w"]): r["rank"] for r in state.withColumn("rank", place).join(F.broadcast(pairs), ["q", "w"]).collect()} if want else {}
        ranks = sorted(met[p] for p in want if p in met)
        if sum(r <= beam for r in ranks) >= need or beam >= count:
            break
        beam *= 2
    forget(spark, state, asked)
    if len(ranks) < need:
        return count
    return ranks[need - 1] if need else 1


def _look(x: np.ndarray, own: int, home: int, marks: Marks, beam: int, entries: int, n: int) -> tuple[np.ndarray, float]:
    """The search of ``greedy`` for one centred query vector: which landmarks are the nearest
    ``beam`` met, and the squared distance of the n-th nearest met of another id."""
    count, square = len(marks.ids), float((x.astype(np.float64) ** 2).sum())
    x = np.append(x, x.dtype.type(1))
    d, cut = np.full(count, np.inf), np.inf
    met, done, new = (np.zeros(count, bool) for _ in range(3))
    # without a beam all are looked at, linked or not
    new[: entries if beam < count else count] = True
    new[home] = True
    while True:
        j = np.flatnonzero(new)
        d[j] = square - 2 * (marks.near[j] @ x)
        met |= new
        if beam < count:
            cut = np.partition(d, beam - 1)[beam - 1]
        j = np.flatnonzero(met & ~done & (d <= cut))
        if not len(j):
            break
        done[j] = True
        new = np.unpackbits(np.bitwise_or.reduce(marks.links[j], axis=0), count=count).view(bool) & ~met
    looked = met & (d <= cut)
    looked[home] = True
    d[marks.ids == own] = np.inf
    return looked, float(np.partition(d, n - 1)[n - 1]) if count >= n else np.inf


_PACKET = "block long, kind int, packet long, ids binary, cells binary, v binary, bounds binary"


def _packet(block: int, kind: int, packet: int, *parts: bytes) -> dict:
    return dict(zip(("block", "kind", "packet", "ids", "cells", "v", "bounds"), (block, kind, packet, *parts)))


def _record(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("packet", pa.int64()), *((c, pa.binary()) for c in ("ids", "cells", "v", "bounds"))]))


def _row_packets(rows: DataFrame, marks: Marks, blocks: int) -> DataFrame:
    """Rows with their landmarks, dealt into blocks by their ids."""
    dim = marks.v.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _batches(batches, dim):
            cell = marks.homes(marks.centred(v))
            block = mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            ids, v, cell, block = ids[order], v[order], cell[order], block[order]
            bound = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
            yield _record([_packet(int(block[a]), 0, 0, ids[a:b].tobytes(), cell[a:b].tobytes(), v[a:b].tobytes(), b"") for a, b in zip(bound[:-1], bound[1:])])
        give_back()

    return rows.mapInArrow(run, _PACKET)


def _query_packets(asked: DataFrame, marks: Marks, beam: int, size: int, n: int) -> DataFrame:
    """Queries with the landmarks to look at (a bit for each landmark and query) and a bound of their n-th squared distance."""
    dim, entries = marks.v.shape[1], _entries(marks, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for own, vectors in _batches(batches, dim, size * dim * marks.v.itemsize):
            for a in range(0, len(own), size):
                ids, v = own[a : a + size], vectors[a : a + size]
                x = marks.centred(v)
                found = [_look(y, i, home, marks, beam, entries, n) for y, i, home in zip(x, ids.tolist(), marks.homes(x).tolist())]
                looked, bounds = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                yield _record([_packet(0, 1, number, ids.tobytes(), np.packbits(looked.T, axis=1).tobytes(), v.tobytes(), bounds.tobytes())])
                number += 1
        give_back()

    return asked.mapInArrow(run, _PACKET)


class Rows(NamedTuple):
    """Rows of a block in order of their landmarks: ids, vectors, and what a product with a query's
    (centred vector, 1, square less limit) makes their squared distance less the limit."""

    ids: np.ndarray
    v: np.ndarray
    x: np.ndarray
    off: np.ndarray


def _block(parts: list[tuple], marks: Marks, n: int) -> Rows:
    """Of equal vectors the n + 1 smallest ids stay: no result has more."""
    ids, cell, v = (np.concatenate(c) for c in zip(*parts))
    words = v.view(np.uint32)
    odd = mix64(np.arange(1, words.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.concatenate([(words[a : a + 8192] * odd).sum(1) for a in range(0, len(v), 8192)])
    order = np.lexsort((ids, h))
    same = np.zeros(len(ids), bool)
    at = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
    for a in range(0, len(at), 8192):
        part = at[a : a + 8192]
        same[part] = (v[order[part]] == v[order[part - 1]]).all(1)
    step = ~same
    step[1:] |= ids[order[1:]] != ids[order[:-1]]
    place = np.cumsum(step)
    first = np.maximum.accumulate(np.where(~same, np.arange(len(ids)), 0))
    order = order[step & (place - place[first] <= n)]
    order = order[np.argsort(cell[order], kind="stable")]
    ids, cell, v = ids[order], cell[order], v[order]
    x = np.empty((len(v), v.shape[1] + 2), v.dtype)
    x[:, :-2] = marks.centred(v)
    x[:, -2] = (x[:, :-2] ** 2).sum(1)
    x[:, :-2] *= -2
    x[:, -1] = 1
    return Rows(ids, v, x, np.searchsorted(cell, np.arange(len(marks.ids) + 1)))


def _not_above(d: np.ndarray) -> np.ndarray:
    """Places of a matrix that are not above zero, few of many: eight are looked at as one word."""
    flags = np.zeros(-(-d.size // 8) * 8, bool)
    np.greater(d, 0, out=flags[: d.size].reshape(d.shape))
    np.logical_not(flags[: d.size], out=flags[: d.size])
    word = np.flatnonzero(flags.view(np.uint64) != 0)
    i, j = np.nonzero(flags.reshape(-1, 8)[word])
    return word[i] * 8 + j


def _compared(rows: Rows, ids: np.ndarray, v: np.ndarray, looked: np.ndarray, bounds: np.ndarray, marks: Marks, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest other rows of a block for each query, from its landmarks: ids and distances, NaN where there are fewer."""
    x = marks.centred(v)
    square = (x.astype(np.float64) ** 2).sum(1)
    rounding = 4 * (v.shape[1] + 8) * float(np.finfo(v.dtype).eps) * (square + float(rows.x[:, -2].max()))
    query = np.hstack([x, np.ones((len(x), 2), x.dtype)])
    near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    limit = bounds.copy()
    held: list[tuple] = []

    def settle() -> tuple:
        """What the limits let through, by its own distances; limits follow."""
        i, j = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        held.clear()
        other = rows.ids[i] != ids[j]
        i, j = i[other], j[other]
        # each from the vectors, not from a product of many, so that equal distances are equal
        d = np.concatenate([np.zeros(0), *(np.sqrt(((rows.v[i[a : a + 8192]].astype(np.float64) - v[j[a : a + 8192]]) ** 2).sum(1)) for a in range(0, len(i), 8192))])
        i, j, d = np.concatenate([near[0], i]), np.concatenate([near[1], j]), np.concatenate([near[2], d])
        order = np.lexsort((rows.ids[i], d, j))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(j)) - np.searchsorted(j, j)
        keep = place < n
        last = place == n - 1
        limit[j[last]] = np.minimum(limit[j[last]], (d[last] * marks.scale) ** 2)
        query[:, -1] = np.maximum(square - limit * (1 + 1e-9) - rounding, -float(np.finfo(v.dtype).max) / 4)
        return i[keep], j[keep], d[keep]

    total = len(rows.ids)
    marked = [total >> 4, total >> 3, total >> 2, total >> 1]
    waiting = 0
    near = settle()
    for c in range(len(marks.ids)):
        a, b = int(rows.off[c]), int(rows.off[c + 1])
        chosen = np.flatnonzero(np.unpackbits(looked[c], count=len(ids))) if a < b else ()
        if not len(chosen):
            continue
        asked = query[chosen].T
        tall = max(1, (1 << 22) // len(chosen))
        for r in range(a, b, tall):
            hit = _not_above(rows.x[r : min(b, r + tall)] @ asked)
            if len(hit):
                held.append((hit // len(chosen) + r, chosen[hit % len(chosen)]))
                waiting += len(hit)
            if waiting > 1 << 20:
                near, waiting = settle(), 0
                asked = query[chosen].T
        if marked and b >= marked[0]:
            marked = [m for m in marked if m > b]
            near, waiting = settle(), 0
    i, j, d = settle()
    place = np.arange(len(j)) - np.searchsorted(j, j)
    out, far = np.zeros((len(ids), n), np.int64), np.full((len(ids), n), np.nan)
    out[j, place], far[j, place] = rows.ids[i], d
    return out, far


_BEST = "packet long, asked binary, ids binary, d binary"


def _best_of_blocks(packets: DataFrame, marks: Marks, n: int) -> DataFrame:
    """For each block and packet of queries the n nearest of each query; a block's rows come before the queries."""
    dim, kind, count = marks.v.shape[1], marks.v.dtype, len(marks.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, rows = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                if block != batch.column("block")[r].as_py():
                    block, parts, rows = batch.column("block")[r].as_py(), [], None
                ids, v = get("ids", np.int64), get("v", kind).reshape(-1, dim)
                if batch.column("kind")[r].as_py() == 0:
                    parts.append((ids, get("cells", np.uint16), v))
                    continue
                if parts:
                    rows, parts = _block(parts, marks, n), []
                if rows is not None:
                    out, far = _compared(rows, ids, v, get("cells", np.uint8).reshape(count, -1), get("bounds", np.float64), marks, n)
                    yield pa.RecordBatch.from_arrays([batch.column("packet").slice(r, 1), pa.array([ids.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary()), pa.array([far.tobytes()], pa.binary())], names=["packet", "asked", "ids", "d"])
        give_back()

    return packets.mapInArrow(run, _BEST)


def _merged(best: DataFrame, n: int) -> DataFrame:
    """The n nearest of each query over all blocks: query_id, vec_id, d."""

    def out(asked: np.ndarray, ids: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(~np.isnan(d))
        return pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[i, j]), pa.array(d[i, j])], names=["query_id", "vec_id", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packet, held = None, ()
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                own, asked = batch.column("packet")[r].as_py(), get("asked", np.int64)
                ids, d = get("ids", np.int64).reshape(-1, n), get("d", np.float64).reshape(-1, n)
                if own != packet:
                    if held:
                        yield out(*held)
                    packet, held = own, (asked.copy(), ids.copy(), d.copy())
                    continue
                ids, d = np.hstack([held[1], ids]), np.hstack([held[2], d])
                order = np.lexsort((ids, d), axis=1)[:, :n]
                held = held[0], np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        if held:
            yield out(*held)

    return best.mapInArrow(run, "query_id long, vec_id long, d double")


def _parts(total: int, size: tuple[int, int, int]) -> int:
    return ceil(total / min(size[2], max(size[1], ceil(total / size[0]))))


def search(vectors: DataFrame, queries: Column, n: int = 10, key: str = "vec_id", vector: str = "embedding", k: int = K, beam: int = BEAM) -> DataFrame:
    """The n nearest other rows of each row that meets the condition ``queries`` (over vec_id).

    Columns: query_id, rank (from 1), vec_id, score (Euclidean distance).
    """
    spark = vectors.sparkSession
    rows, total, different, dim, largest = usable(vectors, key, vector)
    asked = written(rows.where(queries).distinct(), "asked")
    number = asked.count()
    if not number:
        return spark.createDataFrame([], _FOUND)
    ids, v = _sample(rows, max(1, min(LANDMARKS, COMPONENTS // dim, max(64, 2 * isqrt(different)))), different)
    most = np.finfo(v.dtype).maxexp - 2
    scale = 1.0 if 1e-9 < largest < 1e9 else 2.0 ** -max(-most, min(most, frexp(largest)[1]))
    centre = (v * v.dtype.type(scale)).mean(0, dtype=np.float64).astype(v.dtype)
    x = v * v.dtype.type(scale) - centre
    marks = Marks(ids, v, scale, centre, x, np.hstack([x, -(x**2).sum(1, keepdims=True) / 2]), np.zeros((len(ids), 0), np.uint8))
    points = _points(spark, marks)
    # a node of a small graph needs fewer links
    edges = graph(points, min(k, max(8, isqrt(len(ids)))))
    links = _links(edges)
    # at most 2 * K pairs a landmark
    pairs = links.toArrow()
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[pairs.column("u").to_numpy(), pairs.column("w").to_numpy()] = True
    marks = marks._replace(links=np.packbits(linked, axis=1))
    beam = max(beam, n + 1, _beam(rows, marks, points, links, asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(HELD), n, max(beam, n + 1)))
    blocks, parts = _parts(total, BLOCK), _parts(number, PACKET)
    packets = written(_query_packets(asked.repartition(parts), marks, beam, PACKET[2], n), "queries")
    sent = packets.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(*packets.columns)
    mixed = _row_packets(rows, marks, blocks).union(sent).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    best = _best_of_blocks(mixed, marks, n).repartition(parts, "packet").sortWithinPartitions("packet")
    found = written(_merged(best, n), "found")
    forget(spark, points, edges, links, asked, packets)
    # an id with several vectors asks with all of them
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
