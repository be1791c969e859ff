"""Nearest neighbours through learned partitions of a neighbour graph.

A bounded sample of the vectors is joined to a graph of nearest neighbours,
which is cut into balanced parts by repeated bisection, so that most neighbours
share a part.  A small classifier learns the parts of a vector and of its
neighbours; the index puts every vector, sampled or not, into its most probable
part.  A query goes to its several most probable parts and is compared with all
vectors there; how many is what recalls ``RECALL`` of the neighbours of sampled
vectors that the classifier hasn't seen.  Parts are searched in blocks of
bounded size, so a part of any size is spread over tasks and none is cut.

Equal vectors are one in the index, with their ``k + 1`` smallest ids, which is
all that a list of ``k`` can show of them.

Defined results: rows with a null id, and vectors that are null, zero, of
another length than most, or hold null or non-finite components take no part; a
query's own row is left out once, so a repeated row is its own neighbour; a
repeated query has its list as often; ties go to smaller ids; fewer than ``k``
candidates are all found; an empty table has no queries.  Only named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

K = 10
#: Distinct vectors that graph and classifier are fitted on, at most; of which one in ``HELD`` only tells how many parts to ask.
SAMPLE, HELD = 16_384, 8
#: Vectors for each part, and parts, at most; vectors of a block.
PART_ROWS, MOST_PARTS, BLOCK = 1024, 1024, 32_768
#: Share of neighbours that parts asked must hold for held-out vectors of the sample.
RECALL = 0.97
#: Neighbours in the graph, hidden units, rounds of training, rows of a step.
DEGREE, HIDDEN, EPOCHS, STEP = 10, 128, 24, 256


def nearest_in(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Places in ``x`` of the ``k`` nearest of each of ``x[queries]``, not itself."""
    norms, out = (x * x).sum(1), np.empty((len(queries), k), np.int64)
    for a in range(0, len(queries), 512):
        some = queries[a : a + 512]
        far = norms[None, :] - 2 * x[some] @ x.T
        far[np.arange(len(some)), some] = np.inf
        out[a : a + len(some)] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def _bisect(ends: np.ndarray, size: int, first: int, rnd: np.random.Generator) -> np.ndarray:
    """Which of ``size`` nodes are in the first half, of ``first`` nodes; ``ends`` are the edges (u, v), both ways."""
    u, v = ends
    degree = np.bincount(u, minlength=size) + 1.0
    at = rnd.standard_normal(size)
    for _ in range(40):  # the slowest wave of a lazy walk over the graph, but for the constant one
        at -= (at * degree).sum() / degree.sum()
        at = (at + np.bincount(u, at[v], size)) / degree
        at /= max(np.abs(at).max(), 1e-300)
    side = np.zeros(size, bool)
    side[np.argsort(at, kind="stable")[:first]] = True
    cut, share = np.count_nonzero(side[u] != side[v]), 0.1
    while share > 0.002:  # swap those that gain the most by it, as long as the cut falls
        gain = np.bincount(u, np.where(side[u] != side[v], 1.0, -1.0), size)
        n = max(1, int(share * min(first, size - first)))
        ones, others = np.flatnonzero(side), np.flatnonzero(~side)
        ones, others = ones[np.argsort(-gain[ones], kind="stable")[:n]], others[np.argsort(-gain[others], kind="stable")[:n]]
        good = gain[ones[: len(others)]] + gain[others[: len(ones)]] > 0
        new = side.copy()
        new[ones[: len(good)][good]], new[others[: len(good)][good]] = False, True
        now = np.count_nonzero(new[u] != new[v])
        if now < cut:
            side, cut = new, now
        else:
            share /= 2
    return side


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """The part of each node of the graph; sizes differ by one at most for parts a power of two, by a few otherwise."""
    size, degree = neighbours.shape
    u, v = np.repeat(np.arange(size), degree), neighbours.ravel()
    edges = np.unique(np.concatenate([u * size + v, v * size + u]))
    u, v = edges // size, edges % size
    rnd, out = np.random.default_rng(seed), np.zeros(size, np.int64)
    todo = [(np.arange(size), 0, parts)]
    while todo:
        nodes, low, n = todo.pop()
        out[nodes] = low
        if n == 1 or len(nodes) < 2:
            continue
        local = np.full(size, -1)
        local[nodes] = np.arange(len(nodes))
        inside = (local[u] >= 0) & (local[v] >= 0)
        half = n // 2
        side = _bisect((local[u[inside]], local[v[inside]]), len(nodes), round(len(nodes) * half / n), rnd)
        todo += [(nodes[side], low, half), (nodes[~side], low + half, n - half)]
    return out


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer, and how many parts a query asks."""

    center: np.ndarray
    scale: float
    hidden: np.ndarray
    out: np.ndarray
    asked: int = 1

    @property
    def parts(self) -> int:
        return self.out.shape[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """A row of scores for each vector; the highest is the most probable part."""
        return _forward(self.hidden, self.out, _inputs(x, self.center, self.scale))[1]

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(1).astype(np.int32)


def _inputs(x: np.ndarray, center: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.clip(np.nan_to_num((x - center) / scale), -1e3, 1e3).astype(np.float32)


def _forward(hidden: np.ndarray, out: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ hidden[:-1] + hidden[-1], 0)
    return h, h @ out[:-1] + out[-1]


def train(x: np.ndarray, shares: np.ndarray, center: np.ndarray, scale: float, seed: int = 0) -> Router:
    """Learns for each vector the shares of the parts among it and its neighbours, by Adam's rule."""
    rnd = np.random.default_rng(seed)
    x = _inputs(x, center, scale)
    size, dims = x.shape
    weights = [rnd.standard_normal((dims + 1, HIDDEN)) * np.sqrt(2 / dims), rnd.standard_normal((HIDDEN + 1, shares.shape[1])) * np.sqrt(1 / HIDDEN)]
    weights = [w.astype(np.float32) for w in weights]
    moved, squared, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = rnd.permutation(size)
        for a in range(0, size, STEP):
            some = order[a : a + STEP]
            h, z = _forward(*weights, x[some])
            p = np.exp(z - z.max(1, keepdims=True))
            dz = (p / p.sum(1, keepdims=True) - shares[some]) / len(some)
            dh = (dz @ weights[1][:-1].T) * (h > 0)
            slopes = [np.vstack([x[some].T @ dh, dh.sum(0)]), np.vstack([h.T @ dz, dz.sum(0)])]
            t += 1
            for w, g, m, s in zip(weights, slopes, moved, squared, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= 0.004 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Router(center, scale, *weights)


def fit(x: np.ndarray, rows: int, k: int = K, recall: float = RECALL, seed: int = 0) -> Router:
    """The router of a sample ``x`` of ``rows`` distinct vectors."""
    parts = max(min(8, rows // 16), min(MOST_PARTS, rows // PART_ROWS, len(x) // 16), 1)
    with np.errstate(all="ignore"):
        center = np.nan_to_num(x.mean(0)) if len(x) else np.zeros(x.shape[1])
        scale = float(np.nan_to_num(x.std(), nan=0.0)) or 1.0 if len(x) else 1.0
    if parts == 1:
        return Router(center, scale, np.zeros((x.shape[1] + 1, 1), np.float32), np.zeros((2, 1), np.float32))
    with np.errstate(all="ignore"):
        even = np.nan_to_num((x - center) / scale)
    held = np.arange(len(x)) % HELD == 0
    known, tried = np.flatnonzero(~held), np.flatnonzero(held)
    graph = nearest_in(even[known], np.arange(len(known)), min(DEGREE, len(known) - 1))
    part = balanced_parts(graph, parts, seed)
    shares = np.zeros((len(known), parts), np.float32)
    for column in (np.arange(len(known))[:, None], graph):
        np.add.at(shares, (np.repeat(np.arange(len(known)), column.shape[1]), part[column].ravel()), 1 / column.shape[1] / 2)
    router = train(x[known], shares, center, scale, seed)
    # a part that is asked as the r-th holds so many of the neighbours
    homes = router.home(x)[nearest_in(even, tried, min(k, len(x) - 1))]
    order = np.argsort(-router.scores(x[tried]), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape), 1)
    held_at = np.bincount(np.take_along_axis(rank, homes, 1).ravel(), minlength=parts).cumsum()
    asked = int(np.searchsorted(held_at, recall * held_at[-1])) + 1
    return Router(center, scale, router.hidden, router.out, min(asked, parts))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed one component after the other."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            out += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(out)


def nearest_rows(queries: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest (query, score, id), exactly: products only name what can't be ruled out; ``x[i]`` has the ids ``ids[i]``."""
    with np.errstate(all="ignore"):
        norms, own = (x * x).sum(1), (queries * queries).sum(1)
        far = np.nan_to_num(own[:, None] + norms[None, :] - 2 * queries @ x.T, nan=np.inf)
        bound = np.partition(far, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(queries), np.inf)
        near = far <= (bound + 1e-9 * (own + norms.max()))[:, None]
    q, v = np.nonzero(near)
    score = distances(queries[q], x[v])
    sizes = np.array([len(ids[i]) for i in v], np.int64)
    q, score, found = np.repeat(q, sizes), np.repeat(score, sizes), np.concatenate([ids[i] for i in v])
    order = np.lexsort((found, score, q))
    q, score, found = q[order], score[order], found[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], score[place < k], found[place < k]


def _vectors(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v, key) of the rows that take part, but for their length."""
    element = rows.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if element in ("float", "double") else F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    plain = rows.select(F.col(id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    plain = plain.where(F.forall("v", finite) & F.exists("v", lambda c: c != 0))
    return plain.withColumn("key", F.unhex(F.sha2(F.concat_ws(" ", F.col("v").cast("array<string>")), 256)))


def _index(vectors: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): the distinct vectors with their ``k`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= k)
    return few.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


def _placed(index: DataFrame, router: Router, dims: int) -> DataFrame:
    """``index`` with the part of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(router.home(_matrix(batch["v"], dims)), pa.int32()))

    return index.mapInArrow(run, _schema(index, "part int"))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), more])


def _routed(asking: DataFrame, router: Router, sizes: dict[int, int], least: int, dims: int) -> DataFrame:
    """Each query vector for each part that it asks: the most probable ones, and more until these hold ``least`` vectors."""
    held = np.array([sizes.get(p, 0) for p in range(router.parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-router.scores(_matrix(batch["v"], dims)), axis=1, kind="stable")
            before = held[order].cumsum(1) - held[order]
            row, place = np.nonzero(((np.arange(router.parts) < router.asked) | (before < least)) & (held[order] > 0))
            yield batch.take(pa.array(row)).append_column("part", pa.array(order[row, place], pa.int32()))

    return asking.mapInArrow(run, _schema(asking, "part int"))


def _searched(units: DataFrame, k: int, dims: int) -> DataFrame:
    """(key, score, id) of the nearest to each query in each unit; its vectors come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, x, ids, parts = None, None, [], []
        for batch in batches:
            columns = [batch[c].to_numpy() for c in ("part", "block", "asks")]
            changes = np.zeros(len(batch), bool)
            for c in columns:
                changes[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(changes), len(batch)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                rows, here = batch.slice(a, b - a), (columns[0][a], columns[1][a])
                if here != unit:
                    unit, x, ids, parts = here, None, [], []
                if not columns[2][a]:
                    parts.append(_matrix(rows["v"], dims))
                    ids += [np.array(i) for i in rows["ids"].to_pylist()]
                    continue
                if x is None:
                    x, parts = np.concatenate(parts), []
                queries, step = _matrix(rows["v"], dims), max(1, (1 << 21) // len(x))
                for at in range(0, len(queries), step):
                    q, score, found = nearest_rows(queries[at : at + step], x, ids, k)
                    yield pa.RecordBatch.from_arrays([rows["key"].take(pa.array(q + at)), pa.array(score), pa.array(found)], ["key", "score", "id"])

    return units.mapInArrow(run, "key binary, score double, id long")


def nearest_neighbours(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    query: Column | None = None,
    k: int = K,
    sample: int = SAMPLE,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each row that ``query`` names (ids divisible by 100)."""
    spark = rows.sparkSession
    asks = F.col("id") % 100 == 0 if query is None else query
    some = _vectors(rows, id, vector)
    lengths = some.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    some = some.where(F.size("v") == dims)
    index = materialize(_index(some, k + 1), "index")
    count = index.count()
    drawn = index.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()["v"].combine_chunks()
    router = fit(_matrix(drawn, dims) if count else np.zeros((0, 1)), count, k, recall)
    placed = materialize(_placed(index, router, dims), "placed")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one for each part
    blocks = spark.createDataFrame([(p, -(-n // block)) for p, n in sizes.items()], "part int, blocks int")
    asked = materialize(some.where(asks).groupBy("key", "id").count(), "asked")
    asking = index.select("key", "v").join(asked.select("key").distinct(), "key", "left_semi")
    asking = _routed(asking, router, sizes, k + 1, dims).join(F.broadcast(blocks), "part")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    held = placed.join(F.broadcast(blocks), "part").select("part", mine.alias("block"), F.lit(0).alias("asks"), "key", "v", "ids")
    to_all = asking.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "key", "v", F.lit(None).cast("array<long>").alias("ids"))
    units = held.union(to_all).repartition("part", "block").sortWithinPartitions("part", "block", "asks")
    found = materialize(_searched(units, k + 1, dims), "found")
    place = F.row_number().over(Window.partitionBy("key").orderBy("score", "id"))
    first = found.withColumn("place", place).where(F.col("place") <= k + 1)
    lists = materialize(first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "score", F.col("id").alias("vec_id")))).alias("list")), "lists")
    discard(index, placed, found)
    own = F.array_position(F.transform("list", lambda x: (x["vec_id"] == F.col("id")) & (x["score"] == 0)), True).cast("int")
    others = F.filter("list", lambda x, i: (i + 1 != F.col("own")) & (i < k + (F.col("own") > 0).cast("int")))
    answered = asked.join(lists, "key").withColumn("own", own).select("id", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))), others.alias("list"))
    return answered.select(F.col("id").alias("query_id"), F.posexplode("list").alias("at", "near")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score")
    )
