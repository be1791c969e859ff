import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from replayframe.llm import learned_partitions as lp
from replayframe.llm import queries

SCHEMA = "vec_id long, embedding array<float>"


def takes_part(row, dims):
    i, v = row
    return i is not None and v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v) and any(v)


def plain(rows, dims, k=10, query=lambda i: i % 100 == 0):
    """Every query against every row; lists of (query, rank, id, score)."""
    some = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if takes_part((i, v), dims)]
    out = []
    for n, (i, q) in enumerate(some):
        if query(i):
            near = []
            for m, (j, v) in enumerate(some):
                if m != n:
                    total = 0.0
                    for a, b in zip(q, v):
                        total += (a - b) ** 2
                    near.append((float(np.sqrt(total)), j))
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def recall(found, wanted):
    want = Counter((q, j) for q, _, j, _ in wanted)
    return sum((want & Counter((q, j) for q, _, j, _ in found)).values()) / max(1, sum(want.values()))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    # on a grid, so that there are many ties; some vectors are many times there
    out = [(k, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for k in range(900)]
    out += [(k, [1.0, 2.0, 0.0, -1.0]) for k in range(900, 1300)]
    out += [(1300, None), (1400, [0.0] * 4), (1500, [1.0, None, 0.0, 0.0]), (1600, [float("nan"), 1.0, 1.0, 1.0]), (1700, [float("inf"), 0.0, 0.0, 1.0])]
    out += [(None, [1.0, 1.0, 1.0, 1.0]), (1800, [1.0, 1.0]), (1900, []), (300, out[300][1]), (-100, [9.0, 9.0, 9.0, 9.5]), (-3, [-0.0, 0.0, 0.0, 1.0])]
    return [*out, out[200], out[207]]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, 4)
    assert len(want) == 10 * sum(takes_part(r, 4) and r[0] % 100 == 0 for r in rows)
    # as many parts as hold all neighbours of the sample
    assert got(lp.nearest_neighbours(df, recall=1.0)) == want
    clashing = df.select("*", *[F.lit(f"mine {n}").alias(n) for n in ("id", "v", "key", "part", "block", "asks", "ids", "place", "rank", "score", "query_id", "list", "own")])
    assert got(lp.nearest_neighbours(clashing, recall=1.0, block=50, query=F.col("id") % 50 == 0, k=3)) == plain(rows, 4, 3, lambda i: i % 50 == 0)
    some = got(lp.nearest_neighbours(df, block=64))
    assert recall(some, want) >= 0.9 and len(some) == len(want)


def test_few_rows(spark):
    few = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.5])]
    assert got(lp.nearest_neighbours(spark.createDataFrame(few, SCHEMA))) == plain(few, 2)
    assert got(lp.nearest_neighbours(spark.createDataFrame(few[:1], SCHEMA))) == []
    assert got(lp.nearest_neighbours(spark.createDataFrame([], SCHEMA))) == []
    assert got(lp.nearest_neighbours(spark.createDataFrame([(0, None), (None, [1.0])], SCHEMA))) == []
    doubles = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in lp.nearest_neighbours(doubles).collect()] == [(1, float("inf")), (2, float("inf"))]
    ints = spark.createDataFrame([(0, [3, 0]), (1, [0, 4])], "vec_id int, embedding array<int>")
    assert got(lp.nearest_neighbours(ints)) == [(0, 1, 1, 5.0)]


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, found = plain(rows, 64), got(queries.op13_neighbours(spark, sf))
    assert len(found) == len(want) and recall(found, want) >= 0.9
    exact = {(q, j): s for q, _, j, s in plain(rows, 64, len(rows))}
    assert all(s == pytest.approx(exact[q, j], rel=1e-14) for q, _, j, s in found)


def clusters(size, dims=16, seed=2):
    rnd = np.random.default_rng(seed)
    return rnd.standard_normal((60, dims))[rnd.integers(0, 60, size)] + 0.25 * rnd.standard_normal((size, dims))


def test_parts_of_a_graph_are_balanced_and_keep_neighbours_together():
    x = clusters(3000)
    graph = lp.nearest_in(x, np.arange(3000), 10)
    for parts in (8, 13):
        part = lp.balanced_parts(graph, parts)
        sizes = np.bincount(part, minlength=parts)
        assert sizes.max() - sizes.min() <= 3000 / parts * 0.02 + 4
        assert (part[graph] == part[:, None]).mean() > 0.8


def test_few_parts_are_asked_where_there_are_clusters(spark):
    x = clusters(12_000).astype(np.float32)
    router = lp.fit(x.astype(np.float64)[:6000], 40_000)
    assert router.parts == 39 and router.asked <= 12
    home = np.bincount(router.home(x.astype(np.float64)), minlength=router.parts)
    assert home.max() < 5 * home.mean()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA)
    found = [tuple(r) for r in lp.nearest_neighbours(df, sample=4000).collect()]
    exact = []
    for q in range(0, 12_000, 100):
        d = np.sqrt(((x[q].astype(np.float64) - x) ** 2).sum(1))
        d[q] = np.inf
        exact += [(q, 0, int(j), 0) for j in np.argsort(d)[:10]]
    assert recall(found, exact) >= 0.9
