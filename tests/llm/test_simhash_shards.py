import random
import time

from replayframe.llm import simhash


def components(pairs, values):
    top = {v: v for v in values}

    def of(v):
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    for a, b in pairs:
        a, b = sorted((of(a), of(b)))
        top[b] = a
    return {v: of(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_large_shards_lose_no_link(spark):
    rnd = random.Random(4)
    fixed = rnd.getrandbits(32) << 32  # two bands that all have
    values = {fixed | rnd.getrandbits(32) for _ in range(200)}
    for v in list(values):
        for _ in range(3):
            values.add(v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    values = sorted(signed(v) for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    every = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & simhash.MASK).bit_count() <= 2]
    for shard in (7, 1024):
        found = [tuple(r) for r in simhash.links(df, shard=shard).collect()]
        assert components(found, values) == components(every, values)


def test_many_alike_fingerprints(spark):
    rnd = random.Random(5)
    fixed = rnd.getrandbits(32) << 32
    df = spark.createDataFrame([(signed(fixed | x),) for x in rnd.sample(range(1 << 32), 20_000)], "fp long")
    began = time.perf_counter()
    simhash.links(df).count()
    assert time.perf_counter() - began < 60
