import random
import sys
from pathlib import Path

import numpy as np

import corpus_pipeline
from replayframe.llm import near_copies
from replayframe.llm.common import materialize

sys.path.insert(0, str(Path(__file__).parent))
from tests_llm_shared import kept_by_brute_force  # noqa: E402


def test_stage_finds_planted_near_copies(spark, monkeypatch):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(40):
        base = rnd.choices(vocabulary, k=rnd.choice((30, 100, 300)))
        rows.append(" ".join(base))
        for changes in (1, 2, 4, 6, 9):
            w = list(base)
            for k in rnd.sample(range(len(w)), changes):
                w[k] = "changed"
            rows.append(" ".join(w))
    dense = rnd.choices(vocabulary, k=120)
    for k in range(60):  # one large group, all of them different
        w = list(dense)
        w[rnd.randrange(120)] = f"x{k}"
        rows.append(" ".join(w))
    rows = list(enumerate([*rows, "", None, " ", "two words", "Two  words"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = kept_by_brute_force(rows)
    assert len(expected) < 250
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()} == expected
    # all shards but the smallest in units of few rows
    monkeypatch.setattr(near_copies, "FEW", 2)
    monkeypatch.setattr(near_copies, "PART", 700)
    monkeypatch.setattr(near_copies, "LEAST", 50)
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()} == expected


def test_stage_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    found = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert {r["doc_id"] for r in found.collect()} == kept_by_brute_force(rows)


def test_alike_texts_without_links_cost_no_pairs(spark, monkeypatch):
    """Random edits of one base, all pairs alike but under 0.8: what is written grows with the texts and not with their pairs."""
    counts = {}

    def counted(df, name, kept=False):
        out = materialize(df, name, kept)
        counts[name] = counts.get(name, 0) + (out.count() if name in ("pairs", "large", "verified") else 0)
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    for size in (400, 800):
        rnd = random.Random(1)
        base = [f"w{k}" for k in range(200)]
        rows = []
        for i in range(size):
            w = list(base)
            for k in rnd.sample(range(200), 6):
                w[k] = f"x{i}y{k}"
            rows.append((i, " ".join(w)))
        counts.clear()
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert near_copies.drop_near_copies(docs).count() == size
        assert counts["pairs"] <= 20 * size and counts["large"] == 0


def test_links_of_a_unit_join_what_all_links_join():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 1 << 62, 90)
    sets = []
    for k in range(120):
        x = base.copy()
        x[rnd.integers(0, 90, k % 14)] = rnd.integers(0, 1 << 62, k % 14)
        sets.append(np.unique(x))
    sets += [np.unique(rnd.integers(0, 1 << 62, 30)) for _ in range(5)]
    labels = np.array([k if k % 3 else 0 for k in range(len(sets))])

    def joined(pairs):
        top = list(range(len(sets)))
        for a, b in [*pairs, *((i, 0) for i in range(len(sets)) if labels[i] == 0)]:
            a, b = top[a], top[b]
            top = [a if t == b else t for t in top]
        groups = {}
        for i, t in enumerate(top):
            groups.setdefault(t, []).append(i)
        return sorted(groups.values())

    alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
    every = [(i, j) for j in range(len(sets)) for i in range(j) if labels[i] != labels[j] and alike(sets[i], sets[j])]
    found = near_copies.unit_links(sets, None, (labels, labels), 0.8)
    assert set(map(lambda x: tuple(sorted(x)), found)) <= set(every) and joined(found) == joined(every)
    across = near_copies.unit_links(sets[:50], sets[50:], (labels[:50], labels[50:]), 0.8)
    assert joined([(a, b + 50) for a, b in across]) == joined([(i, j) for i, j in every if i < 50 <= j])


def test_stage_goes_through_fingerprints_and_trees(spark, monkeypatch):
    """The stage's fingerprints are searched by BK-trees, and what those link is checked by the exact sets."""
    rnd = random.Random(4)
    long, other = (rnd.choices([f"w{k}" for k in range(2000)], k=3000) for _ in range(2))
    # the trees link the first two, whose sets are alike, and not the third
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-1], "last"])), (3, " ".join(other))]
    seen = []

    def watched(fingerprints, *args):
        found = near_copies.simhash_links(fingerprints, *args)
        seen.append((fingerprints.count(), {tuple(sorted(r)) for r in found.collect()}))
        return found

    monkeypatch.setattr(near_copies, "simhash_links", near_copies.links, raising=False)
    monkeypatch.setattr(near_copies, "links", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()} == {1, 3}
    prints = [near_copies.fingerprint(near_copies.shingle_set(t.encode()))[0] for _, t in rows]
    assert len(seen) == 1 and seen[0][0] == len(set(prints))
    if prints[0] != prints[1] and ((prints[0] ^ prints[1]) & ((1 << 64) - 1)).bit_count() <= 2:
        assert seen[0][1] == {tuple(sorted(prints[:2]))}


def test_sets_at_the_threshold_share_a_band_and_others_hardly():
    rnd = np.random.default_rng(9)
    bands = near_copies.band_count(0.8)
    assert (1 - 0.8**near_copies.BAND) ** bands <= 1e-10 and near_copies.band_count(0.5) > bands
    shared = []
    for _ in range(300):
        x = rnd.integers(-(1 << 62), 1 << 62, 900)
        one, two, far = x[:810], np.concatenate([x[90:810], x[810:]]), x[600:]
        keys = [near_copies.band_keys(np.unique(s), bands) for s in (one, two, far)]
        assert all(len(set(k)) == len(k) == bands for k in keys)
        shared.append([np.count_nonzero(keys[0] == k) for k in keys[1:]])
    alike, unlike = np.mean(shared, axis=0) / bands
    assert min(s[0] for s in shared) > 0 and abs(alike - 0.8**near_copies.BAND) < 0.02 and unlike < 0.05
    assert len(near_copies.band_keys(np.array([], np.int64), bands)) == 0
    # stretches that are hashed at once don't show
    long = np.unique(rnd.integers(-(1 << 62), 1 << 62, 3 * near_copies.HASHED // 2))
    assert set(near_copies.band_keys(long, bands)) == set(near_copies.band_keys(long[::-1].copy(), bands))


def test_keys_of_a_text_do_not_grow_with_it(spark):
    """A long text stands in no more shards than a short one: what is written grows with the texts and not with their words in shards."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(size))) for k, size in enumerate((50, 500, 20_000))]
    plain = spark.createDataFrame(rows, "__id long, __text string").selectExpr("__id", "0L as __same", "__text")
    sizes = {len(r["keys"]) for r in near_copies._sets(plain, 5, 0.8).collect()}
    assert sizes == {near_copies.band_count(0.8)}


def test_overlaps_count_rare_pairs_in_stretches(monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRS", 7)
    rnd = np.random.default_rng(2)
    left, right = ([np.unique(rnd.integers(0, 40, 15)) for _ in range(n)] for n in (9, 13))
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert near_copies.overlaps(left, right).astype(int).tolist() == want
