"""Operators of the corpus subpackage against brute force on small tables."""

import hashlib
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replayframe.llm import bpe, html_extract, line_templates, mixing, quality_rules, simhash, spotsigs, substrings, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __text string, window string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def table(spark, texts):
    rows = [(i, t, "en", s, None if t is None else len(t), "own", "own") for i, t, s in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "der", "la"] + [f"w{k}x" for k in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    out = [(k, make(rng.randint(1, 80)), f"s{k % 3}") for k in range(30)]
    out += [(100 + k, make(30) + " " + passage + "\n" + make(10), "s0") for k in range(4)]
    out += [(200, out[3][1], None), (201, out[3][1], "s1"), (202, "", "s1"), (203, None, "s2"), (204, " \n\t ", "s2"), (None, make(40), "s0"), (205, make(25) + " " + passage + " " + passage, "s1"), (206, make(20_000), "s2"), (201, out[3][1], "s1")]
    return out


def test_substrings_match_brute_force(spark, texts):
    found = {(r["doc_id"], r["kept"], r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(table(spark, texts)).collect()}
    last = (1 << 63) - 1
    seen, want = {}, set()
    split = [(last if i is None else i, i, words(t)) for i, t, _ in texts]
    for key, _, ws in sorted(split, key=lambda x: x[0]):
        for k in range(len(ws) - 19):
            seen.setdefault(tuple(ws[k : k + 20]), (key, k))
    for key, i, ws in split:
        gone = set()
        for k in range(len(ws) - 19):
            if seen[tuple(ws[k : k + 20])] < (key, k):
                gone.update(range(k, k + 20))
        want.add((i, " ".join(w for k, w in enumerate(ws) if k not in gone), len(ws), len(gone)))
    assert found == want


def test_substrings_on_an_empty_table(spark, texts):
    assert substrings.drop_repeats(table(spark, [])).count() == 0


def test_simhash_matches_brute_force(spark, texts):
    import xxhash

    def fingerprint(t):
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not ws:
            return 0
        runs = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or [" ".join(ws)]
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    near = texts + [(300, texts[35][1] if texts[35][1] else "x", "s0")]
    fps = [(i, fingerprint(t)) for i, t, _ in near]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                ga, gb = group[a], group[b]
                group = [gb if g == ga else g for g in group]
    least = {}
    for (i, _), g in zip(fps, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(repr((i, f"{f:016x}", least.get(g))) for (i, f), g in zip(fps, group))
    found = simhash.near_duplicates(table(spark, near)).select("doc_id", simhash.as_hex(F.col("__fp")), "component_id").collect()
    assert sorted(repr(tuple(r)) for r in found) == want


def test_simhash_links_lose_no_component(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values |= {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(20)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    # shards of four make every unit of a split shard run
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard=4).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)

    def components(pairs):
        up = {v: v for v in values}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(v) for v in values]

    assert components(found) == components([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])


def test_near_duplicates_keep_one_row(spark, texts):
    kept = simhash.drop_near_duplicates(table(spark, texts))
    assert kept.columns == table(spark, texts).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 200 not in ids and 201 not in ids
    assert simhash.drop_near_duplicates(table(spark, [])).count() == 0


def test_line_templates(spark):
    own = [f"alpha{chr(97 + k % 26)} beta{chr(97 + k // 26)} gamma" for k in range(40)]
    rows = [(k, f"Visit page {k} of our shop today\n{own[k]} nothing else is shared\nshort one", "s") for k in range(40)]
    rows += [(100, rows[5][1], "s"), (101, None, "s"), (102, "", "s"), (None, "plain line alone here", "s"), (103, "\n\n", None)]
    rows += [(200 + k, "copied line one stays here\ncopied line two stays here", "s") for k in range(15)]
    got = {r["doc_id"]: r for r in line_templates.without_recurring_lines(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[0]["text"] == rows[0][1]  # the first document keeps its own
    assert got[7]["text"] == f"{own[7]} nothing else is shared\nshort one" and got[7]["n_chars"] == len(got[7]["text"])
    assert got[100]["text"] == got[5]["text"]  # copies lose the same lines
    assert got[203]["text"] == rows[-1][1]  # copies count as one text
    assert got[101]["text"] is None and got[102]["text"] == "" and got[None]["text"] == "plain line alone here"
    assert line_templates.without_recurring_lines(table(spark, [])).count() == 0


def test_quality_statistics(spark, texts):
    some = texts + [(400, "a b c d e f g h a b c d e f g h #x", "s"), (401, "same line\nsame line\n\nother", "s"), (402, "é ÉÉ 12 $$", "s")]
    rows = quality_rules.with_statistics(table(spark, some).select("doc_id", F.col("text").alias("t")), "t").collect()
    by = {r["doc_id"]: r for r in rows}
    for i, t, _ in some:
        ws, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        spots = {}
        for k in range(len(ws) - 7):
            spots.setdefault(tuple(ws[k : k + 8]), []).append(k)
        covered = {k + j for ks in spots.values() if len(ks) > 1 for k in ks for j in range(8)}
        r = by[i]
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) == (
            len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), i


def test_quality_learns_a_planted_rule(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        ws = [f"w{rng.randrange(500)}" + ("###" if bad else "") for _ in range(60)]
        docs.append((k, " ".join(ws), "s"))
        labels.append((k, 0 if bad else 1))
    labels = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.keep_good(table(spark, docs + [(900, None, "s")]), labels).collect()}
    assert kept == {k for k in range(300) if k % 4}
    assert quality_rules.keep_good(table(spark, docs), labels.limit(0)).count() == 300
    assert quality_rules.quality(table(spark, []), labels).count() == 0


def test_mixing_reaches_targets(spark, texts):
    some = [(k, " ".join(["w"] * (5 + k % 40)), f"s{k % 4}" if k % 9 else None) for k in range(400)] + [(500, None, "s1"), (501, "", None), (7, "w " * 12, "s3")]
    rows = mixing.mix(table(spark, some)).collect()
    assert len(rows) == len(some) and [sorted(map(repr, rows))] == [sorted(map(repr, mixing.mix(table(spark, some).repartition(5)).collect()))]
    total = sum(r["size"] for r in rows)
    taken, target, sizes = {}, {}, {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]], sizes[r["source"]] = r["target"], r["source_size"]
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(t <= 3 * sizes[s] + 1e-6 for s, t in target.items())
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 60 for s in target)
    made = mixing.mixed_documents(table(spark, some)).collect()
    assert sum(len(words(r["text"])) for r in made) == sum(r["taken"] for r in rows)
    assert mixing.mix(table(spark, [])).count() == 0


def highest(shares, seats):
    quotients = sorted((-s / (2 * j + 1), k) for k, s in enumerate(shares) for j in range(seats + 2))[:seats]
    return {k: sum(1 for _, x in quotients if x == k) for k in range(len(shares))}


def test_sainte_lague_matches_highest_quotients(spark):
    rng = random.Random(8)
    cases = [[7.3, 2.2, 2.2, 0.3, 8.0], [0.4] * 10, [0.6] * 10, [0.0, 5.2], [rng.random() * 9 for _ in range(60)], [rng.random() * 0.9 for _ in range(200)], [40.4] + [0.45] * 30]
    for shares in cases:
        for seats in {round(sum(shares)), round(sum(shares)) + 3, max(0, round(sum(shares)) - 2)}:
            df = spark.createDataFrame([(0, k, s, seats) for k, s in enumerate(shares)], "g int, p int, share double, seats long")
            for within in (["g"], []):
                found = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, within, "p", "share", "seats").collect()}
                assert found == highest(shares, seats), (shares, seats, within)


def test_many_shards_are_apportioned_quickly(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(0).alias("g"), (F.col("id") / 512).cast("int").alias("h"), "id", F.lit(0.49).alias("share"))
    seats = df.groupBy("h").agg(F.round(F.sum("share")).cast("long").alias("seats"))
    began = time.perf_counter()
    found = mixing.sainte_lague(df.join(seats, "h"), ["h"], "id", "share", "seats").agg(F.sum("quota").alias("q"), F.max("quota").alias("m")).first()
    assert abs(found["q"] - 0.49 * n) < 200 and found["m"] == 1
    assert time.perf_counter() - began < 10


def test_small_sources_reach_their_targets(spark):
    # beside a large source, those of few words: no block of the mix is too large for them
    some = [(k, " ".join(["w"] * 3000), "big") for k in range(300)] + [(1000, "w " * 7, "a"), (1001, "w " * 170, "b"), (1002, "w " * 1025, "c"), (1003, "w", "d")]
    taken, target = {}, {}
    for r in mixing.mix(table(spark, some)).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert target["a"] == 21 and all(abs(taken[s] - target[s]) <= 1 + target[s] / 256 for s in target), (taken, target)


def test_targets_match_brute_force(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 40):
        sizes = [(f"s{k:03}" if k else None, rng.choice([0, 1, 5, 100, 10_000])) for k in range(n)]
        order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
        cap, full = {s: 3 * z for s, z in sizes}, set()
        total = sum(z for _, z in sizes)
        while True:
            rest = total - sum(cap[s] for s in full)
            share = {s: rest * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in weight if s not in full}
            over = {s for s, t in share.items() if t > cap[s]}
            if not over:
                break
            full |= over
        want = {s: float(cap[s]) if s in full else share[s] for s in weight}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want), (got, want)


def test_bpe_is_exact(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    odd = ["it's DON'T é x", "a" * 5000, "<|endoftext|>hi<|startoftext|>", "\x1c\x1d mixed space x", "".join(rng.choice("abé1'!<| ") for _ in range(9000)), "日本語テキスト" * 900, "!" * 3000]
    some = texts + [(600 + k, x, "s") for k, x in enumerate(odd)]
    want = {}
    for i, x, _ in some:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, x] = (ids, t.decode(ids, skip_special_tokens=False))
    for kw in ({}, dict(piece_chars=512, spread_chars=2000)):
        done = bpe.bpe_decode(bpe.bpe_encode(table(spark, some), path, **kw), path).collect()
        assert len(done) == len(some)
        for r in done:
            assert (r["ids"], r["decoded"]) == want[r["doc_id"], r["text"]], r["doc_id"]


def test_html(spark):
    page = (
        '<html><head><title>t</title></head><body><nav><a href=x>menu, one, two</a></nav><div class="ad">buy, now</div>'
        "<article><h1>Head &amp; line</h1><p>First   para,\n with commas, and <a href=y>a link</a>, more words to be long enough.</p>"
        "<p>Second para, also here.</p><aside>side</aside></article><div class=comments><p>nice, post</p></div><footer>foot</footer></body></html>"
    )
    rows = [(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, "just text", "u"), (5, "<p>one<p>two", "u"), (6, "<div>" * 3000 + "deep", "u"), (1, page, "u")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_html(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    assert got[1] == "Head & line\n\nFirst para, with commas, and a link, more words to be long enough.\n\nSecond para, also here."
    assert got[2] == "" and got[3] == "" and got[4] == "just text" and got[6] == "deep"


def test_url_rules(spark):
    rules = spark.createDataFrame([("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")], "verdict string, host string, path string")
    urls = ["http://WWW.Example.com/en/x?y", "http://a.example.com/en/", "https://example.com/fr", "http://x.net/es/1", "http://xnet/es/1", "no url", None, "", "http://com", "ftp://a.b.net/es", "http://x.net/es/1"]
    rows = [(k, u, "own", "own") for k, u in enumerate(urls)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, other string"), rules).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3][2:] == ("net/es/", "block") == got[10][2:] and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow") and got[8] == ("com", "", None, "allow") and got[9][2] is None


def spots(t):
    ws = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    common = set(spotsigs.COMMON_WORDS)
    some = any(w in common for w in ws)
    out = set()
    for k, w in enumerate(ws):
        if some and w not in common:
            continue
        chain = [x for x in ws[k + 1 : k + 13] if not some or x not in common][:2]
        if len(chain) == 2:
            out.add((w, *chain))
    return out or ({tuple(ws)} if ws else set())


def test_spotsigs_match_brute_force(spark, texts):
    found = spotsigs.fingerprints_and_edits(table(spark, texts)).withColumn("near", spotsigs.jaccard(F.col("signatures"), F.col("edited_signatures"))).collect()
    assert len(found) == len(texts)
    order = sorted(((1 << 63) - 1 if i is None else i, i, t or "") for i, t, _ in texts)[::-1]
    after = {x[1]: order[(k + 1) % len(order)][2] for k, x in enumerate(order) if x[1] != 201}
    for r in found:
        t, own = r["text"], spots(r["text"])
        assert len(r["signatures"]) == len(own)
        edit = spots(r["edited"])
        if own or edit:
            assert abs(r["near"] - len(own & edit) / len(own | edit)) < 1e-9
        if r["doc_id"] in after:
            k = len(t) // 3
            assert r["edited"] == t[: len(t) - k] + after[r["doc_id"]][:k]
    assert spotsigs.fingerprints_and_edits(table(spark, [])).count() == 0


def test_spotsigs_classes_match_brute_force(spark, texts):
    rows = texts + [(400, texts[35][1] or "x", "s"), (401, texts[31][1].replace("w1x", "other"), "s"), (402, texts[31][1] + " the end of it", "s")]
    sets = [(i, frozenset(spots(t))) for i, t, _ in rows]
    near = lambda x, y: x == y or (x and y and len(x & y) / len(x | y) >= 0.8)
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if near(sets[a][1], sets[b][1]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = []
    for (i, x), g in zip(sets, group):
        ids = [j for (j, _), h in zip(sets, group) if h == g and j is not None]
        want.append(repr((i, min(ids, default=None), len({y for _, y in sets if y != x and near(x, y)}))))
    assert sorted(repr(tuple(r)) for r in spotsigs.near_classes(table(spark, rows)).collect()) == sorted(want)
    assert spotsigs.near_classes(table(spark, [])).count() == 0


def test_spotsigs_pairs(spark):
    rng = random.Random(5)
    sets = []
    for k in range(60):
        base = rng.sample(range(1000), rng.randint(5, 40)) if k % 3 == 0 else base
        sets.append((k, sorted({*base, *(rng.sample(range(1000), k % 3))})))
    found = {(r["a"], r["b"]) for r in spotsigs.near_pairs(spark.createDataFrame(sets, "id long, signatures array<long>")).collect()}
    near = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) >= 0.8
    assert found == {(a, b) for a, x in sets for b, y in sets if a < b and near(x, y)}


def test_toxicity_learns_and_is_calibrated(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(400):
        ws = [f"w{rng.randrange(200)}x" for _ in range(40)]
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            ws.insert(rng.randrange(40), rng.choice(["grumblefool", "you", "nastyword"]))
        docs.append((k, " ".join(ws), "s"))
        labels.append((k, int(toxic)))
    docs += [(900, None, "s"), (901, "", "s"), (0, docs[0][1], "s")]
    model = toxicity.learn(table(spark, docs), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = model.score(table(spark, docs)).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    wrong = sum((r["score"] >= 0.3) != (r["doc_id"] % 5 == 0) for r in got if r["doc_id"] < 400)
    assert wrong <= 8
    none = toxicity.learn(table(spark, docs), spark.createDataFrame([], "doc_id long, toxic int")).score(table(spark, docs))
    assert {r["score"] for r in none.collect()} == {0.0}


def test_crc_matches_zlib(spark):
    import zlib

    r = spark.range(20).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(x["c"] == zlib.crc32(str(x["id"]).encode()) for x in r)
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_decode_of_odd_lists():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    t = bpe.tokenizer(path)
    kind = pa.list_(pa.int32())
    for rows in ([[1, 2, 49406], [], [49407, 300]], [[5], None], [[999_999, 5]], [], [[]]):
        want = t.decode_batch([x or [] for x in rows], skip_special_tokens=False)
        assert bpe.decode_lists(path, pa.array(rows, kind)).to_pylist() == want
    part = pa.array([[1], [2, 3], [], [4, 49406]], kind).slice(1, 3)
    assert bpe.decode_lists(path, part).to_pylist() == t.decode_batch(part.to_pylist(), skip_special_tokens=False)
