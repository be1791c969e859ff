import inspect
import re
import sys
from hashlib import sha256
from itertools import takewhile
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from replayframe.llm import bpe, common, mixing, queries
from replayframe.llm.common import materialize

sys.path.insert(0, str(Path(__file__).parent))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def test_each_stage_on_what_the_one_before_kept(spark):
    import corpus_pipeline
    from tests_llm_shared import kept_by_brute_force, words

    public = pytest.importorskip("public_tokenizers")
    tokenizer = bpe.tokenizer(public.path("word_bpe_49k.json"))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before, tables = docs.columns, {r.doc_id: r for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == names
        tables[name] = [r.asDict() for r in docs.collect()]
    good = {r["doc_id"]: r for r in tables["quality_rules"]}
    assert 100 < len(good) < len(before) and all(r == before[i].asDict() for i, r in good.items())
    lined = {r["doc_id"]: r for r in tables["line_dedup"]}
    assert lined.keys() == good.keys()
    for i, r in lined.items():
        rest = iter(good[i]["text"].split("\n"))
        assert r["text"] == "" or all(line in rest for line in r["text"].split("\n"))
        assert r["n_chars"] == len(r["text"]) or r["text"] == good[i]["text"]
    assert {r["doc_id"] for r in tables["simhash_near_dedup"]} == kept_by_brute_force(sorted((i, r["text"]) for i, r in lined.items()))
    assert all(r == lined[r["doc_id"]] for r in tables["simhash_near_dedup"])
    sizes, taken = {}, {}
    for t, out in (("simhash_near_dedup", sizes), ("mixing", taken)):
        for r in tables[t]:
            out[r["source"]] = out.get(r["source"], 0) + len(words(r["text"]))
    wanted = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(abs(taken.get(s, 0) - t) <= 2 + t / 100 for s, t in wanted.items())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    want = sorted((r["doc_id"], r["source"], len(ids := tokenizer.encode(r["text"] or "", add_special_tokens=False).ids), sha256(" ".join(map(str, ids)).encode()).hexdigest()) for r in tables["mixing"])
    assert sorted(tuple(r)[:4] for r in last) == want
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, sf).collect()) == want  # reruns agree


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    text = "these are twenty words and more of them that stand in a row so that the rules find enough of them to keep"
    rows = [(None, text, None, "x"), (1, text, "s", "x"), (1, text, "s", "x"), (2, None, "s", "x"), (3, "", "s", "x"), (4, "one two", "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.where("__row = 'x'").count() == out.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns and kept.where("text is null or text = '' or text = 'one two'").count() == 0
    assert corpus_pipeline.tokens_stage(spark, docs, sf).count() == 6


def test_new_words_are_folded_together():
    """Words are told apart from the mark that ends them in one pass over all new ones, and have the tokenizer's ids."""
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    words = {"New", "new", "New.", "new,", "É.", "É", "..", ".", ",", "x", "7.", "a..", "<|x|>.", "Ünd,", "Ω.", "word***", "İ."}
    whole, marked = bpe._plain(path, words)
    assert whole.keys() | marked.keys() == words and not whole.keys() & marked.keys()
    if bpe._habits(path)[1]:
        assert marked["New."] == ("new", ".") and marked["É."] == ("É", ".") and {"..", "7.", "<|x|>.", "Ω."} <= whole.keys()
    known, t = bpe.learn_words(path, words), bpe.tokenizer(path)
    assert all(np.frombuffer(known[w], np.int32).tolist() == t.encode(w, add_special_tokens=False).ids for w in words)


def test_a_text_is_encoded_and_decoded_by_one_worker_that_gets_it_once(spark):
    """workers that wait and texts that cross twice took over 3000 MB of an executor's memory."""
    import corpus_pipeline

    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    t = bpe.tokenizer(path)
    texts = ["One two, <|x|> three.", None, "", "y " * 40, "one two"]
    docs = spark.createDataFrame([(k, "s", x, "old") for k, x in enumerate(texts)], "doc_id long, source string, text string, decoded string")
    found = corpus_pipeline.tokens_stage(spark, docs, "")
    assert found.count() == len(found.collect()) == 5
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = [re.match("[ :]*[+:]- ", x) for x in plan]
    depth = [m.end() if m else 0 for m in depth]
    steps = [k for k, x in enumerate(plan) if "MapInArrow" in x]
    below = {k: list(takewhile(lambda j: depth[j] > depth[k], range(k + 1, len(plan)))) for k in steps}
    # those over no row are of the long texts
    steps = [k for k in steps if not any("EmptyRelation" in plan[j] for j in below[k])]
    assert len(steps) == 1 and not {*below[steps[0]]} & {*below}
    taken, made = re.findall(r"[(\[]([^()\[\]]*)[)\]]", plan[steps[0]])[:2]
    assert taken.count("__text") == 1 and "__text" not in made
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    want = [(k, i, t.decode(i, skip_special_tokens=False)) for k, i in enumerate(ids)]
    for kw in ({}, dict(piece_chars=8, spread_chars=10)):
        kept = bpe.bpe_round_trip(docs, path, **kw)
        assert kept.columns == ["doc_id", "source", "text", "ids", "decoded"]
        assert sorted((r.doc_id, r.ids, r.decoded) for r in kept.collect()) == want
        assert {r.doc_id: r.text for r in kept.collect()} == dict(enumerate(texts))
        bare = bpe.bpe_round_trip(docs.select("text"), path, keep_text=False, **kw)
        assert sorted(map(tuple, bare.collect())) == sorted(w[1:] for w in want)


def test_tasks_give_back_what_arrow_keeps(monkeypatch):
    """when a task ends, and when it is left before its end."""
    calls = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: calls.append(1)))
    run = common.released(lambda batches: (x + 1 for x in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and calls == [1]
    left = run(iter([1, 2]))
    assert next(left) == 2 and calls == [1]
    left.close()
    assert calls == [1, 1]


def test_near_dedup_hands_few_texts_to_python_at_once(spark, monkeypatch, tmp_path):
    """an executor and its workers held ten thousand texts or sets several times, and it kept parts of such buffers."""
    import corpus_pipeline
    from replayframe.llm import line_templates, near_copies

    def watched(run):
        def noted(batches):
            for batch in batches:
                with (tmp_path / "bytes").open("a") as f:
                    f.write(f"{batch.nbytes}\n")
                yield batch

        return common.released(lambda batches: run(noted(batches)))

    for module in (near_copies, line_templates):
        monkeypatch.setattr(module, "released", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(k, "s", " ".join(f"w{(k * 7919 + j * j) % 100003}" for j in range(k % 2, 400))) for k in range(4000)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1), "few")
    for stage in (corpus_pipeline.lines_stage, corpus_pipeline.near_duplicates_stage):
        assert stage(spark, docs, "").schema == docs.schema
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
        sizes = [int(x) for x in (tmp_path / "bytes").read_text().split()]
        assert sum(sizes) > 8 << 20 and max(sizes) < 3 << 20
        (tmp_path / "bytes").unlink()
