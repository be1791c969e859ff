import pytest

from replayframe.llm import line_templates


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n", [200, 2000, 20000])
def test_fields_with_many_values_stay_variable(spark, n):
    def word(k):
        return "".join(chr(97 + int(d)) for d in str(k))

    lines = [f"Posted by user n{word(k * 37 % 100)} from c{word(k * 61 // 7 % 100)} today" for k in range(n)]
    rows = docs(spark, [f"{x}\nown{word(k)} line" for k, x in enumerate(lines)])
    got = {r["doc_id"]: r["text"] for r in line_templates.without_recurring_lines(rows).collect()}
    # only the first text of the template, or of each of a few, keeps its line
    assert sum(1 for t in got.values() if t.startswith("Posted")) == 1
    assert all(t.endswith("line") for t in got.values())


def test_long_identical_lines_need_few_texts(spark):
    def line(name, n):
        return " ".join(f"{name}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))

    long, mid, short = line("l", 50), line("m", 12), line("s", 3)
    texts = [f"{line(chr(97 + k) * 3, 4)}\n" + "\n".join([long] * (k < 2) + [mid] * (k < 9) + [short] * (k < 9)) for k in range(9)]
    got = {r["doc_id"]: r["text"] for r in line_templates.without_recurring_lines(docs(spark, texts)).collect()}
    assert got[0] == texts[0]
    assert not any(long in t or mid in t for k, t in got.items() if k)
    assert all(short in t for t in got.values())  # three words in nine texts don't recur


def test_pipeline_keeps_near_copies_whole_for_near_dedup(spark):
    import corpus_pipeline

    body = [" ".join(f"{a}{chr(97 + k)}" for k in range(24)) for a in "abcdefgh"]
    rows = docs(spark, ["\n".join(body), "\n".join(body).replace("ca", "other"), f"own words stand here\n{body[0]}"])
    lines = corpus_pipeline.lines_stage(spark, rows, "")
    assert {r["doc_id"]: r["text"].count("\n") for r in lines.collect()} == {0: 7, 1: 7, 2: 0}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates_stage(spark, lines, "").collect()} == {0, 2}
