import pytest
from pyspark.sql import functions as F

from replayframe.operators import artifacts, batches, fingerprints, reports, selection, splits
from replayframe.operators.manifest import split_group
from replayframe.sources import jsonl
from replayframe.sources import splits as split_files
from replayframe.streaming.progress import observed


def test_split_group(spark):
    rows = spark.createDataFrame([("data/p/x/1.phh", "p"), ("data/p/1.phh", "p"), ("data/q/x/1.phh", "q")], "m string, s string")
    assert [r[0] for r in rows.select(split_group(F.col("m"), F.col("s"), "p")).collect()] == ["data/p/x", "data/p/1.phh", "data/q/x/1.phh"]


def test_selection_and_contract(spark):
    rows = [(f"data/p/g{k % 5}/{k}.phh", None, "NT", "no_limit", "texas_holdem", 6 if k else None, "p", 100) for k in range(21)]
    manifest = spark.createDataFrame(rows, "member string, parse_error string, variant string, betting_structure string, game_type string, player_count int, source_folder string, uncompressed_size long")
    chosen = selection.select(manifest, "p", "s", 0.2, 0.2)
    assert chosen.count() == 20 and chosen.select("split_group", "split").distinct().count() == 5
    assert {r["split"]: r["count"] for r in chosen.groupBy("split").count().collect()} == {"train": 12, "val": 4, "test": 4}
    counts = {(r.dimension, r.key): r.n for r in selection.selection_summary(manifest, chosen).collect()}
    assert counts["rejected", "player_count"] == 1 and counts["split", "val"] == 4 and counts["source", "p"] == 20
    assert selection.contract_gate(chosen, F.col("source_folder") == "p").count() == 20
    with pytest.raises(Exception, match="breaks the contract"):
        selection.contract_gate(manifest, F.col("player_count") == 6).collect()
    with pytest.raises(Exception, match="longer than 3"):
        selection.block_guard(spark.createDataFrame([(1, 4)], "k int, n int"), "n", 3).collect()


def test_shares_of_a_split_are_checked(spark):
    df = spark.createDataFrame([("a",)], "g string")
    for val, test in ((1.0, 0.0), (-0.1, 0.1), (0.6, 0.4)):
        with pytest.raises(ValueError):
            splits.split_groups(df, "g", "s", val, test)
    assert splits.split_groups(df.limit(0), "g", "s").count() == 0


def test_batches_have_each_row_once(spark):
    lengths = [9, 1, 8, 2, 7, 3, 6, 4, 5, 10, 12]
    rows = spark.createDataFrame(list(enumerate(lengths)), "k int, n int")
    made = batches.length_batches(rows, "k", "n", 3, 6, "s").collect()
    by = {}
    for r in made:
        by.setdefault(r.batch, []).append(r.k)
    assert sorted(k for ks in by.values() for k in ks) == list(range(11)) and sorted(map(len, by.values())) == [2, 3, 3, 3]
    again = batches.length_batches(rows.repartition(3), "k", "n", 3, 6, "s").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))
    order = sorted({r.batch_order for r in made})
    rest = batches.after_cursor(batches.length_batches(rows, "k", "n", 3, 6, "s"), order[1])
    assert {r.batch_order for r in rest.collect()} == set(order[2:])
    assert batches.length_batches(rows, "k", "n", 3, 6, "s", drop_last=True).count() == 9
    assert {r.batch_order for r in batches.length_batches(rows, "k", "n", 3, 6, "s", epoch=1).collect()} != set(order)
    with pytest.raises(ValueError):
        batches.length_batches(rows, "k", "n", 4, 6, "s")


def test_lines_of_json(spark, tmp_path):
    path = str(tmp_path / "rows")
    jsonl.write_lines(spark.createDataFrame([(2, "b"), (1, None)], "z int, a string"), path)
    (tmp_path / "rows" / "part-x.json").write_text("\n" + '{"a":"c","z":3}\n{"a":"b","z":2}\n{"a":"d","z":\n')
    fixed = jsonl.repaired(spark, path, "a string, z int", ["z"])
    assert sorted((r.z, r.a) for r in fixed.collect()) == [(1, None), (2, "b"), (3, "c")]
    with pytest.raises(Exception):
        jsonl.read_lines(spark, path, "a string, z int").collect()
    jsonl.write_lines(fixed.limit(0).unionByName(spark.createDataFrame([("q", 9)], "a string, z int")), str(tmp_path / "new"))
    assert [(r.a, r.z) for r in jsonl.read_lines(spark, str(tmp_path / "new"), "a string, z int").collect()] == [("q", 9)]


def test_split_files(spark, tmp_path):
    path = str(tmp_path / "splits")
    rows = [(k, [1, *[5] * (k % 3), 2], [0] * (k % 3 + 2), ("train", "val", "test")[k % 3]) for k in range(9)]
    df = spark.createDataFrame(rows, "position long, ids array<int>, loss_mask array<int>, split string")
    split_files.write_splits(df, path)
    found = split_files.read_split(spark, path, "val", 8).orderBy("position").collect()
    assert [r.start for r in found] == [0, 3, 6] and split_files.read_all(spark, path, 8).count() == 9
    with pytest.raises(PermissionError):
        split_files.read_split(spark, path, "test", 8)
    with pytest.raises(Exception, match="fit"):
        split_files.read_split(spark, path, "val", 1).collect()
    split_files.write_splits(df.withColumn("loss_mask", F.slice("loss_mask", 1, 1)), path)
    with pytest.raises(Exception, match="fit"):
        split_files.read_split(spark, path, "train", 8).collect()


def test_report_stays_as_it_is(spark, tmp_path):
    found = spark.createDataFrame([("b", 0.5, None), ("a", 1.0, 3)], "name string, share double, n int")
    path = str(tmp_path / "report")
    reports.write_report(found, path, "Shares", ["name"])
    lines = [r[0] for r in spark.read.text(f"{path}/markdown").collect()]
    assert lines[-2:] == ["| a | 1.0000 | 3 |", "| b | 0.5000 | n/a |"]
    with pytest.raises(Exception):
        reports.write_report(found, path, "Shares", ["name"])
    reports.write_report(found, path, "Shares", ["name"], replace=True)


def test_digests_of_files(spark, tmp_path):
    import hashlib

    for name, text in (("b.bin", b"two"), ("a.bin", b"one!")):
        (tmp_path / name).write_bytes(text)
    found = fingerprints.combined(fingerprints.digests(spark.read.format("binaryFile").load(str(tmp_path)))).first()
    lines = "".join(f"{n}\0{len(t)}\0{hashlib.sha256(t).hexdigest()}\n" for n, t in (("a.bin", b"one!"), ("b.bin", b"two")))
    assert (found.files, found.size, found.digest) == (2, 7, hashlib.sha256(lines.encode()).hexdigest())


def test_progress_is_counted(spark):
    df, seen = observed(spark.createDataFrame([(1, None), (2, "x")], "k int, error string"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "errors": 1}


def test_stored_sequences(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, ids array<int>")
    found = artifacts.compare_stored(make([(1, [1]), (2, [2]), (3, [3])]), make([(1, [1]), (2, [9]), (4, [4])]), ["k"], ["ids"])
    assert sorted(map(tuple, found.collect())) == [(2, "different"), (3, "missing"), (4, "unexpected")]
