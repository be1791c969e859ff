import json
import time
import zipfile

from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringStartsWith

from replayframe.sources.archive import ArchiveDirectory, ArchiveSource, DirectoryReader, PushedReader
from replayframe.streaming.listener import BatchProgress


def write(path, names, mode="w"):
    with zipfile.ZipFile(path, mode) as z:
        for n in names:
            z.writestr(n, f"text of {n}\n" * 20)


def names(reader):
    return [m.name for p in reader.partitions() for m in p.members]


def test_filters_reach_the_directory(tmp_path):
    path = tmp_path / "a.zip"
    write(path, [f"data/t{k % 3}/{k}.phh" for k in range(30)])
    options = {"path": str(path)}
    reader = PushedReader(options)
    left = list(reader.pushFilters([StringStartsWith(("member",), "data/t1/"), LessThan(("position",), 20), GreaterThan(("member",), "data"), EqualTo(("content",), "x")]))
    assert left == [GreaterThan(("member",), "data"), EqualTo(("content",), "x")]
    assert names(reader) == [f"data/t1/{k}.phh" for k in range(30) if k % 3 == 1 and k < 20]
    reader = PushedReader(options)
    assert list(reader.pushFilters([In(("member",), ("data/t0/3.phh", "none"))])) == [] and names(reader) == ["data/t0/3.phh"]
    limited = PushedReader({**options, "limit": "5"})
    asked = [StringStartsWith(("member",), "data/t1/")]
    assert list(limited.pushFilters(asked)) == asked and len(names(limited)) == 5
    # the directory opens no member
    path.rename(tmp_path / "moved.zip")
    reader = DirectoryReader({"path": str(tmp_path / "moved.zip")})
    parts = reader.partitions()
    (tmp_path / "moved.zip").unlink()
    assert len([r for p in parts for r in reader.read(p)]) == 30


def test_scans(spark, tmp_path):
    path = tmp_path / "a.zip"
    write(path, [f"data/t{k % 3}/{k}.phh" for k in range(30)])
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(ArchiveDirectory)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    want = sorted(f"data/t2/{k}.phh" for k in range(30) if k % 3 == 2 and k < 15)
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            for kind in ("archive_members", "archive_directory"):
                df = spark.read.format(kind).options(path=str(path), push_filters=on).load().where("member like 'data/t2/%' and position < 15")
                assert sorted(r.member for r in df.collect()) == want
    finally:
        spark.conf.set(key, before)


def test_a_growing_archive_as_a_stream(spark, tmp_path):
    path, out = tmp_path / "a.zip", tmp_path / "out"
    spark.dataSource.register(ArchiveSource)
    progress = BatchProgress(str(tmp_path / "progress.jsonl"))
    spark.streams.addListener(progress)
    try:
        for first, last in ((0, 4), (4, 4), (4, 9)):
            write(path, [f"{k}.phh" for k in range(first, last)], "a" if path.exists() else "w")
            rows = spark.readStream.format("archive_members").option("path", str(path)).load()
            query = rows.writeStream.queryName("members").format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(out))
            query.awaitTermination(90)
            found = [r.member for r in spark.read.parquet(str(out)).collect()]
            assert sorted(found) == sorted(f"{k}.phh" for k in range(last))
        for _ in range(50):
            if len(progress.rows) >= 2:
                break
            time.sleep(0.2)
        counts = {(r.batch, r.rows) for r in progress.counts(spark).collect() if r.rows}
        assert counts == {(0, 4), (1, 5)}
        assert [json.loads(x)["query"] for x in (tmp_path / "progress.jsonl").read_text().splitlines()][0] == "members"
    finally:
        spark.streams.removeListener(progress)
