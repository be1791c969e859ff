from replayframe.operators.manifest import manifest
from replayframe.streaming.append import append_new

MEMBERS = "member string, position bigint, compressed_size bigint, uncompressed_size bigint, crc32 string, content string, bytes_read bigint, error string"


def test_manifest(spark):
    one = "variant = 'nt'\nstarting_stacks = []\nplayers = ['a', 'b', 'c']\n"
    rows = [
        ("Data/p/x/1.phh", 0, 10, 25, "00", one, 25, None),
        ("2.phhs", 1, 10, 100, "00", "[a]\nvariant = 'FT'\nstarting_stacks = [1, 2]\n[b]\n", 40, None),
        ("data/q/3.phhs", 2, 0, 90, "00", "nothing", 7, None),
        ("data/q/4.phh", 3, 0, 0, "00", None, 0, "empty_member"),
        ("data/q/5.phh", 4, 1, 9, "00", "x = 1", 9, None),
    ]
    m = manifest(spark.createDataFrame(rows, MEMBERS)).orderBy("position").collect()
    assert [r.source_folder for r in m] == ["p", "root", "q", "q", "q"] and [r.variant for r in m] == ["NT", "FT", None, None, None]
    assert [r.player_count for r in m] == [3, 2, None, None, None] and m[1].betting_structure == "fixed_limit"
    assert [(r.hand_count_estimate, r.hand_count_exact) for r in m] == [(1, True), (5, False), (None, False), (None, None), (1, True)]
    assert [r.parse_error for r in m] == [None, None, "no_phhs_section_in_header", "empty_member", "variant_not_found_in_header"]
    assert m[0].compression_ratio == 2.5


def test_append_goes_on(spark, tmp_path):
    where, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    schema = "k string, v int"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(where)
        append_new(spark.readStream.schema(schema).json(where), out, ["k"], ["v"], log).awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.parquet(out).collect())

    assert feed([("a", 2), ("a", 1), ("b", 3), (None, 4)]) == [("a", 1), ("b", 3)]
    assert feed([("a", 0), ("c", 5)]) == [("a", 1), ("b", 3), ("c", 5)]
