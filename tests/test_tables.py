"""Whole-table replacement under readers, crashes and rivals; hashes of files of any size."""

import hashlib
import os

import pytest
from pyspark.sql import types as T

from daybook.sources import readers as S
from daybook.sources import tables as B


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_reader_sees_one_whole_version(spark, tmp_path):
    table = B.VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(5))
    begun = table.read()
    # files of a load that is under way are there, its record is not
    spark.range(100, 103).write.parquet(f"{tmp_path}/t/data/000002-under-way")
    assert ids(table.read()) == [0, 1, 2, 3, 4]
    table.replace(spark.range(7, 9))
    assert ids(table.read()) == [7, 8] and ids(begun) == [0, 1, 2, 3, 4]
    assert table.vacuum(keep=1) == ["000002-under-way"] and ids(begun) == [0, 1, 2, 3, 4]
    assert len(table.vacuum(keep=0)) == 1 and ids(table.read()) == [7, 8] and len(table.commits()) == 1


def test_a_load_that_dies_leaves_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    table = B.VersionedTable(spark, f"{tmp_path}/t")
    table.replace(spark.range(3))
    bad = spark.range(10, 5000, numPartitions=4).withColumn("id", F.when(F.col("id") == 4000, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert ids(table.read()) == [0, 1, 2]
    table.replace(spark.range(1))
    assert ids(B.VersionedTable(spark, f"{tmp_path}/t").read()) == [0] and len(table.vacuum()) == 1


def test_of_two_loads_that_overlap_one_wins(spark, tmp_path):
    a, b = B.VersionedTable(spark, f"{tmp_path}/t"), B.VersionedTable(spark, f"{tmp_path}/t")
    a.replace(spark.range(1))
    spark.range(2).write.parquet(f"{tmp_path}/t/data/000002-mine")
    b.replace(spark.range(3))
    with pytest.raises(RuntimeError, match="meanwhile"):
        a._commit(2, "000002-mine")
    assert ids(a.read()) == [0, 1, 2]


def test_loads_of_several_sources_and_of_frames_in_memory(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("tag", T.StringType())])
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    first = S.load_table(spark, {"a": df, "b": df, "none": df.limit(0)}, schema, f"{tmp_path}/t")
    assert sorted(map(tuple, first.collect())) == [("a", 2), ("b", 2), ("none", 0)]
    spec = S.SourceSpec("mem", "memory", renames={"X": "x"}, constants={"tag": "k"}, expected=("x", "tag"))
    assert [tuple(r) for r in S.load_inline(spark, df.toPandas().rename(columns={"x": "X"}), spec, schema, f"{tmp_path}/t").collect()] == [("mem", 2)]
    assert sorted(map(tuple, B.VersionedTable(spark, f"{tmp_path}/t").read().select("x", "tag", "source_name").collect())) == [(1, "k", "mem"), (2, "k", "mem")]
    with pytest.raises(ValueError, match="missing"):
        S.load_inline(spark, df.toPandas(), S.SourceSpec("mem", "memory", expected=("z",)), schema, f"{tmp_path}/t")
    assert B.VersionedTable(spark, f"{tmp_path}/t").read().count() == 2


def tree(data, block, fan):
    level = [hashlib.sha256(data[i : i + block]).digest() for i in range(0, max(1, len(data)), block)]
    while len(level) > 1:
        level = [x[0] if len(x) == 1 else hashlib.sha256(b"".join(x)).digest() for x in (level[i : i + fan] for i in range(0, len(level), fan))]
    return level[0].hex()


def test_hashes_of_blocks_make_a_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FAN_OUT", 3)
    sizes = {"empty": 0, "one": 7, "edge": 8, "two": 9, "many": 8 * 29 + 1}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(os.urandom(n))
    counts = spark.createDataFrame([("all", 4)], "source_name string, loaded_rows long")
    files = spark.createDataFrame([(f"file:{tmp_path}/{n}", s) for n, s in sizes.items()], "path string, length long")
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in B.file_hashes(files, block=8).collect()}
    assert got == {n: tree((tmp_path / n).read_bytes(), 8, 3) for n in sizes}
    assert got["one"] == hashlib.sha256((tmp_path / "one").read_bytes()).hexdigest()
    m = B.source_manifest(spark, {"all": str(tmp_path), "other": f"{tmp_path}/one"}, counts, "r", block=8).collect()
    assert {r["source_name"]: (r["files"], r["bytes"], r["loaded_rows"]) for r in m} == {"all": (4, sum(sizes.values()), 4), "other": (1, 7, None)}
    assert next(r for r in m if r["source_name"] == "all")["sha256"] == hashlib.sha256("".join(sorted(v for n, v in got.items() if n != "empty")).encode()).hexdigest()


def test_a_file_larger_than_any_row(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(b"end")
    r = B.source_manifest(spark, {"large": f"{tmp_path}/large"}, spark.createDataFrame([], "source_name string, loaded_rows long"), "r", block=64 << 20).first()
    zero, last = hashlib.sha256(bytes(64 << 20)).digest(), hashlib.sha256(b"end").digest()
    root = hashlib.sha256(zero * 48 + last).hexdigest()
    assert r["bytes"] == (3 << 30) + 3 and r["sha256"] == hashlib.sha256(root.encode()).hexdigest()
    os.remove(tmp_path / "large")
