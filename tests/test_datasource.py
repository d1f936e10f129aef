import datetime as dt
from decimal import Decimal

import pytest
import stratablock as sb
from pyspark.sql import functions as F
from stratablock.sources.fields import Field
from stratablock.streaming import write_stream


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("n") / "numbers")
    sb.write(spark.range(150_000).select("id", F.concat(F.lit("v"), "id").alias("s"), (F.col("id") / 2).alias("x")).coalesce(1), path)
    return path


def test_partitions_follow_blocks(spark, numbers):
    df = sb.scan(spark, numbers)
    assert df.rdd.getNumPartitions() == 3 and sb.num_records(numbers) == df.count() == 150_000
    assert sb.scan(spark, numbers, blocks_per_partition=2).rdd.getNumPartitions() == 2


def test_partitions_of_large_tables_hold_several_blocks(monkeypatch):
    from stratablock.sources import datasource
    from stratablock.sources.files import FileInfo

    def planned(blocks, **options):
        info = FileInfo("f", (Field("id", "Int32"),), blocks * 65_536 - 7, True, 600, tuple(range(600, 600 + blocks)), True)
        monkeypatch.setattr(datasource, "load_infos", lambda path: [info])
        pieces = [p.piece for p in datasource.RowBlockReader(None, {"path": "f", **options}).partitions()]
        assert sum(p.take for p in pieces) == info.records and [p.at for p in pieces] == sorted(p.at for p in pieces)
        return len(pieces)

    assert [planned(n) for n in (1, 300, 511, 512, 5000)] == [1, 300, 511, 256, 264]
    assert planned(5000, blocksPerPartition="1") == 5000


def test_options_equal_operators(spark, numbers):
    whole = sb.scan(spark, numbers)
    assert sb.scan(spark, numbers, ["x", "id"]).columns == ["x", "id"]
    for offset, limit in ((0, 5), (65_530, 12), (149_998, 10), (150_000, 1), (10, 0), (131_071, 2)):
        got = [r.id for r in sb.scan(spark, numbers, ["id"], offset, limit).collect()]
        assert got == list(range(min(offset, 150_000), min(offset + limit, 150_000)))
    assert sb.scan(spark, numbers, limit=-1).count() == 150_000
    assert sb.scan(spark, numbers, ["id"]).filter("id % 7 = 0").agg(F.sum("id")).first() == whole.filter("id % 7 = 0").agg(F.sum("id")).first()
    assert sb.scan(spark, numbers, offset=65_530, limit=2, row_index="k").select("k").collect() == [(65_530,), (65_531,)]


def test_limit_reads_few_blocks(spark, numbers):
    assert sb.scan(spark, numbers, limit=1000).rdd.getNumPartitions() == 1


def test_sorted_rows_in_many_files(spark, tmp_path):
    """Offsets, limits and numbers of the table go over all files in a row, in the order of the partitions."""
    path = str(tmp_path / "many")
    sb.write(spark.range(0, 1000, 1, 12).repartitionByRange(12, F.desc("id")).sortWithinPartitions(F.desc("id")), path)
    assert len(list((tmp_path / "many").glob("*.rb"))) == 12
    assert [r.id for r in sb.scan(spark, path, offset=10, limit=900).collect()] == list(range(989, 89, -1))
    assert [tuple(r) for r in sb.scan(spark, path, row_index="k", row_index_of="table").collect()] == [(999 - k, k) for k in range(1000)]
    assert [r.k for r in sb.scan(spark, path, offset=500, limit=3, row_index="k", row_index_of="table").collect()] == [500, 501, 502]
    assert sb.scan(spark, path, row_index="k").filter("k = 0").count() == 12
    with pytest.raises(ValueError, match="row_index_of"):
        sb.scan(spark, path, row_index="k", row_index_of="folder")


def test_unknown_column(spark, numbers):
    with pytest.raises(Exception, match="Unknown column in projection: nope"):
        sb.scan(spark, numbers, ["nope"]).count()


def test_all_types(spark, tmp_path):
    fields = [Field("b", "Bool"), Field("y", "Byte"), Field("i", "Int16"), Field("j", "Int32"), Field("k", "Int64"), Field("f", "Float"), Field("d", "Double"), Field("m", "FixedDecimal", 10, 2), Field("s", "String", 5), Field("w", "WString", 5), Field("v", "V_String", 99), Field("u", "V_WString", 99), Field("a", "Date"), Field("t", "Time"), Field("z", "DateTime"), Field("o", "Blob"), Field("g", "SpatialObj")]
    row = dict(b=True, y=255, i=-5, j=7, k=2**40, f=1.5, d=2.5, m=Decimal("123.45"), s="abc", w="é", v="x" * 90, u="日😀", a=dt.date(2024, 1, 15), t="13:45:30", z=dt.datetime(2024, 1, 15, 13, 45, 30), o=b"\0\1", g=b"shp")
    path = str(tmp_path / "all.rb")
    sb.write_columns(spark, {n: [x, None] for n, x in row.items()}, path, fields)
    assert sb.file_schema(path) == fields
    got = sb.scan(spark, path, exact_decimals=True)
    first, second = got.collect()
    assert first.asDict() == row and not any(v is not None for v in second)
    assert sb.read(spark, path).select("m").first() == (123.45,)
    sb.write(sb.scan(spark, path, exact_decimals=True), str(tmp_path / "again"), single_file=True)
    assert [(f.name, f.type) for f in sb.file_schema(str(tmp_path / "again"))] == [(f.name, f.type) for f in fields]


def test_columns_without_schema(spark, tmp_path):
    path = str(tmp_path / "c.rb")
    sb.write_columns(spark, {"id": [1, 2, 3], "name": ["a", None, "c"], "score": [1.5, None, 3.0], "none": [None] * 3}, path)
    assert [f.type for f in sb.file_schema(path)] == ["Int64", "V_WString", "Double", "V_WString"]
    assert sb.read_arrow(spark, path).to_pydict()["name"] == ["a", None, "c"]
    assert sum(b.num_rows for b in sb.read_batches(spark, path, 2)) == 3
    fields = [Field("a", "Int32"), Field("b", "Double")]
    sb.write_columns(spark, {"a": [1, 2], "zzz": [3]}, path, fields)
    assert sb.read_arrow(spark, path).to_pydict() == {"a": [1, 2], "b": [None, None]}
    sb.write_columns(spark, {"b": [1.0]}, path, fields)
    assert sb.num_records(path) == 0


def test_modes_names_and_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2)], "a int, `A` int") if False else spark.createDataFrame([(1, 2)], ["a", "b"]).toDF("a", "A")
    sb.write(df, path)
    assert sb.read(spark, path).columns == ["a", "A2"]
    sb.write(spark.range(5).filter("id > 9"), path)
    assert sb.read(spark, path).columns == ["id"] and sb.num_records(path) == 0
    with pytest.raises(Exception, match="no field type"):
        sb.write(spark.createDataFrame([([1],)], "x array<int>"), str(tmp_path / "x"))
    import os

    assert sorted(f for f in os.listdir(path) if not f.startswith("part-")) == ["_SUCCESS"]


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    sb.write(spark.range(3), path, mode="append")
    sb.write(spark.range(3, 5), path, mode="append")
    sb.write(spark.range(5, 6), path, mode="append", compression="none")
    assert sorted(r.id for r in sb.scan(spark, path).collect()) == list(range(6))
    with pytest.raises(Exception, match="differ"):
        sb.write(spark.range(1).selectExpr("cast(id AS int) AS id"), path, mode="append")
    sb.write(spark.range(2), str(tmp_path / "one"), single_file=True)
    for single in (True, False):
        with pytest.raises(Exception, match="is there already"):
            sb.write(spark.range(2), str(tmp_path / "one"), mode="append", single_file=single)
    assert sb.num_records(path) == 6 and sb.num_records(str(tmp_path / "one")) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "t"]


def test_commit_never_has_neither(spark, tmp_path, monkeypatch):
    """If the new folder can't be moved, the old one is put back; it is never deleted before."""
    from pyarrow.fs import LocalFileSystem
    from stratablock.sources import datasource as D

    path = str(tmp_path / "t")
    sb.write(spark.range(3), path)

    class Broken(LocalFileSystem):
        def move(self, a, b):
            if "_staging" in a:
                raise OSError("lost")
            super().move(a, b)

    writer = D.RowBlockWriter(spark.range(1).schema, True, {"path": path})
    name = f"{writer._staging()}/part-0.rb"
    D.write_file(name, writer.fields, [])
    with monkeypatch.context() as m:
        m.setattr(D, "file_system", lambda p: (Broken(), p))
        with pytest.raises(OSError):
            writer.commit([D.Written(name, 0)])
        writer.abort([])
    assert sb.num_records(path) == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert sorted(r.id for r in sb.scan(spark, path).collect()) == [0, 1, 2]


def test_batches(spark, numbers):
    sizes = [b.num_rows for b in sb.read_batches(spark, numbers, 40_000, ["id"])]
    assert sizes == [40_000, 40_000, 40_000, 30_000]
    assert [x for b in sb.read_batches(spark, numbers, 7_777, ["id"]) for x in b.column(0).to_pylist()] == list(range(150_000))
    with pytest.raises(ValueError, match="Unknown column"):
        next(sb.read_batches(spark, numbers, 10, ["nope"]))


def test_failed_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "t")
    sb.write(spark.range(3), path)
    broken = spark.range(4).select(F.when(F.col("id") > 2, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception):
        sb.write(broken, path)
    assert sb.num_records(path) == 3


def test_view_and_sql(spark, numbers, tmp_path):
    sb.register_view(spark, "numbers_view", numbers)
    assert spark.sql("SELECT count(*) AS n FROM numbers_view WHERE x > 74999").first().n == 1
    sb.write_sql(spark, "SELECT `id` AS k FROM numbers_view WHERE id < 3", str(tmp_path / "out"))
    assert sorted(r.k for r in sb.read(spark, str(tmp_path / "out")).collect()) == [0, 1, 2]
    snap = sb.register_view(spark, "snap", str(tmp_path / "out"), snapshot=True)
    assert snap.count() == 3
    sb.write(spark.range(1).withColumnRenamed("id", "k"), str(tmp_path / "out"))
    assert spark.table("snap").count() == 3
    snap.unpersist()


def test_folder_glob_and_other_names(spark, tmp_path):
    folder = tmp_path / "größe 日"
    for k in range(3):
        sb.write(spark.range(k * 10, k * 10 + 10), str(folder / f"p{k}.rb"), single_file=True)
    assert sb.num_records(str(folder)) == 30
    assert sorted(r.id for r in sb.scan(spark, str(folder), offset=5, limit=10).collect()) == list(range(5, 15))
    assert sb.num_records(str(folder / "p[01]*.rb")) == 20
    sb.write(spark.range(3).selectExpr("cast(id as int) id"), str(folder / "q.rb"), single_file=True)
    with pytest.raises(ValueError, match="differs"):
        sb.num_records(str(folder))
    with pytest.raises(FileNotFoundError):
        sb.num_records(str(tmp_path / "missing"))


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True)
    assert q.awaitTermination(60)
    assert sorted(r.id for r in sb.scan(spark, str(tmp_path / "out")).collect()) == list(range(10))


def test_records_and_frames(spark, numbers, tmp_path, capsys):
    import pandas as pd

    assert sb.record(numbers, 65_536) == {"id": 65_536, "s": "v65536", "x": 32_768.0}
    with pytest.raises(IndexError):
        sb.record(numbers, 150_000)
    assert sb.read_records(spark, numbers, ["id"], 7, 2) == [{"id": 7}, {"id": 8}]
    path = str(tmp_path / "r.rb")
    sb.write_records(spark, [{"a": 1, "zzz": 5}, {"b": "x"}], path, [Field("a", "Int16"), Field("b", "V_String", 9)])
    assert sb.read_records(spark, path) == [{"a": 1, "b": None}, {"a": None, "b": "x"}]
    sb.write_pandas(spark, pd.DataFrame({"v": [1.5, 2.5]}, index=pd.Index([7, 8], name="k")), str(tmp_path / "p"))
    assert sb.read_pandas(spark, str(tmp_path / "p")).to_dict("list") == {"k": [7, 8], "v": [1.5, 2.5]}
    from stratablock.__main__ import main

    assert main([path]) == 0 and capsys.readouterr().out == "2 records\na\tInt16\nb\tV_String(9)\n"
    assert main(["--version"]) == 0 and main(["--nope"]) == 2
