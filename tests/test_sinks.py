"""One file written by many tasks: order, formats, workbooks as zip readers see them, and what is left behind."""

import csv
import io
import json
import random
import zipfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.sinks import files as sinks
from lectern.sinks.single import Piece, PiecesWriter, joined_crc, to_file
from lectern.sources import workbook
from lectern.sources.files import csv_records, in_file_order, json_records

ODD = ['a "quoted", text', "two\nlines", "<tag> & é 日本", "", None, " space ", "x" * 5000]


@pytest.fixture
def rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("key"), F.element_at(F.array(*map(F.lit, ODD)), (F.col("id") % len(ODD) + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("part"))
    return df.repartition(9, "text", "key").orderBy(F.desc("key"))


def expected():
    return [(i, ODD[i % len(ODD)], i / 4 if i % 3 else None) for i in reversed(range(20_000))]


def test_joined_crcs():
    r = random.Random(1)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (1000, 123_457), (7, 1 << 20)):
        a, b = r.randbytes(n), r.randbytes(m)
        assert joined_crc(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_csv_of_many_tasks(spark, rows, tmp_path):
    path = sinks.to_csv(rows, tmp_path / "deep" / "out.txt")
    assert path.endswith("deep/out.csv") and [p.name for p in (tmp_path / "deep").iterdir()] == ["out.csv"]
    with open(path, newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got[0] == ["key", "text", "part"]
    assert got[1:] == [["" if x is None else str(x) for x in r] for r in expected()]


def test_json_of_many_tasks(rows, tmp_path):
    got = json.loads(Path(sinks.to_json(rows, tmp_path / "out")).read_text(encoding="utf-8"))
    assert [tuple(r.values()) for r in got] == expected() and list(got[0]) == ["key", "text", "part"]


def test_workbook_of_many_tasks(spark, rows, tmp_path):
    path = sinks.to_excel(rows, f"file://{tmp_path}/out.csv")
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]
    with zipfile.ZipFile(tmp_path / "out.xlsx") as z:
        assert z.testzip() is None
        assert z.read(workbook.SHEET).endswith(workbook.SHEET_END.encode())
    got = list(workbook.read_workbook(str(tmp_path / "out.xlsx")))[1:]
    assert [tuple(r) for r in got] == [(a, b, c) for a, b, c in expected()]
    spark.dataSource.register(workbook.WorkbookSource)
    assert spark.read.format("workbook").schema("key long, text string, part double").load(path).agg(F.sum("key"), F.sum("part")).first() == rows.agg(F.sum("key"), F.sum("part")).first()


def test_empty_tables_write_no_file(rows, tmp_path):
    for sink in (sinks.to_csv, sinks.to_json, sinks.to_excel):
        assert sink(rows.where("key < 0"), tmp_path / "out") == ""
    assert list(tmp_path.iterdir()) == []


def test_failed_tasks_leave_nothing(spark, tmp_path):
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("x"))
    (tmp_path / "out.csv").write_text("the file before")
    with pytest.raises(Exception, match="broken row"):
        sinks.to_csv(bad, tmp_path / "out")
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"] and (tmp_path / "out.csv").read_text() == "the file before"


def test_sheets_have_a_limit(spark, tmp_path):
    writer = PiecesWriter(spark.range(1).schema, {"path": str(tmp_path / "x.xlsx"), "kind": "excel", "job": "j"})
    with pytest.raises(ValueError):
        writer.commit([Piece(0, "p", workbook.MOST_ROWS, 0, 0, 0)])
    assert list(tmp_path.iterdir()) == []


def test_buffers_hold_the_same(rows, tmp_path):
    some = rows.limit(50).coalesce(1)
    assert sinks.to_bytes(some, "json") == Path(sinks.to_json(some, tmp_path / "x")).read_bytes()
    assert list(workbook.read_workbook(io.BytesIO(sinks.to_bytes(some)))) == list(workbook.read_workbook(sinks.to_excel(some, tmp_path / "x")))


def test_full_sheets_go_on_in_the_next(spark, rows, tmp_path):
    path = str(tmp_path / "x.xlsx")
    assert to_file(rows, path, "excel", sheet_rows=3000)
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if "worksheets/" in n]
        assert z.testzip() is None and len(names) > 6 and z.read("xl/workbook.xml").count(b"<sheet ") == len(names)
    spark.dataSource.register(workbook.WorkbookSource)
    got = in_file_order(spark.read.format("workbook").schema("key long, text string, part double").load(path))
    assert [tuple(r)[:3] for r in got.orderBy("place").collect()] == expected()


@pytest.mark.parametrize("stretch", [7, 1 << 14])
def test_one_text_file_is_read_by_many_tasks(spark, rows, tmp_path, monkeypatch, stretch):
    from lectern.sources import files

    monkeypatch.setattr(files, "STRETCH", stretch)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        for more in (F.lit(""), F.lit(' "\r\n,\r"')):
            own = rows.withColumn("text", F.concat("text", more))
            want = [(i, *r) for i, r in enumerate(map(tuple, own.collect()))]
            schema = "key long, text string, part double"
            got = json_records(spark, sinks.to_json(own, tmp_path / "x"), schema)
            assert got.rdd.getNumPartitions() > 4 and list(map(tuple, got.orderBy("place").collect())) == want
            got = csv_records(spark, sinks.to_csv(own, tmp_path / "x"), schema)
            assert list(map(tuple, got.orderBy("place").collect())) == [(*r[:2], r[2] or None, r[3]) for r in want]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
