"""Sources, sinks, plans, streams, and all queries against their SQL."""

import io
import json
import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.config import Config
from lectern.plans import cli
from lectern.plans.extract import batch, extract, method_used
from lectern.sinks import files as sinks
from lectern.sources import decode, fetch, files, workbook
from lectern.sources.lines import cells_from_lines, lines_from_path, lines_from_results, lines_from_text, reading_order
from lectern.streaming.inbox import counts_by_window, parse_inbox

SF = "/root/testdata/sf0.001"
PAGE = "LOWER DIR DISTRICT\nALL SEXES 1 2 3 4 5 6 7\n"


def test_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\r\nb\fc\n"), (2, None)], "k int, text string")
    assert sorted(map(tuple, lines_from_text(df, "k").collect())) == [("1", 1, 0, "a"), ("1", 1, 1, "b"), ("1", 2, 0, "c"), ("1", 2, 1, "")]
    (tmp_path / "x.txt").write_text("one\ntwo")
    assert [r["line"] for r in lines_from_path(spark, str(tmp_path)).orderBy("line_no").collect()] == ["one", "two"]
    results = spark.createDataFrame([("i", ["a", " "], None), ("j", ["b"], "failed")], "image_path string, lines array<string>, error string")
    assert [r["line"] for r in lines_from_results(results).collect()] == ["a"]
    items = spark.createDataFrame([("s", 1, "low", [[0.0, 9.0]]), ("s", 1, "high", [[5.0, 1.0]]), ("s", 1, None, [[0.0, 0.0]])], "source string, page int, text string, bbox array<array<double>>")
    assert [r["line"] for r in reading_order(items).orderBy("line_no").collect()] == ["high", "low"]
    assert cells_from_lines(reading_order(items)).first()["cells"] == ["high"]


def test_listing(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", "d.jpg", "e.JPEG"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda **k: [os.path.basename(r["path"]) for r in files.listed(spark, str(tmp_path), **k).collect()]
    assert names() == ["a.pdf", "b.PDF"] and names(suffixes=files.IMAGES) == ["d.jpg", "e.JPEG"]
    assert files.listed(spark, str(tmp_path), content=True).first()["content"] == b"x"
    urls = files.url_table(spark, "http://x/", "{district_code}{data_type}.pdf", 9, 10, "09").orderBy("id").collect()
    assert [r["url"] for r in urls] == ["http://x/00909.pdf", "http://x/01009.pdf"]


def test_fetch():
    def server(*answers):
        left = list(answers)

        def get(url, timeout):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return get

    slept = []
    run = lambda *a: fetch.fetch_one("u", fetch=server(*a), sleep=slept.append)
    assert run((200, b"ok"))["content"] == b"ok"
    assert run((404, b""))["attempts"] == 1
    assert run((500, b""), (200, b"x"))["attempts"] == 2 and slept == []
    failed = run(OSError("a"), OSError("b"), OSError("c"))
    assert failed["attempts"] == 3 and "c" in failed["error"] and slept == [1, 2]
    assert run((500, b""), (500, b""), (500, b""))["error"] == "status 500"


def test_fetched_rows(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"body")
    df = spark.createDataFrame([(f"file://{tmp_path}/f",), (f"file://{tmp_path}/none",)], "url string")
    rows = {r["url"][-1]: r for r in fetch.fetched(df, retries=1, delay=0, fetch=lambda url, t: (200, open(url[7:], "rb").read())).collect()}
    assert rows["f"]["content"] == b"body" and rows["e"]["error"].startswith("FileNotFoundError")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    rows = [(1, "x & <y>", 2.5, None, True), (2, None, 1e20, "\x01z ", False), (3, "", float("nan"), None, None)]
    assert workbook.write_workbook(path, ["a", "b", "a", "d", "e"], rows) == 3
    got = list(workbook.read_workbook(path))
    assert got[0] == ["a", "b", "a", "d", "e"] and got[1] == [1, "x & <y>", 2.5, None, True] and got[2] == [2, None, "1e+20", "z ", False]
    assert workbook.letters(0) == "A" and workbook.letters(26) == "AA" and workbook.letters(701) == "ZZ"
    spark.dataSource.register(workbook.WorkbookSource)
    df = spark.read.format("workbook").load(path)
    assert df.columns == ["a", "b", "a_2", "d", "e"] and df.count() == 3 and df.schema["a"].dataType.typeName() == "long"
    with pytest.raises(ValueError):
        workbook.write_workbook(io.BytesIO(), ["a"], ((i,) for i in range(workbook.MOST_ROWS)))


def test_decoding(spark, tmp_path):
    (tmp_path / "a.txt").write_text(PAGE + "\fnext page")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    rows = decode.decoded(files.listed(spark, str(tmp_path), ("txt",), content=True), ("text", "plain"))
    good, bad = rows.where("error is null"), rows.where("error is not null").collect()
    assert {r["method"] for r in good.collect()} == {"plain"} and len(bad) == 1 and "UnicodeDecodeError" in bad[0]["error"]
    assert [(r["page"], r["line"]) for r in decode.lines_of(rows).orderBy("page", "line_no").collect()][-1] == (2, "next page")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é, \"q\""), (2, None)], "a int, `b/c` string").orderBy("a")
    c = Config(values={"export": {"output_dir": str(tmp_path / "out"), "output_filename": "t"}})
    done = sinks.export_all(df, c)
    assert {k: os.path.basename(v) for k, v in done.items()} == {"excel": "t.xlsx", "csv": "t.csv", "json": "t.json"}
    assert json.loads(open(done["json"]).read()) == [{"a": 1, "b/c": "é, \"q\""}, {"a": 2, "b/c": None}]
    assert open(done["csv"], newline="").read().split("\r\n")[1] == '1,"é, ""q"""'
    assert sinks.export(df.where("false"), c) == "" and sinks.export(df, c, tmp_path / "r.csv").endswith("r.xlsx")
    with pytest.raises(ValueError):
        sinks.export(df, c, kind="parquet")
    sinks.write_parts(df, str(tmp_path / "parts"), "json")
    assert spark.read.json(str(tmp_path / "parts")).count() == 2
    assert str(sinks.output_path(c, "other")).endswith("t.txt")


def test_cascade(spark):
    texts = [("h", "A DISTRICT\nMALE 1 2 3 4 5 6 7"), ("u", "word 12 34"), ("t", "only words"), ("n", " \n")]
    lines = lines_from_text(spark.createDataFrame(texts, "k string, text string"), "k")
    assert sorted(map(tuple, method_used(lines).collect())) == [("h", "hierarchical", 1), ("n", None, 0), ("t", "text", 1), ("u", "universal", 1)]
    table = extract(lines_from_text(spark.createDataFrame([("s", PAGE)], "k string, text string"), "k"))
    assert table.first()["OTHERS"] == "7" and table.first()["REGION"] == "LOWER DIR DISTRICT"


def test_batch_and_command_line(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(PAGE)
    (tmp_path / "a.txt").write_text(PAGE)
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    rows = batch(spark, [str(tmp_path / "a.pdf"), str(tmp_path / "b.pdf"), str(tmp_path / "none.pdf")], str(tmp_path / "out"), methods=("plain",)).collect()
    assert [r["status"].split(":")[0] for r in rows] == ["SUCCESS", "FAILED", "FAILED"] and os.path.exists(rows[0]["output"])
    assert cli.main(["-i", str(tmp_path / "a.txt"), "-o", str(tmp_path / "cli"), "-f", "json", "-q"]) == 0
    assert json.loads((tmp_path / "cli.json").read_text())[0]["SEX"] == "ALL"
    assert cli.main(["-q"]) == 1
    assert cli.main(["--init-config", str(tmp_path / "c.yaml")]) == 0 and Config(tmp_path / "c.yaml").values == Config().values
    with pytest.raises(SystemExit):
        cli.main(["--download", "-i", "x"])


def test_parts(spark, tmp_path, capsys):
    from lectern import api
    from lectern.plans.extract import extract_census

    c = Config(values={"export": {"format": "csv", "output_dir": str(tmp_path)}, "conversion": {"output_dir": str(tmp_path)}, "download": {"district_range": [1, 2]}})
    assert api.Downloader(spark, c).urls().count() == 2
    (tmp_path / "a.pdf").write_text(PAGE)
    (tmp_path / "i.png").write_bytes(b"x")
    local = api.Downloader(spark, c).local(str(tmp_path))
    assert api.Converter(spark, c).images().count() == 1 and "Error" in api.Converter(spark, c).convert(local).first()["error"]
    assert [(r["page"], r["image"]) for r in decode.pages_of(local, lambda x: [b"p", x[:1]]).orderBy("page").collect()] == [(0, b"p"), (1, b"L")]
    assert api.Recogniser(spark, c).read(api.Converter(spark, c).images()).first()["error"] and api.Recogniser(spark, c).confidence(local).count() == 0
    assert sorted(r["conf"] for r in decode.confidences(local, lambda x: [90, -1]).collect()) == [-1.0, 90.0]
    with pytest.raises(ValueError):
        api.Recogniser(spark, Config(values={"ocr": {"engine": "other"}}))
    lines = lines_from_text(spark.createDataFrame([("s", PAGE)], "k string, text string"), "k")
    table = api.Parser(spark, c).parse(lines)
    assert api.Exporter(spark, c).export(table).endswith("extracted_data.csv") and len(api.Exporter(spark, c).export_all(table)) == 3
    api.Exporter(spark, c).print_summary(table)
    assert "rows: 1" in capsys.readouterr().out
    census = extract_census(lines.unionByName(lines))
    assert [(r["SEX"], r["TOTAL"], r["OTHERS"]) for r in census.collect()] == [("ALL", 1.0, 7.0)]


def counting(tmp_path):
    """A decoder that leaves a mark for each call, and how many there are for each content."""
    marks = tmp_path / "marks"
    marks.mkdir()

    def decode_(content, where=str(marks)):
        import uuid

        with open(f"{where}/{uuid.uuid4().hex}", "wb") as f:
            f.write(content)
        if content.startswith(b"bad"):
            raise ValueError("unreadable")
        return decode.plain_text(content)

    return decode_, lambda: Counter(p.read_bytes() for p in marks.iterdir())


def test_each_file_is_decoded_once(spark, tmp_path):
    from lectern.plans.extract import extract_files

    decode_, calls = counting(tmp_path)
    for name, text in (("a", PAGE), ("b", PAGE + "x"), ("c", "bad"), ("e", "")):
        (tmp_path / f"{name}.pdf").write_text(text)
    c = Config(values={"export": {"format": "csv", "output_dir": str(tmp_path)}})
    table, failed = extract_files(spark, str(tmp_path), c, ("t",), {"t": decode_})
    assert table.count() == 2 and len(table.collect()) == 2 and len(failed.collect()) == 2
    assert set(calls().values()) == {1} and len(calls()) == 4
    paths = [str(tmp_path / f"{x}.pdf") for x in "abce"] + [str(tmp_path / "none.pdf")]
    out = {Path(r["input"]).stem: r["status"] for r in batch(spark, paths, str(tmp_path / "out"), c, ("t",), {"t": decode_}).collect()}
    assert out["a"] == out["b"] == "SUCCESS" and "unreadable" in out["c"] and out["e"] == "FAILED: no text" and out["none"] == "FAILED: no such file"
    assert set(calls().values()) == {2} and (tmp_path / "out" / "a.csv").exists()


def test_empty_files_are_listed(spark, tmp_path):
    from lectern.sources.files import listed, named_files

    (tmp_path / "a.pdf").write_text("x")
    (tmp_path / "b.PDF").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = listed(spark, str(tmp_path), content=True).collect()
    assert [(r["path"][-5:], r["length"], bytes(r["content"])) for r in rows] == [("a.pdf", 1, b"x"), ("b.PDF", 0, b"")]
    assert [r["path"] for r in rows] == named_files(spark, str(tmp_path / "*.[pP]*"))
    assert listed(spark, str(tmp_path)).count() == 2


def test_cascade_with_ocr(spark, tmp_path):
    from lectern.plans.extract import cascade

    files = spark.createDataFrame([("report", b"r"), ("scan", b"s"), ("blank", b"b"), ("broken", b"x")], "path string, content binary")

    def text(content):
        if content == b"x":
            raise ValueError("broken")
        return decode.plain_text(PAGE.encode()) if content == b"r" else [[]]

    def ocr(content):
        if content == b"x":
            raise ValueError("broken too")
        return [[["read by eye"]]] if content == b"s" else [[]]

    rows = cascade(files, decoders={"text": text, "ocr": ocr}).collect()
    by = {r["source"]: (r["method"], r["error"]) for r in rows}
    assert by["scan"] == ("ocr", None) and by["blank"] == (None, "no text") and "broken too" in by["broken"][1] and by["report"][0] in ("hierarchical", "universal", "text")
    assert [r["cells"] for r in rows if r["source"] == "scan"] == [["read by eye"]]


def test_layout_items(spark):
    def model(content):
        return [[{"text": "low", "bbox": [[0, 90], [9, 90]], "confidence": 0.9}, {"text": "top", "bbox": [[5, 10], [9, 10]], "confidence": 0.8}, {"text": "dust", "bbox": [[5, 20]], "confidence": 0.1}]]

    assert decode.by_layout(model, 0.5)(b"") == [[["top"], ["low"]]]
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    items = decode.layout_items(files, model).where("confidence > 0.5")
    assert [(r["source"], r["line_no"], r["line"]) for r in reading_order(items).orderBy("source", "line_no").collect()] == [("a", 0, "top"), ("a", 1, "low"), ("b", 0, "top"), ("b", 1, "low")]
    rows = decode.decoded(files, ("layout",), {"layout": decode.by_layout(model, 0.5)}).orderBy("source", "row_no").collect()
    assert [r["cells"] for r in rows] == [["top"], ["low"]] * 2
    assert {"tables_first", "ocr_first_page", "ocr_lines"} <= set(decode.DECODERS) and decode.is_scanned.__doc__


def test_buffers_and_log_file(spark, tmp_path, monkeypatch):
    from lectern.sinks.files import to_bytes, to_csv, to_excel

    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string").coalesce(1)
    assert to_bytes(df, "csv") == Path(to_csv(df, tmp_path / "x")).read_bytes()
    assert json.loads(to_bytes(df, "json")) == [{"a": 1, "b": "é"}, {"a": 2, "b": None}]
    assert list(workbook.read_workbook(io.BytesIO(to_bytes(df)))) == list(workbook.read_workbook(to_excel(df, tmp_path / "y")))
    monkeypatch.chdir(tmp_path)
    (tmp_path / "p.txt").write_text(PAGE)
    assert cli.main(["-i", str(tmp_path / "p.txt"), "-o", str(tmp_path / "out.csv"), "-f", "csv", "--clean"]) == 0
    assert "out.csv" in (tmp_path / "lectern.log").read_text() and (tmp_path / "out.csv").exists()


def test_inbox(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text(PAGE)
    run = lambda: parse_inbox(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.groupBy("source").agg(F.count("*").alias("n")), once=True).awaitTermination()
    run()
    (inbox / "b.txt").write_text(PAGE + "x")
    run()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 3]
    events = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("s").alias("source"))
    assert counts_by_window(events).isStreaming


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES) <= set(__spark_entry__.queries())
