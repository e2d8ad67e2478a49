"""Parsers on literal pages."""

import pytest
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators import lines as L
from lectern.operators.census import PRESETS, parse_census
from lectern.operators.package import parse_census_pairs, parse_election, parse_generic, parse_lines, parse_next_lines, record_names
from lectern.operators.schema import evened, looked_up, mapping_table, named, names_for, unique_names, widest
from lectern.operators.universal import chosen_headers, classified, generic_rows, generic_table, header_names, universal_rows, universal_table, with_style

CENSUS = """TABLE 9 - POPULATION BY SEX AND RELIGION
AREA/SEX TOTAL MUSLIM CHRISTIAN HINDU AHMADI CASTES OTHERS
1 2 3 4 5 6 7 8
LOWER DIR DISTRICT
OVERALL
ALL SEXES 1,436,082 1,435,332 385 29 38 - 298
MALE 709,829 709,408 213 19 20 - 169
RURAL
TRANSGENDER 50 49 1 - - - -
ADENZAI SUB-DIVISION
FEMALE 726,203 725,875 171 1O 18 - 129
URBAN
MALE 12 x9 7"""


def page(spark, text, source="s", number=1):
    rows = [(source, number, i, x) for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "source string, page int, line_no int, line string").repartition(3)


def rows_of(df, *drop):
    return [tuple(r)[len(drop) :] if not drop else tuple(v for c, v in r.asDict().items() if c not in drop) for r in df.orderBy("line_no").collect()]


def test_hierarchical(spark):
    out = parse_census(page(spark, CENSUS), "hierarchical")
    assert out.columns[3:6] == ["REGION", "SECTION", "AREA/SEX"] or out.columns[2:5] == ["REGION", "SECTION", "AREA/SEX"]
    got = [tuple(r)[2:] for r in out.orderBy("line_no").collect()]
    assert got == [
        ("LOWER DIR DISTRICT", "OVERALL", "ALL SEXES", 1436082, 1435332, 385, 29, 38, None, 298),
        ("LOWER DIR DISTRICT", "OVERALL", "MALE", 709829, 709408, 213, 19, 20, None, 169),
        ("LOWER DIR DISTRICT", "RURAL", "TRANSGENDER", 50, 49, 1, None, None, None, None),
        ("ADENZAI SUB-DIVISION", "RURAL", "FEMALE", 726203, 725875, 171, 18, None, 129, None),
        ("ADENZAI SUB-DIVISION", "URBAN", "MALE", 12, 7, None, None, None, None, None),
    ]


def kept(spark, preset, text=CENSUS):
    return {r["line_no"]: tuple(r)[-7:] for r in parse_census(page(spark, text), preset).drop("SOURCE_IMAGE").collect()}


def test_other_presets(spark):
    improved = kept(spark, "improved")
    assert sorted(improved) == [5, 6, 8, 10, 12]
    assert improved[10] == ("726203", "725875", "171", "1O", "18", None, "129") and improved[12] == ("12", "x9", "7", None, None, None, None)
    smart = kept(spark, "smart")
    assert sorted(smart) == [5, 6, 8, 10] and smart[10] == (726203, 725875, 171, 10, 18, None, 129)
    assert kept(spark, "multipage") == smart
    complete = kept(spark, "complete")
    assert sorted(complete) == [5, 6, 8] and complete[5] == ("1436082", "1435332", "385", "29", "38", "", "298")
    assert kept(spark, "r_complete") == {}
    assert sorted(PRESETS) == ["complete", "hierarchical", "improved", "multipage", "r_complete", "smart"]


def test_context_by_scope(spark):
    text = "A DISTRICT\nURBAN\nMALE 1 2 3 4 5 6 7"
    two = page(spark, text).unionByName(page(spark, "FEMALE 1 2 3 4 5 6 7", number=2))
    get = lambda p: sorted((r["SEX"], r["REGION"], r["SECTION"]) for r in parse_census(two, p).collect())
    assert get("smart") == [("FEMALE", "A DISTRICT", "URBAN"), ("MALE", "A DISTRICT", "URBAN")]
    assert get("multipage") == [("FEMALE", "", ""), ("MALE", "A DISTRICT", "URBAN")]
    odd = parse_census(page(spark, "males 1 2 3 4 5 6 7\nmale l O 3 Z 5 s 7"), "smart").collect()
    assert [(r["SEX"], r["TOTAL"], r["MUSLIM"], r["HINDU"], r["SCHEDULED_CASTES"]) for r in odd if r["line_no"] == 1] == [("MALE", 1, 0, 2, 5)]


def test_pairs(spark):
    text = "TABLE 9\nOVERALL\nLOWER DIR DISTRICT\nALL SEXES 1,436,082 1,435,332 385 29 38 - 298\na\nMALE 709,829 709,408 213 19 20 - 169\nRURAL\nADENZAI TEHSIL\nALL SEXES 10 9 1 - - -\nTIMERGARA TEHSIL\nSAMAR TEHSIL\nALL SEXES 1 2 3 4 5 6 7"
    out = parse_lines(page(spark, text)).orderBy("line_no").collect()
    assert [r["record"]["REGION"] for r in out] == ["LOWER DIR DISTRICT", "ADENZAI TEHSIL", "SAMAR TEHSIL"]
    first, second, third = (r["record"] for r in out)
    assert first["SEX"] == "ALL" and first["TOTAL"] == "1,436,082" and first["OTHERS"] == "298" and first["SOURCE_IMAGE"] == "s"
    assert "OTHERS" not in second and second["CASTE/SCHEDULED"] == "-"
    assert third["OTHERS"] == "7"
    names = record_names(parse_lines(page(spark, text)))
    assert names[:2] == ["SEX", "TOTAL"] and {"REGION", "SOURCE_IMAGE", "OTHERS"} <= set(names)
    table = named(parse_lines(page(spark, text)), names)
    assert table.where("OTHERS is null").count() == 1
    assert parse_census_pairs(page(spark, "A DISTRICT\nB DISTRICT")).count() == 0  # two words have no names


def test_names():
    from lectern.operators.package import MAPPINGS

    assert names_for(MAPPINGS, 8)[-1] == "OTHERS" and names_for(MAPPINGS, 6) is None
    assert names_for(MAPPINGS, 5)[0] == "POLLING_STATION" and names_for(MAPPINGS, 9, "election")[0] == "POLLING_STATION"
    assert unique_names(["a", "A", "b", "a", "a_2"]) == ["a", "A_2", "b", "a_3", "a_2_2"]


def test_lookup_join(spark):
    from lectern.operators.package import MAPPINGS

    rows = spark.createDataFrame([(i,) for i in (5, 6, 7, 8, 9, 9)], "n int")
    got = sorted((r["n"], (r["names"] or [None])[-1]) for r in looked_up(rows, mapping_table(spark, MAPPINGS), "n").collect())
    assert got == [(5, "REJECTED_VOTES"), (6, None), (7, "CASTE/SCHEDULED"), (8, "OTHERS"), (9, "EXTRACOL"), (9, "EXTRACOL")]


def test_election(spark):
    text = "CONSTITUENCY: NA-123 LAHORE-IV\nPOLLING STATION              REGISTERED    CAST    VALID    REJECTED\nPS-001 Govt School          1500          1200    1180     20    9"
    rows = [r["record"] for r in parse_election(page(spark, text)).orderBy("line_no").collect()]
    assert len(rows) == 2 and set(rows[0]) == {"POLLING_STATION", "SOURCE_IMAGE"} and rows[1]["REJECTED_VOTES"] == "REJECTED"
    more = parse_election(page(spark, text), ("PS-",)).collect()
    assert [r["record"]["POLLING_STATION"] for r in more] == ["PS-001 Govt School"] and more[0]["record"]["REJECTED_VOTES"] == "20"
    bare = parse_election(page(spark, text), ("PS-",), {"other": ["x"]}).collect()
    assert bare[0]["record"]["COL_5"] == "9"
    election = Config(values={"parsing": {"data_format": "election"}})
    assert parse_lines(page(spark, text), election).count() == 2


def test_generic_words(spark):
    rows = parse_generic(page(spark, "a b  c\n\n x"))
    assert sorted(map(tuple, (r["cells"] for r in rows.collect()))) == [("a", "b", "c"), ("x",)]
    assert widest(rows) == 3
    even = evened(rows, ["one", "two"], 3, prefix="COL_", first=0, keep=["line_no"]).orderBy("line_no")
    assert even.columns == ["line_no", "one", "two", "COL_2"] and [tuple(r)[1:] for r in even.collect()] == [("a", "b", "c"), ("x", None, None)]
    generic = Config(values={"parsing": {"data_format": "generic"}})
    assert {r["record"].get("COL_0") for r in parse_lines(page(spark, "a b  c\n\n xx"), generic).collect()} == {"a", "xx"}


def test_next_lines(spark):
    good = "x\nA DISTRICT\nALL 1 2 3 4 5 6 7\nURBAN\nB TEHSIL\nALL 1 2 3 4 5 6"
    bad = "A DISTRICT\nALL 1 2\nB TEHSIL"
    rows = parse_next_lines(page(spark, good).unionByName(page(spark, bad, "t"))).orderBy("source", "line_no").collect()
    assert [(r["source"], r["error"]) for r in rows] == [("s", None), ("s", None), ("t", "a region has no line after it")]
    assert rows[0]["record"]["OTHERS"] == "7" and rows[1]["record"]["OTHERS"] == ""


UNIVERSAL = """TABLE 9 - POPULATION BY SEX, RELIGION AND RURAL/URBAN
AREA/ SEX TOTAL MUSLIM CHRISTIAN HINDU OTHERS
1 2 3 4 5 6 7 8
LOWER DIR DISTRICT
OVERALL
ALL SEXES 1,436,082 1,435,332 385 29 - 298
TRANSGENDER - - - - - -
ADENZAI SUB-DIVISION
RURAL
FEMALE 726,203 725,875 171 10 - 129
1,234 5,678 9,101
YORK COUNTY
PUNJAB PROVINCE
ZOOS 12 34"""


def test_classifier(spark):
    rows = classified(page(spark, UNIVERSAL)).orderBy("line_no").collect()
    assert [r["kind"] for r in rows] == ["header", "header", None, "header", "section", "data", "data", "region", "section", "data", None, "header", "section", "data"]
    by = {r["line_no"]: (r["region"], r["section"]) for r in rows}
    assert by[5] == (None, "OVERALL") and by[7] == ("ADENZAI SUB-DIVISION", None) and by[9] == ("ADENZAI SUB-DIVISION", "RURAL") and by[13] == ("ADENZAI SUB-DIVISION", "PUNJAB PROVINCE")
    assert chosen_headers(classified(page(spark, UNIVERSAL))).collect()[0]["header"].startswith("AREA/ SEX")
    assert header_names("AREA/ SEX TOTAL MUSLIM") == ["AREA/SEX", "TOTAL", "MUSLIM"] and header_names("a  b c  d  e  f") == ["a", "b c", "d", "e", "f"]


def test_universal(spark):
    rows = [r["cells"] for r in universal_rows(page(spark, UNIVERSAL)).orderBy("line_no").collect()]
    assert rows[0] == ["", "OVERALL", "ALL SEXES", "1436082", "1435332", "385", "29", None, "298"]
    assert rows[-1] == ["ADENZAI SUB-DIVISION", "PUNJAB PROVINCE", "2005", "12", "34"]
    table = universal_table(page(spark, UNIVERSAL))
    assert table.columns == ["REGION", "SECTION", "AREA/SEX", "TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "OTHERS", "Col_9"] and table.count() == 4
    plain = universal_table(page(spark, "word 12 34\nword 12 34\nother 56"))
    assert plain.columns == ["REGION", "SECTION", "Column_1", "Column_2", "Column_3"] and plain.count() == 2
    assert universal_table(page(spark, "nothing")).count() == 0


@pytest.mark.parametrize("texts,french", [(["1,234", "5,678"], True), (["1,234 5,678 9,101"], False), ([*["x"] * 20, "1,234 5,678 9,101"], True)])
def test_style(spark, texts, french):
    assert {r["french"] for r in with_style(page(spark, "\n".join(texts))).collect()} == {french}


def test_generic_table(spark):
    cells = [["Name", "Votes A", "Votes B"], ["Lima", "1,234 votes", "12.5"], ["TOTAL", "123", "456"], ["", "77", "88"]]
    rows = spark.createDataFrame([("s", 1, i, c) for i, c in enumerate(cells)], "source string, page int, row_no int, cells array<string>")
    assert [r["cells"] for r in generic_rows(rows).orderBy("row_no").collect()] == [["Lima", "1234", "12", "5"], [None, "77", "88"]]
    table = generic_table(rows)
    assert table.columns == ["Name", "Votes A", "Votes B", "Column_4"] and table.count() == 2


def test_line_operators(spark):
    text = " OVERALL\t\noverall\n\na\né\n7\n-\n kept line  "
    assert [r["line"] for r in L.without_noise(page(spark, text), ["OVERALL"]).orderBy("line_no").collect()] == ["overall", "7", "-", "kept line"]
    lines = page(spark, "one\ntwo\nKEY x\nthree")
    assert [r["line"] for r in L.trimmed_to_keyword(lines, ["KEY"]).orderBy("line_no").collect()] == ["KEY x", "three"]
    assert L.trimmed_to_keyword(lines, ["key"]).count() == 4 and L.trimmed_to_keyword(lines, []).count() == 4
    assert [r["next_line"] for r in L.with_next(lines).orderBy("line_no").collect()] == ["two", "KEY x", "three", ""]
    assert L.after_marker(lines, "^two").count() == 2 and L.after_marker(lines, "^none").count() == 4
    assert [r["row_no"] for r in L.numbered(lines).orderBy("line_no").collect()] == [1, 2, 3, 4]
    assert L.longer_than(lines, 3).count() == 2
    assert L.scanned(lines.unionByName(page(spark, "x" * 101, "long"))).orderBy("source").collect()[0]["scanned"] is False


@pytest.mark.parametrize("parse", [lambda x: parse_census(x, "smart"), lambda x: parse_census(x, "hierarchical"), universal_rows, parse_lines])
def test_one_exchange_and_only_needed_columns(spark, tmp_path, parse):
    """All windows of a parser share one exchange, and the scan reads only the key and the text."""
    from lectern.sources.lines import lines_from_text

    spark.createDataFrame([(1, CENSUS, "x")], "k int, text string, more string").write.parquet(str(tmp_path / "docs"))
    plan = parse(lines_from_text(spark.read.parquet(str(tmp_path / "docs")), "k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ReadSchema: struct<k:int,text:string>" in plan


def test_widths_beyond_any_list(spark):
    from lectern.operators.package import MAPPINGS
    from lectern.operators.schema import names_column

    rows = spark.createDataFrame([(n, ["x"] * n) for n in (0, 1, 5, 8, 70, 600)], "n int, cells array<string>")
    own = {**MAPPINGS, "census_religion_70": [f"N{i}" for i in range(70)], "odd": ["a", "b"], "odd_too": ["c", "d"]}
    for mappings in (MAPPINGS, own):
        for prefix in ("census", "election"):
            got = {r["n"]: r["names"] for r in rows.select("n", names_column(mappings, F.col("n"), prefix).alias("names")).collect()}
            assert got == {n: names_for(mappings, n, prefix) if n else None for n in (0, 1, 5, 8, 70, 600)}
    assert widest(rows) == 600 and len(evened(rows, ["A"], widest(rows)).columns) == 600


def test_scanned_files_without_lines(spark):
    files = spark.createDataFrame([("a",), ("b",)], "source string")
    got = L.scanned(page(spark, "x" * 200, "a"), 100, files).collect()
    assert {r["source"]: r["scanned"] for r in got} == {"a": False, "b": True}


def test_head_and_tail(spark):
    from lectern.operators.analytics import head, tail

    rows = spark.range(10).repartition(3)
    assert [r["id"] for r in head(rows, 3, "id").collect()] == [0, 1, 2] and [r["id"] for r in tail(rows, 3, "id").collect()] == [7, 8, 9]
