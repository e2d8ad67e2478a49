"""Segmented scans against plain windows, and their plans."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import lines as L

SCHEMA = "source string, page int, line_no int, line string, region string, section string"


@pytest.fixture(scope="module")
def lines(spark):
    r = random.Random(12)
    rows, source = [], ["a", None, "b", "c"]
    for s in source:
        for page in sorted(r.sample(range(-3, 4000), 60 if s != "c" else 1)):
            for n in sorted(r.sample(range(0, 40), r.randint(1, 12))):
                rows.append((s, page, n, r.choice(("x", "KEY", None, "DISTRICT 1", "y")) if s != "b" else f"line {n}", "R" + str(r.random()) if r.random() < 0.02 else None, "S" + str(r.random()) if r.random() < 0.05 else None))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(params=[(4096, 1024), (3, 2), (1, 1), (7, 100)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_LINES", request.param[0])
    monkeypatch.setattr(L, "SPAN_PAGES", request.param[1])


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted(map(str, x.select(*sorted(a.columns)).collect())) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("scope", ["source", "page"])
def test_carried(lines, sizes, scope):
    values = {"R": F.col("region"), "S": F.col("section")}
    plain = lines.withColumns({n: F.last(v, ignorenulls=True).over(L.so_far(scope)) for n, v in values.items()})
    same(L.carried_all(lines, values, scope, long=True), plain)
    same(L.carried(lines, "section", F.col("section"), scope, long=True), lines.withColumn("section", F.last("section", ignorenulls=True).over(L.so_far(scope))))


@pytest.mark.parametrize("scope", ["source", "page"])
def test_carried_within(lines, sizes, scope):
    reset = F.col("region").isNotNull()
    marked = lines.withColumn("_part", F.sum(reset.cast("int")).over(L.so_far(scope)))
    own = Window.partitionBy(*L.SCOPES[scope], "_part").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same(L.carried_within(lines, "S", F.col("section"), reset, scope, long=True), marked.withColumn("S", F.last("section", ignorenulls=True).over(own)).drop("_part"))


@pytest.mark.parametrize("scope,default", [("source", ""), ("page", None)])
def test_next_line(lines, sizes, scope, default):
    same(L.with_next(lines, "n", default, scope, long=True), lines.withColumn("n", F.lead("line", 1, default).over(L.in_order(scope))))


@pytest.mark.parametrize("scope", ["source", "page"])
def test_first_hits(lines, scope):
    number, every = F.row_number().over(L.in_order(scope)), Window.partitionBy(*L.SCOPES[scope])
    hit = F.col("line").contains("KEY")
    marked = lines.withColumn("_n", number).withColumn("_first", F.min(F.when(hit, F.col("_n"))).over(every))
    same(L.from_first(lines, hit, scope, long=True), marked.where(F.col("_first").isNull() | (F.col("_n") >= F.col("_first"))).drop("_n", "_first"))
    same(L.after_marker(lines, "KEY", scope, long=True), marked.where(F.col("_first").isNull() | (F.col("_n") > F.col("_first"))).drop("_n", "_first"))


def test_first_rows(lines):
    same(L.first_rows(lines, 3), lines.withColumn("_n", F.row_number().over(L.in_order())).where("_n <= 3").drop("_n"))


def test_no_hit_and_no_lines(lines):
    same(L.from_first(lines, F.lit(False), long=True), lines)
    none = lines.where("page > 9999")
    assert L.carried_all(none, {"r": F.col("region")}, long=True).collect() == [] and L.with_next(none, long=True).collect() == [] and L.after_marker(none, "x", long=True).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_hits_need_no_window(lines):
    assert "Window" not in plan_of(L.trimmed_to_keyword(lines, ["KEY"], long=True)) and "Window" not in plan_of(L.after_marker(lines, "KEY", long=True))
    assert "WindowGroupLimit" in plan_of(L.first_rows(lines, 20))


def test_one_source_is_many_tasks(spark, monkeypatch):
    """A single source: no partition of its lines holds over a 16th of them."""
    monkeypatch.setattr(L, "BLOCK_LINES", 64)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # tasks as planned, not put together as rows are few
    try:
        df = spark.range(40_000).select(F.lit("one").alias("source"), F.floor(F.col("id") / 200).cast("int").alias("page"), (F.col("id") % 200).cast("int").alias("line_no"), F.concat(F.lit("l"), "id").alias("line"))
        for rows in (L.carried(df, "r", F.when(F.col("line_no") == 77, F.col("line")), long=True), L.with_next(df, long=True)):
            most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert most < 40_000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_parsers_of_long_sources(spark, monkeypatch):
    """The parsers give the same by blocks as by windows."""
    from lectern.operators.census import PRESETS, parse_census
    from lectern.operators.universal import universal_rows

    monkeypatch.setattr(L, "BLOCK_LINES", 4)
    monkeypatch.setattr(L, "SPAN_PAGES", 2)
    r = random.Random(5)
    kinds = ["NORTH DISTRICT", "OVERALL", "RURAL", "ALL SEXES 1,200 1,100 10 20 30 - 5", "MALE 600 500 10 20 30 - 5", "FEMALE 600 500 10 20 30 - 5", "AREA/SEX TOTAL MUSLIM CHRISTIAN", "noise"]
    df = spark.createDataFrame([("a", n // 9, n % 9, r.choice(kinds)) for n in range(300)], "source string, page int, line_no int, line string").repartition(3)
    for preset in PRESETS:
        a, b = (sorted(map(str, parse_census(df, preset, long=x).collect())) for x in (False, True))
        assert a == b
    assert sorted(map(str, universal_rows(df).collect())) == sorted(map(str, universal_rows(df, long=True).collect()))


def test_first_hits_of_one_source_are_many_tasks(spark, monkeypatch):
    """What is cut at a first hit, and the package's parsers, hold no source in one task."""
    from lectern.config import Config
    from lectern.operators.package import parse_lines

    monkeypatch.setattr(L, "BLOCK_LINES", 64)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(40_000).select(F.lit("one").alias("source"), F.floor(F.col("id") / 200).cast("int").alias("page"), (F.col("id") % 200).cast("int").alias("line_no"), F.concat(F.lit("DISTRICT ALL a b c "), "id").alias("line"))
        kinds = [parse_lines(df, Config(values={"parsing": {"data_format": k, "keywords": {k: ["DISTRICT"]}}}), long=True) for k in ("census", "election", "generic")]
        for rows in (L.from_first(df, F.col("line").endswith(" 17"), long=True), L.after_marker(df, " 17$", long=True), *kinds):
            assert rows.count() > 39_900 or rows is kinds[0]
            most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert most < 40_000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
