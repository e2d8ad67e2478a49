"""Keyword tables by automaton and by index, exact distinct counts, and context over parts of a stream."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import keywords as K
from lectern.operators import profile as P
from lectern.streaming.context import carried_stream, started

WAYS = [K.by_automaton, K.by_index, K.contained]


def brute(texts, words):
    return sorted((i, w) for i, t in texts if t is not None for w in {x for x in words if x} if w in t)


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("hot", [1e-5, 0.01, 1.0])
def test_keywords_equal_brute_force(spark, monkeypatch, way, hot):
    monkeypatch.setattr(K, "HOT_SHARE", hot)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    texts = [(i, make(rng.randrange(60))) for i in range(80)] + [(80, None), (81, ""), (82, "abab" * 3000), (83, "a\nb"), (84, "a\nb")]
    words = [make(rng.randrange(1, 7)) for _ in range(120)] + ["a", "é", "abab", "abababab", "", None, "a\nb", "zzzzz", "a", "ABAB"]
    rows = way(spark.createDataFrame(texts, "id int, line string"), spark.createDataFrame([(w,) for w in words], "keyword string"), ["id"])
    assert sorted(map(tuple, rows.collect())) == brute(texts, words)


@pytest.mark.parametrize("way", WAYS)
def test_keywords_without_rows(spark, way):
    texts, words = spark.createDataFrame([(1, "ab")], "id int, line string"), spark.createDataFrame([("ab",)], "keyword string")
    assert way(texts, words.where("false"), ["id"]).count() == 0
    assert way(texts.where("false"), words, ["id"]).count() == 0
    assert way(texts.withColumnRenamed("line", "keyword"), words, ["id"], "keyword").collect() == [(1, "ab")]


def test_keywords_plans(spark):
    texts, words = spark.range(10).select("id", F.col("id").cast("string").alias("line")), spark.createDataFrame([("1",)], "keyword string")
    assert K.fits(words)
    plans = [w(texts, words, ["id"])._jdf.queryExecution().toString() for w in WAYS[:2]]
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans) and "Exchange" not in plans[0]


@pytest.mark.parametrize("small,grams", [(0, 1 << 20), (0, 40), (100_000, 40)])
def test_keyword_index_in_parts_equals_brute_force(spark, monkeypatch, small, grams):
    monkeypatch.setattr(K, "SMALL_INDEX", small)
    monkeypatch.setattr(K, "MOST_GRAMS", grams)
    monkeypatch.setattr(K, "CHUNK", 64)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abé😀 ") for _ in range(n))
    texts = [(i, make(rng.randrange(50)) if i % 7 else None) for i in range(90)]
    words = [make(rng.randrange(1, 8)) for _ in range(90)]
    rows = K.by_index(spark.createDataFrame(texts, "id int, line string"), spark.createDataFrame([(w,) for w in words], "keyword string"), ["id"])
    assert sorted(map(tuple, rows.collect())) == brute(texts, words)


def test_texts_of_a_small_index_stay_where_they_are(spark):
    texts = spark.range(1000).select("id", F.concat(F.lit("text number "), "id").alias("line"))
    words = spark.createDataFrame([("number 77",), ("absent",)], "keyword string")
    rows = K.by_index(texts, words, ["id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1
    assert sorted(r["id"] for r in rows.collect()) == [77, *range(770, 780)]


def test_distinct_counts_of_every_type(spark):
    zero = datetime.datetime(2024, 10, 27, 1, 30, tzinfo=datetime.timezone.utc)
    rows = [(i % 7, -2**63 if i % 2 else 2**63 - 1, -(i % 5), None, "x" * (i % 4), [0.0, -0.0, float("nan"), 1.5][i % 4], i % 2 == 0, bytes([i % 3]), zero + datetime.timedelta(hours=i % 2), [i % 6], 5) for i in range(60)]
    rows.append((None,) * 11)
    schema = "small int, wide long, below byte, nothing int, text string, real double, flag boolean, raw binary, at timestamp, cells array<int>, `one.a` short"
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # both hours read 02:30 there
    try:
        got = P.column_info(spark.createDataFrame(rows, schema).repartition(3))
        assert [tuple(r)[2:] for r in got.collect()] == [(60, 1, 7), (60, 1, 2), (60, 1, 5), (0, 61, 0), (60, 1, 4), (60, 1, 3), (60, 1, 2), (60, 1, 3), (60, 1, 2), (60, 1, 6), (60, 1, 1)]
        assert [r["Column"] for r in got.collect()] == T._parse_datatype_string(schema).names
        none = P.column_info(spark.createDataFrame([], schema)).collect()
        assert len(none) == 11 and {r["Unique"] for r in none} == {0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_distinct_counts_copy_no_row(spark):
    plan = P.column_info(spark.range(100).select("id", F.col("id").cast("string").alias("t")))._jdf.queryExecution().toString()
    assert "Expand" not in plan and "bitmap_construct_agg" in plan.lower().replace("bitmapconstructagg", "bitmap_construct_agg")


def test_context_goes_over_parts(spark, tmp_path):
    """Three parts, started anew between two of them: states come from the checkpoint."""
    schema = "source string, page int, line_no int, line string"
    parts = [[("s", 1, 1, "x"), ("s", 1, 0, "R one"), ("t", 1, 0, "y"), ("s", 2, 0, "S a")], [("s", 3, 0, "z"), ("t", 2, 0, None)], [("s", 4, 1, "w"), ("s", 4, 0, "R two"), ("t", 3, 0, "S b")]]
    line = F.col("line")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            continue  # the first two parts are there at the first start
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        region = F.when(line.startswith("R"), line)
        out = carried_stream(files, {"region": region, "section": F.when(line.startswith("S"), line)}, {"section": region.isNotNull()})
        started(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).orderBy("source", "n_lines").select("source", "line", "region", "section").collect()
    assert list(map(tuple, got)) == [
        ("s", "R one", "R one", None), ("s", "x", "R one", None), ("s", "S a", "R one", "S a"), ("s", "z", "R one", "S a"), ("s", "R two", "R two", None), ("s", "w", "R two", None),
        ("t", "y", None, None), ("t", None, None, None), ("t", "S b", None, "S b")]


def test_idle_sources_end(spark, tmp_path):
    schema = "source string, page int, line_no int, line string"
    spark.createDataFrame([("s", 1, 0, "R s"), ("s", 1, 1, "x")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = carried_stream(files, {"region": F.when(F.col("line").startswith("R"), F.col("line"))}, idle_ms=1)
    query = started(out, str(tmp_path / "out"), str(tmp_path / "ck"), once=False)
    try:
        for _ in range(120):
            time.sleep(0.5)
            assert query.exception() is None
            if any(p["batchId"] >= 2 for p in query.recentProgress):
                break
    finally:
        query.stop()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("ended").select("source", "page", "line", "region", "n_lines").collect()
    assert list(map(tuple, got)) == [("s", None, None, "R s", 2)]
