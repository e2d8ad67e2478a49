"""Queries of files on tables that are folders, and of one file that many tasks write and read."""

import pytest
from pyspark.sql import functions as F

from lectern.queries import tables
from lectern.queries.files import file_listing


def test_tables_that_are_folders_are_listed_once(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(10).write.parquet(str(tmp_path / "region.parquet"))
    (tmp_path / "nation.parquet").write_bytes(b"x")
    (tmp_path / "empty.parquet").write_bytes(b"")
    got = sorted(map(tuple, file_listing(spark, str(tmp_path)).collect()))
    assert got == [("empty", False), ("nation", True), ("orders", True), ("region", True)]


@pytest.mark.parametrize("query,sink", [("json_round_trip", "to_json"), ("csv_round_trip", "to_csv")])
def test_round_trips_take_as_many_tasks_as_the_session_has_partitions(spark, tmp_path, monkeypatch, query, sink):
    orders = spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    plans, write = [], getattr(tables, sink)
    monkeypatch.setattr(tables, sink, lambda rows, path: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, path))[1])
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = tables.QUERIES[query](spark, str(tmp_path)).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "hashpartitioning(key" in plans[0] and plans[0].count(", 23)") == 2  # the exchange by key and the sort's
    assert [tuple(r) for r in got] == [(1999 - i, i, '1-URGENT, "O" <&> é', i % 7 if i % 7 % 3 else None) for i in range(1999, -1, -1)]
