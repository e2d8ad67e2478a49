"""Places in a global order, exact quantiles by refinement, fetches by host, and the guard of the entry points."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import cleaning as C
from lectern.operators import profile as P
from lectern.sources import fetch

REPO = Path(__file__).parent.parent


def test_places_over_ranges(spark):
    rows = spark.range(7000).select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("x"), F.when(F.col("id") % 10 > 0, F.col("id") % 100).alias("y")).repartition(6)
    got = C.placed(rows, F.col("x").desc(), F.col("y").asc_nulls_last(), F.col("id")).collect()
    order = sorted(got, key=lambda r: (-r["x"], r["y"] is None, r["y"] or 0, r["id"]))
    assert [r["place"] for r in order] == list(range(1, 7001))


def test_places_of_ties_and_of_nothing(spark):
    same = spark.range(500).select(F.lit(1).alias("x"))
    assert sorted(r["place"] for r in C.placed(same, F.col("x")).collect()) == list(range(1, 501))
    assert C.placed(same.where("x = 2"), F.col("x")).collect() == []


def test_places_need_no_window(spark):
    plan = C.placed(spark.range(100).toDF("x"), F.col("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 300, [*range(1001)], [1e308, -1e308, 0.0, 5e-324, -5e-324], [10.0**k for k in range(-300, 300)], [0.1 * i for i in range(5000)] + [7.0] * 5000])
@pytest.mark.parametrize("ranges", [2, 1024])
def test_exact_quantiles(spark, monkeypatch, values, ranges):
    monkeypatch.setattr(P, "RANGES", ranges if len(values) < 100 else 1024)
    values = [float(v) for v in values]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, None if i % 2 else v) for i, v in enumerate(values)] + [(None, None)], "a double, b double").repartition(3)
    parts = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = P.exact_quantiles(df, ["a", "b"], parts)
    # halves, as the difference of the greatest doubles is none
    assert np.allclose(np.array(got["a"]) / 2, np.quantile(np.array(values) / 2, parts), rtol=1e-12, atol=0)
    assert np.allclose(np.array(got["b"]) / 2, np.quantile(np.array(values[::2]) / 2, parts), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"), 3)], "a double, b double, c int")
    assert P.exact_quantiles(df, ["a", "b", "c"]) == {"a": [None] * 3, "b": [None] * 3, "c": [3.0] * 3}
    assert [r["50%"] for r in P.describe(df, ["a", "c"]).collect()] == [None, 3.0]


def test_hosts(spark):
    urls = ["https://User@Ex.org:80/a?b=http://c.d/", "http://ex.org", "ftp://h/x", "no url", "https://é.org/x"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(fetch.host_of(F.col("url"))).collect()] == ["ex.org", "ex.org", "h", "", "é.org"]


def test_fetches_by_host(spark, tmp_path):
    """Requests of a host come one after the other, in order and with the delay; hosts are dealt to tasks; failures are rows."""
    log = tmp_path / "log"
    log.mkdir()

    def served(url: str, timeout: float) -> tuple[int, bytes]:
        import os
        import time

        with open(log / f"{time.monotonic():020.6f}-{os.getpid()}-{url[7:].replace('/', '_')}", "w"):
            pass
        if url.endswith("7"):
            raise OSError("down")
        return (404 if url.endswith("3") else 200), url.encode()

    urls = [f"http://h{i % 6}/{i // 6}" for i in range(60)]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string").repartition(5)
    rows = fetch.fetched(df, retries=1, delay=0.01, fetch=served).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["url"] for r in rows) == sorted(urls)
    assert all((r["status"], r["error"]) == ((None, "OSError: down") if r["url"].endswith("7") else (404, "status 404") if r["url"].endswith("3") else (200, None)) for r in rows)
    assert len({r["task"] for r in rows}) > 1
    for h in range(6):
        own = sorted((r for r in rows if r["host"] == f"h{h}"), key=lambda r: r["turn"])
        assert [r["url"] for r in own] == sorted(r["url"] for r in own) and len({r["task"] for r in own}) == 1
        times = [float(p.name.split("-")[0]) for p in sorted(log.iterdir()) if f"-h{h}_" in p.name]
        assert len(times) == 10 and min(np.diff(times)) >= 0.01


def test_entry_points_without_the_subpackage(tmp_path):
    """Also with a folder of it that is left with nothing but caches."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "tests", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy).returncode == 0
    (copy / "lectern" / "llm" / "__pycache__").mkdir(parents=True)
    (copy / "corpus_pipeline.py").write_text("from lectern.llm import bpe\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=copy).returncode == 0
