"""HTTP fetch with retries, as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "url string, status int, attempts int, content binary, error string, host string, turn int"
Get = Callable[[str, float], tuple[int, bytes]]


def get(url: str, timeout: float) -> tuple[int, bytes]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310  certificates are always verified
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def fetch_one(url: str, retries: int = 3, timeout: float = 30, fetch: Get = get, sleep: Callable[[float], None] = time.sleep) -> dict:
    """200 ends with the content, 404 ends at once, another status is tried again, a failure too after 1, 2, 4 ... seconds."""
    status, error = None, None
    for attempt in range(1, retries + 1):
        try:
            status, content = fetch(url, timeout)
            error = None
        except OSError as e:
            status, error = None, f"{type(e).__name__}: {e}"
            if attempt < retries:
                sleep(2 ** (attempt - 1))
            continue
        if status == 200:
            return {"url": url, "status": status, "attempts": attempt, "content": content, "error": None}
        if status == 404:
            break
    return {"url": url, "status": status, "attempts": attempt, "content": None, "error": error or f"status {status}"}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def _by_host(retries: int, timeout: float, delay: float, fetch: Get, sleep: Callable[[float], None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("url", pa.string()), ("status", pa.int32()), ("attempts", pa.int32()), ("content", pa.binary()), ("error", pa.string()), ("host", pa.string()), ("turn", pa.int32())])
        host, turn, last = None, 0, 0.0
        for batch in batches:
            for url, own in zip(batch.column("url").to_pylist(), batch.column("host").to_pylist(), strict=True):
                turn = turn + 1 if own == host else 1
                wait = last + delay - time.monotonic()
                if own == host and wait > 0:  # other hosts' requests don't count
                    sleep(wait)
                row = fetch_one(url, retries, timeout, fetch, sleep)
                host, last = own, time.monotonic()
                yield pa.RecordBatch.from_pylist([{**row, "host": own, "turn": turn}], schema=kinds)

    return run


def fetched(urls: DataFrame, retries: int = 3, timeout: float = 30, delay: float = 3, tasks: int | None = None, fetch: Get = get, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row a url. Urls are dealt to tasks by host, so that a host is asked by one task, url after url in order, with the delay between two requests,
    however many tasks there are. Failures are rows. A null url has no row; ``turn`` numbers a host's requests."""
    rows = urls.where(F.col("url").isNotNull()).select("url", host_of(F.col("url")).alias("host"))
    # a set number: few bytes of urls would be put together in one task
    dealt = rows.repartition(tasks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "host")
    return dealt.sortWithinPartitions("host", "url").mapInArrow(_by_host(retries, timeout, delay, fetch, sleep), SCHEMA)
