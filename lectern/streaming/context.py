"""Lines of sources that arrive in parts: context is carried from one part of a source to the next by a state a source, as the batch scans carry it within a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLACE = [StructField("source", StringType()), StructField("page", IntegerType()), StructField("line_no", IntegerType()), StructField("line", StringType())]


class _Carry(StatefulProcessor):
    """State of a source: its lines so far and the values in force."""

    def __init__(self, names: Sequence[str], idle_ms: int):
        self.names, self.idle_ms = list(names), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("context", StructType([StructField("n_lines", LongType()), *[StructField(f"v{i}", StringType()) for i in range(len(self.names))]]))
        self.ends = handle.getValueState("ends", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True)
        events = [f"_{kind}_{i}" for kind in ("value", "reset") for i in range(len(self.names))]
        part.columns = ["source", "page", "line_no", "line", *events]  # computed columns arrive without their names
        part = part.sort_values(["page", "line_no"], kind="stable", ignore_index=True)
        n, *values = self.state.get() if self.state.exists() else (0, *[None] * len(self.names))
        out = part[["source", "page", "line_no", "line"]].copy()
        for i, name in enumerate(self.names):
            own, reset = part[f"_value_{i}"], part[f"_reset_{i}"].fillna(False).astype(bool)
            event = own.notna() | reset
            seen = event.cumsum()
            last = own.where(own.notna(), None)[event].tolist()
            out[name] = [last[k - 1] if k else values[i] for k in seen]
            if last:
                values[i] = last[-1]
        out["ended"] = False
        out["n_lines"] = range(n + 1, n + len(part) + 1)
        self.state.update((n + len(part), *values))
        if self.idle_ms:
            if self.ends.exists():
                self.handle.deleteTimer(self.ends.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.ends.update((at,))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, *values = self.state.get()
        self.state.clear()
        self.ends.clear()
        yield pd.DataFrame([{"source": key[0], "page": None, "line_no": None, "line": None, **dict(zip(self.names, values, strict=True)), "ended": True, "n_lines": n}]).astype({"page": "Int32", "line_no": "Int32"})

    def close(self) -> None:
        pass


def carried_stream(lines: DataFrame, values: dict[str, Column], resets: dict[str, Column] | None = None, idle_ms: int = 0) -> DataFrame:
    """lines (a stream of source, page, line_no, line) with, for each name, its latest non-null text up to the row since the latest row where its reset holds (a value on
    that row counts), over all parts of a source so far; ``n_lines`` numbers the lines of a source. Parts are taken in the order they arrive in, and the lines of a source that arrive
    together by page and line_no: these are held in one task, and bounded by the files of a batch. idle_ms: a source without a line for so long is
    ended by a timer: a row with ``ended``, its last values and number of lines, and its state goes; such a
    stream asks for batches as long as it runs, so it is not for ``once``. Without it states stay. The session needs the RocksDB state store (see started)."""
    resets = resets or {}
    events = lines.select("source", F.col("page").cast("int").alias("page"), F.col("line_no").cast("int").alias("line_no"), "line",
                          *[v.cast("string").alias(f"_value_{i}") for i, v in enumerate(values.values())],
                          *[F.coalesce(resets.get(n, F.lit(False)), F.lit(False)).alias(f"_reset_{i}") for i, n in enumerate(values)])
    schema = StructType([*_PLACE, *[StructField(n, StringType()) for n in values], StructField("ended", BooleanType()), StructField("n_lines", LongType())])
    return events.groupBy("source").transformWithStateInPandas(_Carry(list(values), idle_ms), schema, "Append", "ProcessingTime" if idle_ms else "None")


def started(stream: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Writes a stream with such states to Parquet, on the state store that they need; the session's own setting comes back."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
