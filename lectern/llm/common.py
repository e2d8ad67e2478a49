"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. With a local master (tests) and none set, one made for this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and later steps read it as often as they like."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of texts that go to a worker at once. Documents may be long, and Spark counts only rows.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches at no more than BATCH_ROWS rows from here on (a lower setting stays)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input files for each partition whose rows a worker gathers.
PARTITION_BYTES = 128 << 20


def partitions_for(df: DataFrame) -> int:
    """The session's number of partitions, or as many as the files that df reads need if that is more: what a worker gathers stays bounded as the input grows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(partitions(df.sparkSession), -(-sum(x for x in sizes if x < 1 << 60) // PARTITION_BYTES))  # beyond: not known


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of these names starts with (whatever its case)."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def range_bucket(df: DataFrame, key: str, n: int) -> tuple[Callable[[Column, Column], Column], bool]:
    """A function from (the integer key, a hash of the row) to the range of the row, of n ranges in ascending order (nulls first),
    and whether it looks at the hash.

    The cuts are quantiles of the key (mergeable sketches, read from that column alone; n values come to the driver), so that
    outliers and uneven keys don't matter. A key that holds several quantiles is spread over as many ranges by the hash, ascending too.
    """
    least = -(1 << 63)
    k = F.col(key)
    at, tied = df.agg(F.percentile_approx(F.coalesce(k, F.lit(least)), [i / n for i in range(1, n)] or [0.5], F.lit(max(10_000, 20 * n))), F.max(k == least)).first()
    cuts = np.array(sorted(at or [])[: n - 1], dtype=np.int64)
    hot = bool(len(cuts) > len(np.unique(cuts)))
    both = bool(tied)

    @F.arrow_udf("int")
    def place(keys: pa.Array, null: pa.Array, hashes: pa.Array) -> pa.Array:
        keys = keys.to_numpy()
        share = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        if both:  # nulls stand before the least key
            share = np.where(null.to_numpy(zero_copy_only=False), share / 2, np.where(keys == least, 0.5 + share / 2, share))
        before, upto = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
        many = upto - before
        return pa.array(np.where(many > 1, before + 1 + np.minimum((share * many).astype(np.int64), many - 1), upto).astype(np.int32))

    return (lambda key, hashed: place(F.coalesce(key, F.lit(least)), key.isNull(), hashed if hot else F.lit(0).cast("long"))), hot


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, each whole, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        begin = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, row
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Frees the memory that this process no longer uses."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker, which goes on to other tasks, gives back the memory that it no longer uses.

    What it calls is a function of the module: globals that the inner function named itself would be sent to the workers with it."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return lean_run


def texts_of(column: pa.Array) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, to bound what is unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts and the last one ends. Null counts as empty."""
    column = column.fill_null(pa.scalar("" if not pa.types.is_binary(column.type) else b"", column.type))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of lengths[0] items, then those of starts[1], and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit numbers (the finaliser of splitmix64, public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than space and 0x09 to 0x0D."""
    inside = np.ones(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    edge = np.diff(inside)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Low 0 to 8 bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Runs of more bytes are hashed one by one.
LONG_RUN = 2048


def runs_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the runs raw[start:end] of bytes, eight bytes a round for all runs at once: each block is mixed into what is
    mixed so far, so that no sum over places makes different runs alike whatever the seed. Long runs go through BLAKE2b."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    if not len(start):
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(8, np.uint8))), 8)
    long = np.flatnonzero(size > LONG_RUN)
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    live = np.flatnonzero((size > 0) & (size <= LONG_RUN))
    at, left = start[live], size[live]
    state = out[live]
    while len(live):
        block = np.ascontiguousarray(eight[at]).view("<u8")[:, 0] & _LOW[np.minimum(left, 8)]
        state = mix((state ^ block) * np.uint64(0xD1342543DE82EF95))
        done = left <= 8
        out[live[done]] = state[done]
        go = ~done
        live, at, left, state = live[go], at[go] + 8, left[go] - 8, state[go]
    return out


def chained(symbols: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n symbols, each symbol mixed into what is mixed so far."""
    many = max(0, len(symbols) - n + 1)
    state = np.full(many, 0xA0761D6478BD642F + n, dtype=np.uint64)
    for i in range(n):
        state = mix((state ^ symbols[i : i + many]) * np.uint64(0xD1342543DE82EF95))
    return state


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    up, down = _POWERS[size]
    return up[:n], down[:n]


def spans_hash(symbols: np.ndarray) -> callable:
    """A function from start and end positions to 64-bit hashes of symbols[start:end]; equal runs have equal hashes."""
    up, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * up[:-1], out=sums[1:])

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = sums[end] - sums[start]
        h *= down[start]
        h += (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return mix(h)

    return of


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _TABLE[raw]
