"""Document fingerprints by order MinHash.

The k-mers of a text (k code points) are numbered by occurrence. Each of ``FUNCTIONS`` hash functions selects the ``TUPLE``
least numbered k-mers, keeps them in text order, and hashes the tuple of k-mers to 32 bits; these make up the fingerprint. The share of equal
components rises as the edit distance falls, and unlike plain MinHash it falls when passages change places.

A text of fewer than k code points is one k-mer; a null text is empty and has a fingerprint that only empty texts
have. Equal texts have equal fingerprints. Very long texts are read whole, a slice of the functions at a time. Repeated rows keep a row
each. In `against_next` ids may be any 64-bit integers, null ids come after all others, equal ids by a hash of their text, and a table of one row is followed by itself; an
empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, mix, partitions, range_bucket, slices, table

K = 8
FUNCTIONS = 32
TUPLE = 2
#: Cells of the matrix of functions and k-mers that are held at once.
CELLS = 1 << 20

_DRAWN = np.random.default_rng(20_240_101)
_XOR = _DRAWN.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)[:, None]
_MULTIPLY = _DRAWN.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)[:, None] | np.uint32(1)
_P = 0x100000001B3


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each run of k code points (of all, if they are fewer)."""
    x = points.astype(np.uint64)
    length = len(x)
    if not length:
        return x
    k = min(k, length)
    out, width, code = None, 1, x
    for bit in range(k.bit_length()):  # joins runs of 1, 2, 4, ... as the bits of k say
        if k >> bit & 1:
            if out is None:
                out, done = code, width
            else:
                out = out[: len(out) - width] * np.uint64(pow(_P, width, 1 << 64)) + code[done:]
                done += width
        if 2 * width <= k:
            code = code[:-width] * np.uint64(pow(_P, width, 1 << 64)) + code[width:]
            width *= 2
    return mix(out + np.uint64(k))


def numbered(code: np.ndarray) -> np.ndarray:
    """32-bit hashes of (k-mer, occurrence)."""
    n = len(code)
    bits = max(1, (n - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = np.sort(code & ~low | np.arange(n, dtype=np.uint64))
    again = np.flatnonzero((key[1:] ^ key[:-1]) <= low) + 1
    out = code.copy()
    if len(again):
        fresh = np.concatenate(([True], np.diff(again) != 1))
        begin = again[np.maximum.accumulate(np.where(fresh, np.arange(len(again)), 0))]
        out[(key[again] & low).astype(np.int64)] += (again - begin + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = kmers(points)
    if not len(code):
        return np.zeros(FUNCTIONS, dtype=np.uint32)
    x = numbered(code)
    some = min(TUPLE, len(x))
    chosen = np.empty((FUNCTIONS, some), dtype=np.int64)
    step = max(1, CELLS // len(x))
    for f in range(0, FUNCTIONS, step):
        order = (x ^ _XOR[f : f + step]) * _MULTIPLY[f : f + step]
        rows = np.arange(len(order))
        for t in range(some):
            least = order.argmin(axis=1)
            chosen[f : f + step, t] = least
            if t + 1 < some:
                order[rows, least] = 0xFFFFFFFF
    chosen.sort(axis=1)
    out = np.arange(1, FUNCTIONS + 1, dtype=np.uint64)
    for t in range(some):
        out = mix(out * np.uint64(_P) + code[chosen[:, t]])
    return np.maximum((out >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) dealt into ranges of doc_id, the highest ids in the last one, each sorted by descending id (nulls last),
    then by a hash of the text. Each range ends with what follows it, marked ghost: the first rows of the next range; after the last, the first."""
    deal, hot = range_bucket(docs, "doc_id", n)
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", F.col("doc_id").isNotNull().cast("int").alias("there"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), tie.alias("tie"))
    rows = rows.withColumn("range", deal(F.col("doc_id"), F.col("tie")))
    order = ("there", "key", *["tie"] * hot)
    heads = {b: tuple(k) for b, k in rows.groupBy("range").agg(F.max(F.struct(*order))).collect()}  # a row a range
    if not heads:
        return rows.select("doc_id", "text", "range", F.lit(False).alias("ghost"))
    ranges = sorted(heads)
    serves = {b: ranges[(i + 1) % len(ranges)] for i, b in enumerate(ranges)}
    size = ranges[-1] + 1

    def of_range(values: dict[int, int], kind: str) -> Column:
        return F.get(F.expr("array(" + ",".join(f"cast('{values.get(b, 0)}' as {kind})" for b in range(size)) + ")"), F.col("range"))

    is_head = F.lit(True)
    for i, c in enumerate(order):
        is_head &= F.col(c) == of_range({b: k[i] for b, k in heads.items()}, "bigint")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    places = F.when(is_head, F.array(own, F.struct(of_range(serves, "int").alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    dealt = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "there", "key", "tie", "place.*")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "ghost", F.desc("there"), F.desc("key"), F.desc("tie"), "text").select("doc_id", "text", "range", "ghost")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row with the text that follows it and the fingerprints of both."""
    held = None
    for batch in slices(batches):
        for doc_id, text, ghost in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "ghost")], strict=True):
            text = text or ""
            if held is None and ghost:
                continue  # a further row with the head's id
            mark = fingerprint(text)
            if held is not None:
                yield (*held, text, mark)
            held = None if ghost else (doc_id, text, mark)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(x or "").tobytes().hex() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last third replaced by the start of the next document), and how alike they are."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc_id, text, mark, after, after_mark in _pairs(batches):
            third = len(text) // 3
            edited = text[: len(text) - third] + after[:third]
            edited_mark = mark if edited == text else fingerprint(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc_id, len(text), digest, mark.tobytes().hex(), edited_mark.tobytes().hex(), likeness(mark, edited_mark), likeness(mark, after_mark)))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    dealt = with_next(bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), partitions(docs.sparkSession))
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))
