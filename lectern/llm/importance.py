"""Target-distribution importance resampling: documents drawn by how much likelier their hashed n-grams are in a target corpus.

Features are all runs of 1 to 3 consecutive words, joined by one space, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo
the number of buckets. Batches of texts stay the UTF-8 bytes that Arrow holds: a lookup table says which bytes are
of words, differences of that where words start and end, and the CRC automaton, driven by its table, goes on from all starts at once, two
bytes a step, one word, then a space and the next, then the third. Each state on the way is a feature.

1. Buckets of all documents and of the target are counted in the workers' tasks, so that a row for each task and bucket is exchanged at most.
2. A bucket's gain is the floor of 1000 times the log ratio of its smoothed shares. The gains (a number a bucket) go to all workers.
3. A document's weight is the sum of its features' gains; a Gumbel number from its id is added, and the highest scores are drawn, which
   draws without replacement in proportion to the exponential weights.
4. Ranks: those that may be drawn are dealt into ranges by (score, id), sorted there, and numbered by the rows of the ranges before.

Odd rows: a null or empty text has no words, no features and weight 0. Very long texts and words are read whole. A null id has the
hash of ``42:null`` and comes after all ids; of rows that tie in score and id, which comes first goes by their features and weight, and rows alike in all
of these take ranks next to each other. An empty target has no counts (its smoothed shares are equal); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, lean, partitions, slices, table, utf8, written

BUCKETS = 10_000
LONGEST = 3
FEWEST_WORDS = 20
PERCENT = 5
SEED = "42"
#: A longer word's bytes go through the CRC of the library at once.
LONG_WORD = 64

_BYTE = np.arange(256)
_WORD = (_BYTE >= 0x30) & (_BYTE <= 0x39) | (_BYTE >= 0x61) & (_BYTE <= 0x7A) | (_BYTE >= 0x80)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte, and what two bytes, do to the automaton's state (reflected polynomial 0xEDB88320)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    low = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        low = one[low & 0xFF] ^ low >> 8
    return one, low


_ONE, _TWO = _crc_tables()


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased texts end to end, and each text's first word."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = _WORD[raw]
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cut = np.unique(bounds[1:-1])  # a text ends a word, and the next one starts its own
    starts[cut] |= inside[cut]
    cut = cut[cut > 0]
    stops[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(start, bounds)


def advance(state: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The automaton's states after the bytes start to end of each; raw ends with a spare byte."""
    out = state.copy()
    size = end - start
    long = np.flatnonzero(size > LONG_WORD)
    for i in long.tolist():
        out[i] = ~np.uint32(zlib.crc32(raw[start[i] : end[i]], int(~state[i])))
    order = np.argsort(np.where(size > LONG_WORD, 0, size).astype(np.uint8), kind="stable")[::-1]
    size, at = np.where(size > LONG_WORD, 0, size)[order], start[order]
    now = state[order]
    reach = len(size) - np.searchsorted(size[::-1], np.arange(1, LONG_WORD + 1))  # words of at least so many bytes
    for step in range(0, LONG_WORD, 2):
        one, two = int(reach[step]), int(reach[step + 1])
        if not one:
            break
        here = at[:two] + step
        pair = raw[here].astype(np.uint32) | raw[here + 1].astype(np.uint32) << np.uint32(8)
        last = now[two:one]
        last = _ONE[(last ^ raw[at[two:one] + step]) & np.uint32(0xFF)] ^ last >> np.uint32(8)
        now[:two] = _TWO[(now[:two] ^ pair) & np.uint32(0xFFFF)] ^ now[:two] >> np.uint32(16)
        now[two:one] = last
    short = np.flatnonzero(size)
    out[order[short]] = now[short]
    return out


def features(column: pa.Array, longest: int = LONGEST) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of 1, 2, ... words of a column's texts: their CRCs, in order of their first words, and these first words; and each text's first word."""
    raw, bounds = utf8(column)
    raw = lowered(raw)
    start, end, first = word_bounds(raw, bounds)
    raw = np.append(raw, np.uint8(0))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    state, at = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32), np.arange(len(start))
    codes, places = [], []
    for more in range(longest):
        if more:
            stays = np.flatnonzero(at + more < first[owner[at] + 1])
            state, at = state[stays], at[stays]
            state = _ONE[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ state >> np.uint32(8)
        state = advance(state, raw, start[at + more], end[at + more])
        codes.append(~state)
        places.append(at)
    return codes, places, first


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches):
            for codes in features(batch.column("text"))[0]:
                total += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of the table's texts."""
    return bounded(texts).select("text").mapInArrow(lean(_counted(buckets)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A gain for each bucket: as many numbers come to the driver as there are buckets."""
    both = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = written(both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    s_all, t_all = counts.agg(F.sum("s").cast("double"), F.sum("t").cast("double")).first()
    ratio = (F.col("t").cast("double") + 1) * F.lit(s_all + buckets) / ((F.col("s").cast("double") + 1) * F.lit(t_all + buckets))
    gains = np.zeros(buckets, dtype=np.int64)
    for bucket, gain in counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long")).collect():
        gains[bucket] = gain
    return gains


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, places, first = features(batch.column("text"))
            weight, n = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for code, at in zip(codes, places, strict=True):
                cut = np.searchsorted(at, first)
                sums = np.concatenate(([0], np.cumsum(gains[code % np.uint32(len(gains))])))
                weight += sums[cut[1:]] - sums[cut[:-1]]
                n += np.diff(cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A whole number from the seed and the id alone: the floor of 1000 times a Gumbel number."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with place, from 1 in this order: ranges of the order, sorted each, and the sizes of those before (a row a range)."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("place", F.monotonically_increasing_id()), "places")  # the range, and 33 bits for the row in it
    sizes = dealt.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
    before, starts = 0, {}
    for r, n in sizes:
        starts[r] = before
        before += n
    if not starts:
        return dealt
    base = F.get(F.expr("array(" + ",".join(f"{starts.get(r, 0)}L" for r in range(max(starts) + 1)) + ")"), F.shiftright("place", 33).cast("int"))
    return dealt.withColumn("place", base + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def resample(docs: DataFrame, target: DataFrame, percent: float = PERCENT, fewest: int = FEWEST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of each document."""
    gains = bucket_gains(docs, target, buckets)
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_weighed(gains)), "doc_id long, n_words long, n_features long, weight long")
    rows = written(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    able = rows.where(F.col("n_words") >= fewest)
    n, about = able.agg(F.count("*"), F.percentile_approx("score", max(0.0, 1 - 1.2 * percent / 100))).first()
    drawn = int(percent * n // 100)
    # only scores that can be among the drawn are sorted; the quantile is a guess, which is checked
    if about is None or able.where(F.col("score") >= about).count() < drawn:
        about = -(1 << 63)
    high = (F.col("n_words") >= fewest) & (F.col("score") >= F.lit(about))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(rows.where(high), order).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return ranked.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
