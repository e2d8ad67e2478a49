"""Substring dedup: words covered by a run of words that occurs earlier go.

``repeats`` brings runs of words that may be equal into shards of whole groups. Each shard is one compressed FM-index; its
pieces of documents are streamed against it by backward search over a wavelet matrix, which gives the matching statistics: how many words
before each place occur elsewhere in the shard. Where they reach ``window`` words, the rows of the index, located by its kept
entries of the suffix array, hold all occurrences, and the interval is reported if one of them is earlier.

Words are runs of anything but space and U+0009 to U+000D, unchanged. A null text has none, a text shorter than the window keeps all,
and very long texts are read whole. Rows that repeat id and text are one document; null ids come first, told apart by their text. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.common import ranges, runs_hash, slices, spans_hash, table, utf8
from lectern.llm.fm_index import FmIndex
from lectern.llm.repeats import Search, covered, with_spans

WINDOW = 20
K = 6
#: Bytes hashed at once.
STRETCH = 1 << 20


def word_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable]:
    """A 64-bit hash of each word, where each text's words start, and a function that cuts runs of words out of the bytes."""
    raw, bounds = utf8(column)
    hashes, counts, begin, stop = [], [], [], []
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STRETCH, side="right")) - 1)
        some = raw[bounds[first] : bounds[last]]
        ends = bounds[first : last + 1] - bounds[first]
        start, end = split(some, ends)
        hashes.append(runs_hash(some, start, end))
        counts.append(np.diff(np.searchsorted(start, ends)))
        begin.append(start + bounds[first])
        stop.append(end + bounds[first])
        first = last
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), lambda a, b: []
    begin, stop, blob = np.concatenate(begin), np.concatenate(stop), raw.tobytes()
    cut = lambda a, b: [blob[p:q] for p, q in zip(begin[a].tolist(), stop[b - 1].tolist(), strict=True)]
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts)))), cut


def split(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word crosses the bounds."""
    start, end = common.words(raw)
    inner = np.unique(bounds[1:-1])
    cross = inner[(np.searchsorted(start, inner, side="left") > np.searchsorted(end, inner, side="right"))]
    return (np.sort(np.concatenate((start, cross))), np.sort(np.concatenate((end, cross)))) if len(cross) else (start, end)


def solve(symbols: np.ndarray, bounds: np.ndarray, places: np.ndarray, window: int, mode: str, whole: bool = False) -> np.ndarray:
    """Flags of the symbols at which a repeated window starts, or (whole) a piece that repeats as a whole."""
    flags = np.zeros(len(symbols), dtype=bool)
    lengths = np.diff(bounds)
    starts = bounds[:-1] if whole else ranges(bounds[:-1], np.maximum(lengths - window + 1, 0))
    if len(starts) < 2:
        return flags
    reach = lengths if whole else np.full(len(starts), window)
    # equal patterns are searched once
    _, first, same = np.unique(spans_hash(symbols)(starts, starts + reach), return_index=True, return_inverse=True)
    names, coded = np.unique(symbols, return_inverse=True)
    # pieces end to end, an own symbol after each
    n = len(lengths)
    at = np.arange(len(symbols)) + np.repeat(np.arange(n), lengths)
    sequence = np.empty(len(symbols) + n, dtype=np.int64)
    sequence[at] = coded + n
    sequence[bounds[1:] + np.arange(n)] = np.arange(n)
    index = FmIndex(sequence)
    place = np.full(len(sequence), np.iinfo(np.int64).max)
    place[at] = places
    _, low, high = index.matching(sequence, at[starts[first]] + reach[first], reach[first])
    low, high = low[same], high[same]
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return flags
    both, which = np.unique(low[hit] << 32 | high[hit], return_inverse=True)
    rows, stop = both >> 32, both & 0xFFFFFFFF
    # the places of all occurrences of these windows
    many = stop - rows
    found_at = place[index.locate(ranges(rows, many))]
    cuts = np.cumsum(many) - many
    own = places[starts[hit]]
    found = own > np.minimum.reduceat(found_at, cuts)[which]
    if mode == "all":
        found |= own < np.maximum.reduceat(found_at, cuts)[which]
    flags[starts[hit[found]]] = True
    return flags


def search(mode: str = "later", window: int = WINDOW, k: int = K) -> Search:
    return Search(window, k, mode, word_symbols, lambda column: word_symbols(column)[:2], solve)


def dedup(docs: DataFrame, mode: str = "later", window: int = WINDOW) -> DataFrame:
    """doc_id, text and spans (in words) of each document."""
    return with_spans(docs.select("doc_id", "text"), search(mode, window)).select("doc_id", "text", F.col("__spans").alias("spans"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for batch in slices(batches):
        raw, bounds = utf8(batch.column("text"))
        start, end = split(raw, bounds)
        first = np.searchsorted(start, bounds)
        blob = raw.tobytes()
        removed, digests = [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            a, b = int(first[i]), int(first[i + 1])
            gone = covered(spans, b - a)
            keep = np.ones(b - a, dtype=bool)
            for p, q in gone:
                keep[p:q] = False
            removed.append(b - a - int(keep.sum()))
            digests.append(hashlib.sha256(b" ".join([blob[p:q] for p, q in zip(start[a:b][keep].tolist(), end[a:b][keep].tolist(), strict=True)])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
