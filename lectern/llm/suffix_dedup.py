"""Suffix-array dedup: bytes covered by a long repeated string go.

``repeats`` brings strings that may be equal into shards of whole groups. In a shard, the suffixes that share their first ``window`` bytes with
another (rolling hashes tell) make up a suffix array with the common prefixes of neighbours. The nearest smaller places before and after a suffix
in this order give its longest previous factor: the longest match with an earlier place. A byte is
a later copy if it is covered by the window of a place whose longest previous factor reaches the window; the first copy stays (mode
`later`). Mode `all` also asks for longest next factors (of places in reverse) and removes every copy.

Texts are UTF-8 bytes, null is empty, matches never cross documents, and overlaps count. A text shorter than the window keeps
everything, and very long texts are read whole. Rows that repeat id and text are one document in `later` and copies in `all`; null ids are told apart by their text. Other columns are kept; an empty table
gives no rows. In the pipeline, bytes of a character that is cut in two are left out of the kept text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import byte_symbols, free_prefix, ranges, slices, spans_hash, table, utf8
from lectern.llm.repeats import Search, covered, with_spans

WINDOW = 200
K = 64


def suffix_array(symbols: np.ndarray, bounds: np.ndarray, places: np.ndarray, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of the pieces that share their first ``window`` symbols with another, in suffix order (equals by place), and
    how many symbols each shares with the one before it. Of the suffixes of one place in several pieces the longest stands for all.
    Without a window the array is sparse: of the suffixes at which pieces start, those that share the whole piece with another.

    A suffix whose window no other has can't reach the threshold; rolling hashes leave these out before anything is sorted."""
    starts = bounds[:-1] if window is None else ranges(bounds[:-1], np.maximum(np.diff(bounds) - window + 1, 0))
    if not len(starts):
        return starts, starts
    of = spans_hash(byte_symbols(symbols))
    code = of(starts, bounds[1:] if window is None else starts + window)
    by = np.argsort(code)
    code = code[by]
    fresh = np.concatenate(([True], code[1:] != code[:-1]))
    starts = np.sort(starts[by[~(fresh & np.concatenate((fresh[1:], [True])))]])
    ends = bounds[np.searchsorted(bounds, starts, side="right")]
    by = np.lexsort((starts - ends, places[starts]))
    if not len(by):
        return by, by
    by = by[np.concatenate(([True], np.diff(places[starts[by]]) != 0))]
    starts, ends = starts[by], ends[by]
    # equal suffixes are one text to sort
    _, first, which = np.unique(of(starts, ends), return_index=True, return_inverse=True)
    text = symbols.tobytes().decode("latin-1")
    texts = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    ordered = np.array(sorted(range(len(texts)), key=texts.__getitem__))
    rank = np.empty(len(texts), dtype=np.int64)
    rank[ordered] = np.arange(len(texts))
    rank = rank[which]
    by = np.lexsort((places[starts], rank))
    first = first[ordered]
    common = np.concatenate(([0], common_prefix(of, starts[first], ends[first])))
    rank = rank[by]
    lcp = np.where(np.concatenate(([True], rank[1:] != rank[:-1])), common[rank], (ends - starts)[by])
    return starts[by], lcp


def common_prefix(of: Callable, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many symbols each span shares with the next one, by bisection."""
    a, b = starts[:-1], starts[1:]
    low = np.zeros(len(a), dtype=np.int64)
    high = np.minimum((ends - starts)[:-1], (ends - starts)[1:])
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = of(a, a + middle) == of(b, b + middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return low


def longest_previous(places: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, of suffixes in suffix order (distinct places): how much it shares with any suffix of a
    smaller place. The nearest smaller places before and after it in suffix order share most; one stack finds both."""
    out = [0] * len(places)
    held: list[tuple[int, int, int]] = []  # place, index, and what it shares with the one below
    for i, (place, shared) in enumerate(zip([*places.tolist(), -1], [*lcp.tolist(), 0], strict=True)):
        while held and held[-1][0] > place:
            _, j, below = held.pop()
            out[j] = max(below, shared)
            shared = min(below, shared)
        held.append((place, i, shared))
    return np.array(out, dtype=np.int64)


def solve(symbols: np.ndarray, bounds: np.ndarray, places: np.ndarray, window: int, mode: str, whole: bool = False) -> np.ndarray:
    """Flags of the symbols at which a repeated window starts, or (whole) a piece that repeats as a whole. A longest factor falls by one a
    place at most, so one at a piece's start that spans the piece spares those inside it."""
    flags = np.zeros(len(symbols), dtype=bool)
    order, lcp = suffix_array(symbols, bounds, places, None if whole else window)
    if not len(order):
        return flags
    at = places[order]
    least = bounds[np.searchsorted(bounds, order, side="right")] - order if whole else window
    flags[order[longest_previous(at, lcp) >= least]] = True
    if mode == "all":  # longest next factors
        flags[order[longest_previous(at.max() - at, lcp) >= least]] = True
    return flags


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable]:
    raw, bounds = utf8(column)
    blob = raw.tobytes()
    return byte_symbols(raw), bounds, lambda start, stop: [blob[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]


def search(mode: str, window: int = WINDOW, k: int = K) -> Search:
    return Search(window, k, mode, _bytes, utf8, solve)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), search("all"))
    return rows.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for doc_id, text, spans in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "__spans")], strict=True):
            raw = (text or "").encode()
            gone = covered(spans, len(raw))
            kept = hashlib.sha256()
            at = 0
            for begin, end in gone:
                kept.update(raw[at:begin])
                at = end
            kept.update(raw[at:])
            out.append((doc_id, len(raw), sum(e - b for b, e in gone), len(gone), kept.hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)


def dedup(docs: DataFrame, mode: str = "later", window: int = WINDOW) -> DataFrame:
    """docs with repeated bytes cut out of text (characters cut in two are dropped)."""
    columns = docs.columns
    name = free_prefix(columns) + "spans"
    rows = with_spans(docs, search(mode, window), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
                if text and spans:
                    raw = text.encode()
                    parts, at = [], 0
                    for begin, end in covered(spans, len(raw)):
                        parts.append(raw[at:begin])
                        at = end
                    text = b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return rows.mapInArrow(run, docs.schema)
