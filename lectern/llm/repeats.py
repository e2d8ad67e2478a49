"""Finding the repeated windows of a corpus in shards that hold equal contents together.

A document is a sequence of symbols, and a window is ``window`` of them in a row. What is asked is which windows occur elsewhere
(``all``) or earlier (``later``, by document and place). The corpus is never sorted as a whole:

1. Anchors. Of the runs of k symbols in a window, the one with the least hash is the window's anchor; equal windows have
   equal anchors at equal places, and neighbouring windows mostly share theirs. An anchor's piece is all the windows that
   it is the anchor of. For each anchor its hash, the hash of its piece and its place are dealt out by the anchor's hash, packed as arrays. The first
   two of a batch's equal pieces go on, so that what a hot passage adds to one task is two records a batch.
2. Kinds. Of an anchor's equal pieces the first two are asked for as a pair, and if an anchor has unequal pieces, the first of each kind. From the third
   of a kind on, pieces are pre-aggregated into the second one and fare as it does.
3. Solving. The asked pieces are cut out of the texts, pairs are dealt by the hash of the piece, others by an extended anchor (to the left, or to the right: each
   window goes with one of the two), which separates passages that merely share a short phrase. Groups of one piece are dropped. The
   rest come by whole groups into shards, and a solver (a suffix array, an FM-index) tells which pieces of pairs repeat as a whole, and which windows of the others repeat.
   An anchor with more than ``HOT`` kinds of pieces would make a group without bound. Its windows are dealt out by the hash of each, equal ones of
   a batch settled first as in step 1, so that no task gets more than its share.
4. The spans found are gathered by document.

Everything is exact but for 64-bit hashes standing for texts of one id, for the pieces from the third of a kind on and for the windows of hot anchors. Rows with
equal id and text count as one document in `later`, and as copies of one another in `all`.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded, lean, mix, partitions_for, ranges, slices, spans_hash, written

#: Symbols scanned at once, and bytes of pieces held by a solver at once (more if one group is larger).
SCAN = 1 << 20
SHARD = 1 << 20
#: Bits of a hash that give way to a place while anchors are chosen; longer texts are scanned in stretches.
PLACE_BITS = 24
#: Pieces of an anchor beyond which it is hot: its windows are counted one by one.
HOT = 1024
#: Rows whose texts are unpacked at once.
ROWS = 1000
#: Rows whose equal pieces are settled together.
SETTLED_ROWS = 4000
#: A record: a piece begins at a place of a text, has its anchor some symbols further on, and a size.
FIELDS = (("anchor", "<u4"), ("piece", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i4"), ("off", "<u2"), ("size", "<u2"))
#: A text column to (a 64-bit hash of each symbol, bounds of the texts in symbols, a function that cuts pieces [start, stop) out as bytes).
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], list[bytes]]]]
#: A column of pieces to (their symbols as the solver gets them, bounds).
Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: (symbols of all pieces, bounds, rank of each symbol's place, window, mode, whole) to a flag for each symbol: a repeated window, or
#: (whole) a piece that repeats as a whole, starts here.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, int, str, bool], np.ndarray]


@dataclass(frozen=True)
class Search:
    window: int
    k: int
    mode: str  # all | later
    symbols: Symbols
    reader: Reader
    solver: Solver
    hot: int = HOT

    @property
    def half(self) -> int:
        return (self.window - self.k + 1) // 2


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), text_key().alias("key"), "text")


def least_places(code: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes the place of the least (of equals the first), in stretches that overlap by span - 1."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    step = max(1, (1 << PLACE_BITS) - span + 1)
    out = []
    for first in range(0, len(code) - span + 1, step):
        part = code[first : first + step + span - 1]
        least = part & ~mask | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: width - span], least[span - width :])
        out.append((least & mask).astype(np.int64) + first)
    return np.concatenate(out)


def piece_hash(of: Callable, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Hashes of whole pieces. A sum over places can't tell some runs of 1024 symbols and more apart; where windows are long, parts of 32 symbols are mixed one into the next."""
    if window <= LONG_WINDOW:
        return of(begin, end)
    out = mix((end - begin).astype(np.uint64))
    live = np.arange(len(begin))
    at = begin
    while len(live):
        stop = np.minimum(at + 32, end[live])
        out[live] = mix((out[live] ^ of(at, stop)) * np.uint64(0xD1342543DE82EF95))
        go = stop < end[live]
        live, at = live[go], stop[go]
    return out


def anchors(symbols: np.ndarray, bounds: np.ndarray, search: Search) -> tuple[np.ndarray, ...]:
    """Place, document (index), start and end of the piece, hash, and hash of the piece, of each anchor. A window belongs to one piece."""
    window, k = search.window, search.k
    n = len(symbols)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    of = spans_hash(symbols)
    starts = np.arange(n - k + 1)
    code = of(starts, starts + k)
    least = least_places(code, window - k + 1)
    whole = np.ones(n + 1, dtype=bool)
    low = np.maximum(bounds[1:] - window + 1, bounds[:-1])
    whole[ranges(low, bounds[1:] - low)] = False
    start = np.flatnonzero(whole[: len(least)])
    at = least[start]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else start
    at, begin = at[new], start[new]
    end = start[np.append(new[1:], len(start)) - 1] + window if len(at) else begin
    doc = np.searchsorted(bounds, at, side="right") - 1
    piece = mix(piece_hash(of, begin, end, window) + (at - begin).astype(np.uint64))
    return at, doc, begin, end, code[at], piece


def scans(symbols: np.ndarray, bounds: np.ndarray, size: int = SCAN) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of whole documents of about so many symbols: index of the first, symbols, bounds."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1)
        yield first, symbols[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def merged(doc: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans with those of a document that touch made one."""
    if not len(doc):
        return doc, text, begin, end
    order = np.lexsort((begin, text, doc))
    doc, text, begin, end = doc[order], text[order], begin[order], end[order]
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])))
    group = np.cumsum(fresh)
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = fresh | np.concatenate(([True], begin[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], text[at], begin[at], np.maximum.reduceat(end, at)


#: Windows of more symbols than this are long.
LONG_WINDOW = 256
#: What is said of a piece: its span repeats, or what is asked for (bits), with the place of the anchor in the bits above.
SPAN, ASK, HOT_ASK, PAIR, OFF = 0, 1, 2, 4, 3
SPANS = "doc long, key long, begin int, `end` int, kind int"
SETTLED = ("<i8", "<i8", "<i4", "<i4")


def spans_batch(doc: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray | int = SPAN) -> pa.RecordBatch:
    arrays = [pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(np.broadcast_to(np.asarray(kind, dtype=np.int32), len(doc)))]
    return pa.RecordBatch.from_arrays(arrays, ["doc", "key", "begin", "end", "kind"])


def kinds(r: dict[str, np.ndarray], code: np.ndarray, mode: str) -> tuple[np.ndarray, ...]:
    """Of records in order of (code, piece, doc, text, at): which remain, one of those with the same place; which of these start
    a kind (equal code and piece), and which are the second of one; and the places that repeated rows make copies (mode `all`)."""
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (r["piece"][1:] != r["piece"][:-1])))
    same = ~new & np.concatenate(([False], (r["doc"][1:] == r["doc"][:-1]) & (r["text"][1:] == r["text"][:-1]) & (r["at"][1:] == r["at"][:-1])))
    left = np.flatnonzero(~same)
    first = new[left]
    second = ~first & np.concatenate(([False], first[:-1]))
    return left, first, second, np.flatnonzero(same) if mode == "all" else np.zeros(0, np.int64)


def pack(parts: list[tuple[np.ndarray, ...]], search: Search, buckets: int) -> tuple[list[int], list[bytes], bytes]:
    """Records of a batch: the first two of equal pieces packed for their bucket, the spans of the others."""
    r = dict(zip(("doc", "text", "at", "off", "size", "code", "piece"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))
    order = np.lexsort((r["at"], r["text"], r["doc"], r["piece"], r["code"]))
    r = {n: x[order] for n, x in r.items()}
    left, first, second, copies = kinds(r, r["code"], search.mode)
    rest = np.concatenate((left[~first & ~second], copies))
    spans = merged(r["doc"][rest], r["text"][rest], r["at"][rest], r["at"][rest] + r["size"][rest])
    # to the buckets, each one's records in order of document
    kept = left[first | second]
    bucket = (r["code"][kept] >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((r["at"][kept], r["doc"][kept], bucket))
    kept, bucket = kept[order], bucket[order]
    record = {"anchor": r["code"][kept] & np.uint64(0xFFFFFFFF), **{n: r[n][kept] for n in ("piece", "doc", "text", "at", "off", "size")}}
    record = {n: record[n].astype(t) for n, t in FIELDS}
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    there = np.flatnonzero(np.diff(cuts)).tolist()
    packed = [b"".join(record[n][cuts[b] : cuts[b + 1]].tobytes() for n, _ in FIELDS) for b in there]
    settled = b"".join([len(spans[0]).to_bytes(4, "little"), *(x.astype(t).tobytes() for x, t in zip(spans, SETTLED, strict=True))])
    return there, packed, settled


def unpack(records: list[tuple[int, bytes]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(bucket, packed records) to each record's bucket and its fields."""
    size = sum(np.dtype(t).itemsize for _, t in FIELDS)
    held: dict[str, list[np.ndarray]] = {n: [] for n, _ in FIELDS}
    for _, raw in records:
        n, at = len(raw) // size, 0
        for name, t in FIELDS:
            held[name].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    bucket = np.repeat([b for b, _ in records], [len(raw) // size for _, raw in records])
    return bucket, {n: np.concatenate(x) for n, x in held.items()}


def unsettled(raw: bytes) -> pa.RecordBatch | None:
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for t in SETTLED:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return spans_batch(*out) if n else None


def _scan(search: Search, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, rows, parts = 0, 0, []
        for batch in itertools.chain(slices(batches, ROWS), [None]):
            if batch is not None:
                docs, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
                symbols, bounds, _ = search.symbols(batch.column("text"))
                for first, some, ends in scans(symbols, bounds):
                    at, doc, begin, end, code, piece = anchors(some, ends, search)
                    parts.append((docs[doc + first], keys[doc + first], begin - ends[doc], at - begin, end - begin, code, piece))
                rows += len(docs)
            if batch is not None and rows < SETTLED_ROWS or not sum(len(p[0]) for p in parts):
                continue
            there, packed, settled = pack(parts, search, buckets)
            turn, rows, parts = (turn + 7) % buckets, 0, []
            yield pa.RecordBatch.from_arrays([pa.array([*there, turn], pa.int32()), pa.array([*packed, None], pa.binary()), pa.array([None] * len(there) + [settled], pa.binary())], ["bucket", "records", "spans"])

    return run


def matched(search: Search, records: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Spans of equal pieces, and what has to be asked, from all records of some buckets."""
    if not records:
        return
    bucket, r = unpack(records)
    # only anchors that come twice matter
    code = r["anchor"].astype(np.uint64) | bucket.astype(np.uint64) << np.uint64(32)
    order = np.argsort(code, kind="stable")
    code = code[order]
    twice = np.zeros(len(code), dtype=bool)
    twice[1:] = code[1:] == code[:-1]
    twice[:-1] |= twice[1:]
    order, code = order[twice], code[twice]
    if not len(code):
        return
    r = {n: x[order] for n, x in r.items()}
    order = np.lexsort((r["at"], r["text"], r["doc"], r["piece"], code))
    code = code[order]
    r = {n: x[order] for n, x in r.items()}
    left, first, second, copies = kinds(r, code, search.mode)
    code = code[left]
    new_anchor = np.concatenate(([True], code[1:] != code[:-1]))
    pieces = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
    paired = second | np.concatenate((second[1:], [False]))
    if search.k == search.window:  # a piece is a window: counting settles it
        spans, bits = ~first | paired if search.mode == "all" else ~first, np.zeros(len(code), dtype=np.int64)
    else:
        spans, bits = ~first & ~second, np.where(paired & (first | second), PAIR, 0) | np.where(first & (pieces > 1), np.where(pieces > search.hot, HOT_ASK, ASK), 0)
    said = np.concatenate((left[spans], copies, left[bits > 0]))
    bits = np.concatenate((np.full(len(said) - np.count_nonzero(bits), SPAN), bits[bits > 0]))
    for at in range(0, len(said), 50_000):
        y, kind = said[at : at + 50_000], bits[at : at + 50_000]
        begin = r["at"][y].astype(np.int64)
        yield spans_batch(r["doc"][y], r["text"][y], begin, begin + r["size"][y], np.where(kind == SPAN, SPAN, kind | r["off"][y].astype(np.int64) << OFF))


def _match(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        for batch in batches:
            for bucket, records, spans in zip(*[batch.column(c).to_pylist() for c in ("bucket", "records", "spans")], strict=True):
                if spans and (out := unsettled(spans)) is not None:
                    yield out
                if records:
                    held.append((bucket, records))
        yield from matched(search, held)

    return run


def _cut(search: Search, buckets: int):
    """Texts with what is asked of them, to pieces with the code to deal them by; pieces of hot anchors window by window, packed."""
    single = replace(search, k=search.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            docs, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            symbols, bounds, cut = search.symbols(batch.column("text"))
            lists = batch.column("asks")
            upto = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))  # of the slice
            asks = lists.flatten()
            fields = [asks.field(i).to_numpy().astype(np.int64) for i in range(3)]
            hot = []
            for first, some, ends in scans(symbols, bounds):
                n = len(ends) - 1
                doc = np.repeat(np.arange(n), np.diff(upto[first : first + n + 1]))
                begin, end, kind = (x[upto[first] : upto[first + n]] for x in fields)
                if not len(doc):
                    continue
                begin, end = begin + ends[doc], end + ends[doc]
                at = begin + (kind >> OFF)
                of = spans_hash(some)
                x = np.flatnonzero(kind & HOT_ASK)
                start = np.unique(ranges(begin[x], end[x] - begin[x] - search.window + 1))
                owner = np.searchsorted(ends, start, side="right") - 1
                code = piece_hash(of, start, start + search.window, search.window)
                hot.append((docs[first + owner], keys[first + owner], start - ends[owner], np.zeros(len(start), np.int64), np.full(len(start), search.window), code, code))
                left = at - search.half  # windows from here or before hold the anchor extended to the left, others the one to the right
                one, two, three = (np.flatnonzero(c) for c in ((kind & PAIR) > 0, ((kind & ASK) > 0) & (begin <= left), ((kind & ASK) > 0) & (end - search.window > left)))
                sides = (
                    (0, one, begin[one], end[one], begin[one], end[one]),
                    (1, two, begin[two], np.minimum(left[two] + search.window, end[two]), left[two], at[two] + search.k),
                    (2, three, np.maximum(begin, left + 1)[three], end[three], at[three], at[three] + search.k + search.half),
                )
                for side, x, start, stop, a, b in sides:
                    code = mix(of(a, b) + np.uint64(side)).view(np.int64)
                    for s in range(0, len(x), 20_000):
                        y = slice(s, s + 20_000)
                        raw = cut(start[y] + bounds[first], stop[y] + bounds[first])
                        yield pieces_batch(code[y], docs[first + doc[x[y]]], keys[first + doc[x[y]]], start[y] - ends[doc[x[y]]], raw, side == 0)
            if sum(len(p[0]) for p in hot):
                there, packed, settled = pack(hot, single, buckets)
                none = np.zeros(len(there) + 1, dtype=np.int64)
                yield pieces_batch(np.array([*there, int(docs[0]) % buckets]), none, none, none, [None] * len(none), False, [*packed, None], [None] * len(there) + [settled])

    return run


PIECES = "code long, doc long, key long, begin int, piece binary, whole boolean, records binary, spans binary"


def pieces_batch(code: np.ndarray, doc: np.ndarray, key: np.ndarray, begin: np.ndarray, piece: list, whole: bool, records: list | None = None, spans: list | None = None) -> pa.RecordBatch:
    n = len(code)
    columns = [pa.array(code, pa.int64()), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(begin.astype(np.int32)), pa.array(piece, pa.binary()), pa.array(np.full(n, whole))]
    columns += [pa.array(x, pa.binary()) if x else pa.nulls(n, pa.binary()) for x in (records, spans)]
    return pa.RecordBatch.from_arrays(columns, ["code", "doc", "key", "begin", "piece", "whole", "records", "spans"])


def _solve(search: Search):
    single = replace(search, k=search.window)

    def solved(parts: list[pa.RecordBatch], whole: bool) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        rows = rows.filter(rows.column("whole") if whole else pc.invert(rows.column("whole"))).combine_chunks()
        if not rows.num_rows:
            return None
        doc, key, begin = (rows.column(c).to_numpy() for c in ("doc", "key", "begin"))
        # a piece that came by both sides counts once in a shard; of pieces with the same start, the longest holds the others
        order = np.lexsort((-pc.binary_length(rows.column("piece")).to_numpy(), begin, key, doc))
        doc, key, begin = doc[order], key[order], begin[order].astype(np.int64)
        fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
        keep = fresh | np.concatenate(([True], begin[1:] != begin[:-1]))
        symbols, bounds = search.reader(rows.column("piece").take(pa.array(order[keep])).combine_chunks())
        # places in order of document and place, equal for the same place in overlapping pieces
        base = (np.cumsum(fresh) * (int(begin.max()) + 2 * search.window))[keep]
        doc, key, begin = doc[keep], key[keep], begin[keep]
        lengths = np.diff(bounds)
        place = ranges(begin, lengths)
        x = np.flatnonzero(search.solver(symbols, bounds, place + np.repeat(base, lengths), search.window, search.mode, whole))
        if not len(x):
            return None
        piece = np.searchsorted(bounds, x, side="right") - 1
        return spans_batch(*merged(doc[piece], key[piece], place[x], place[x] + (lengths[piece] if whole else search.window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []  # whole groups of two pieces or more
        held = 0
        tail: list[pa.RecordBatch] = []  # the last group so far
        hot: list[tuple[int, bytes]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            for whole in (True, False):
                if parts and (out := solved(parts, whole)) is not None:
                    yield out

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                windows = batch.filter(pc.is_null(batch.column("piece")))
                for bucket, records, spans in zip(*[windows.column(c).to_pylist() for c in ("code", "records", "spans")], strict=True):
                    if spans and (out := unsettled(spans)) is not None:
                        yield out
                    if records:
                        hot.append((bucket, records))
                tail.append(batch.filter(pc.is_valid(batch.column("piece"))).drop_columns(["records", "spans"]))
            rows = pa.Table.from_batches(tail).combine_chunks().to_batches() if tail else []
            if not rows:
                continue
            now = rows[0]
            code = now.column("code").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]))
            upto = int(cuts[-2]) if batch is not None else len(code)  # the last group may go on
            sizes = np.repeat(np.diff(cuts), np.diff(cuts))[:upto]
            done = now.slice(0, upto).filter(pa.array(sizes > 1))
            tail = [now.slice(upto)]
            if done.num_rows:
                parts.append(done)
                held += done.column("piece").nbytes
            if held >= SHARD:
                yield from flushed()
                parts, held = [], 0
        yield from flushed()
        yield from matched(single, hot)

    return run


def find_repeats(docs: DataFrame, search: Search) -> DataFrame:
    """(doc, key, spans): of each document that has any, spans [begin, end) in symbols, unordered."""
    n = partitions_for(docs)
    texts = keyed(bounded(docs))
    found = texts.mapInArrow(lean(_scan(search, n)), "bucket int, records binary, spans binary").repartitionById(n, F.col("bucket")).mapInArrow(lean(_match(search)), SPANS)
    found = written(found, "repeats")
    asks = found.where(F.col("kind") != SPAN).groupBy("doc", "key").agg(F.collect_list(F.struct("begin", "end", "kind")).alias("asks"))
    pieces = texts.join(asks, ["doc", "key"]).select("doc", "key", "text", "asks").mapInArrow(lean(_cut(search, n)), PIECES)
    solved = pieces.repartition(n, "code").sortWithinPartitions("code").mapInArrow(lean(_solve(search)), SPANS)
    every = found.where(F.col("kind") == SPAN).unionByName(solved).select("doc", "key", F.struct("begin", "end").alias("span"))
    return every.groupBy("doc", "key").agg(F.collect_list("span").alias("spans"))


def with_spans(docs: DataFrame, search: Search, name: str = "__spans") -> DataFrame:
    """docs with a further column of the spans (null where there are none)."""
    spans = find_repeats(docs.select("doc_id", "text"), search)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), text_key().alias("key"))
    rows = rows.join(spans, ["doc", "key"], "left")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("spans").alias(name))


def covered(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The spans in order, within the length, with those that touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], min(s["end"], length)) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        elif begin < end:
            out.append((begin, end))
    return out
