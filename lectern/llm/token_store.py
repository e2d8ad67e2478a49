"""Token-ID output: documents as Parquet list columns of token ids, in ascending id order.

``write_tokens`` deals the documents into shards by ranges of their id, sorts each shard, encodes it and writes one
file a shard with Spark's Parquet writer. The ids are a dictionary-encoded list column, doc_id, n_tokens and start are
delta-encoded (format version 2), and row groups and pages have set sizes. Column indexes let a reader fetch
the metadata without the tokens, or a few documents' tokens without the rest. A small manifest holds the number of
tokens before each shard. ``read_tokens`` reads them back.

Nulls: a null text is empty, so it has the end id alone; null ids come first. Ids may be any 64-bit integers, however uneven. Rows
with equal ids are ordered by a hash of their text and then by text, and each keeps its own row; an id (or null) that very many rows share
is spread over shards in that order. Very long texts are encoded whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, lean, new_path, partitions, range_bucket, ranges, runs_hash, slices, table, utf8

#: Rows of a file are (shard, doc_id, n_tokens, shard_start, tokens).
SCHEMA = "shard int, doc_id long, n_tokens long, shard_start long, tokens array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
#: A worker remembers pieces in so many slots (2 to this power, 13 bytes each) and their ids; when half are taken the memory is emptied before the next batch.
SLOT_BITS = 22

_ENCODERS: dict[str, PieceEncoder] = {}

_BYTE = np.arange(256)
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_SIGN = (_BYTE < 128) & ~_LETTER & (_BYTE != 32) & (_BYTE != 10)


class Memory:
    """Pieces by 64-bit hash, checked by a second one, to their token ids: open addressing, all lookups of a batch at once.

    At most half of the slots are taken: their number doubles as pieces come in, and falls back when the memory is emptied."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.bits = SLOT_BITS
        self.slots = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.count, self.used = 0, 0
        self.checks = np.zeros(1 << 16, np.uint64)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)

    def full(self) -> bool:
        return self.count > 1 << (SLOT_BITS - 1)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Index of each piece, -1 if it isn't here."""
        keys = np.maximum(keys, np.uint64(1))
        out = np.full(len(keys), -1, dtype=np.int64)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        live = np.arange(len(keys))
        while len(live):
            there = self.slots[at]
            hit = there == keys[live]
            out[live[hit]] = self.entry[at[hit]]
            go = ~hit & (there != 0)
            live, at = live[go], at[go] + 1 & (1 << self.bits) - 1
        seen = np.flatnonzero(out >= 0)
        out[seen[self.checks[out[seen]] != checks[seen]]] = -1
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Pieces of distinct keys that aren't here."""
        n = self.count + len(keys)
        while n > len(self.checks):
            self.checks, self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.checks, self.starts, self.sizes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.checks[self.count : n], self.sizes[self.count : n] = checks, sizes
        self.starts[self.count : n] = np.cumsum(sizes) - sizes + self.used
        self.ids[self.used : self.used + len(ids)] = ids
        if 2 * n > len(self.slots):
            taken = np.flatnonzero(self.slots)
            before, entries = self.slots[taken], self.entry[taken]
            while 2 * n > 1 << self.bits:
                self.bits += 1
            self.slots, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self.settle(before, entries)
        self.settle(np.maximum(keys, np.uint64(1)), np.arange(self.count, n, dtype=np.int32))
        self.count, self.used = n, self.used + len(ids)

    def settle(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Gives each of these keys the first free slot from its own on."""
        live = np.arange(len(keys))
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(live):
            free = np.flatnonzero(self.slots[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            now = free[first]
            self.slots[at[now]], self.entry[at[now]] = keys[live[now]], entries[live[now]]
            stay = np.ones(len(live), dtype=bool)
            stay[now] = False
            live, at = live[stay], at[stay] + 1 & (1 << self.bits) - 1


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A byte-level pre-tokenizer looks at nothing before a piece, and always ends one before a space or line feed that stands
    between characters that aren't white space, and between an ASCII letter and an ASCII character that is none. Texts are cut there; a space goes
    with what follows, a line feed too, whose token comes first. Unseen pieces with a space go to the library
    many at a time, as one text, and come apart where a token starts with a space. Texts with other white space, or with
    what might be a special token, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, k in vocab.items():
            self.opens[k] = token.startswith("\u0120")  # a space, in a byte-level vocabulary
        self.feed = vocab.get("\u010a")  # a line feed
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Memory()

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (none empty, no white space) with a space before each: how many of each, and all."""
        sizes, every = [], []
        for at in range(0, len(words), 2000):
            ids = np.array(self.tokenizer.encode(" " + " ".join(words[at : at + 2000]), add_special_tokens=False).ids, dtype=np.int32)
            every.append(ids)
            sizes.append(np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        return np.concatenate(sizes), np.concatenate(every)

    def odd(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole."""
        gap = (raw == 32) | (raw == 10)
        bad = ((raw >= 9) & (raw <= 13)) & (raw != 10)
        bad[1:] |= gap[1:] & gap[:-1]
        first, last = bounds[:-1][bounds[1:] > bounds[:-1]], bounds[1:][bounds[1:] > bounds[:-1]] - 1
        bad[first] |= gap[first]
        bad[last] |= gap[last]
        high = np.flatnonzero(raw >= 0xC2)
        high = high[high + 1 < len(raw)]
        one, two = raw[high], raw[high + 1]
        three = raw[np.minimum(high + 2, len(raw) - 1)]
        space = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE2) & (two == 0x81) & (three == 0x9F) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
        space |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
        bad[high[space]] = True
        for text in self.special:
            head = np.flatnonzero(raw == text[0])
            if len(head) and len(text) > 1:
                head = head[(head + 1 < len(raw))]
                head = head[raw[head + 1] == text[1]]
            bad[head] = True
        return np.add.reduceat(np.append(bad, False).astype(np.int64), bounds[:-1])[: len(bounds) - 1] * (bounds[1:] > bounds[:-1]) > 0

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts end to end to how many ids each has, and all ids."""
        n = len(bounds) - 1
        odd = self.odd(raw, bounds) if len(raw) else np.zeros(n, dtype=bool)
        odd |= self.feed is None
        whole = np.flatnonzero(odd)
        blob = raw.tobytes()
        direct = dict(zip(whole.tolist(), self.direct([blob[bounds[i] : bounds[i + 1]].decode() for i in whole.tolist()]), strict=True))
        # pieces: from each text's start, each space, line feed, and each sign after a letter
        gap = (raw == 32) | (raw == 10)
        cut = gap.copy()
        cut[1:] |= _SIGN[raw[1:]] & _LETTER[raw[:-1]]
        cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        at = np.flatnonzero(cut)
        doc = np.searchsorted(bounds, at, side="right") - 1
        ends = np.append(at[1:], len(raw))
        keep = ~odd[doc]
        at, doc, ends = at[keep], doc[keep], ends[keep]
        keys, checks = runs_hash(raw, at, ends), runs_hash(raw, at, ends, seed=1)
        if self.memory.full():
            self.memory.clear()
        found = self.memory.find(keys, checks)
        unseen = np.flatnonzero(found < 0)
        if len(unseen):
            _, first = np.unique(keys[unseen], return_index=True)
            new = unseen[first]
            self.learn(blob, at[new], ends[new], keys[new], checks[new])
            found[unseen] = self.memory.find(keys[unseen], checks[unseen])
            clash = np.unique(doc[found < 0])  # texts with a piece that has the hash of another
            if len(clash):
                direct |= dict(zip(clash.tolist(), self.direct([blob[bounds[i] : bounds[i + 1]].decode() for i in clash.tolist()]), strict=True))
                keep = ~np.isin(doc, clash)
                doc, found = doc[keep], found[keep]
        sizes = self.memory.sizes[found].astype(np.int64)
        ids = self.memory.ids[ranges(self.memory.starts[found], sizes)]
        counts = np.bincount(doc, weights=sizes, minlength=n).astype(np.int64)
        if direct:
            cuts = np.concatenate(([0], np.cumsum(counts)))
            ids = np.concatenate([x for i in range(n) for x in ([direct[i]] if i in direct else [ids[cuts[i] : cuts[i + 1]]])])
            counts[list(direct)] = [len(x) for x in direct.values()]
        return counts, ids

    def learn(self, blob: bytes, at: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        pieces = [blob[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        kinds = np.array([p[0] for p in pieces])
        spaced, others = np.flatnonzero(kinds == 32), np.flatnonzero(kinds != 32)
        if len(spaced):
            sizes, ids = self.spaced([pieces[i][1:].decode() for i in spaced.tolist()])
            self.memory.add(keys[spaced], checks[spaced], sizes, ids)
        if len(others):
            feed = np.array([self.feed], dtype=np.int32)
            coded = self.direct([(pieces[i][1:] if pieces[i][0] == 10 else pieces[i]).decode() for i in others.tolist()])
            coded = [np.concatenate((feed, c)) if pieces[i][0] == 10 else c for i, c in zip(others.tolist(), coded, strict=True)]
            self.memory.add(keys[others], checks[others], np.array([len(c) for c in coded]), np.concatenate(coded))


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _encode_shards(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = None, 0
        for batch in slices(batches, 1000):
            counts, ids = encoder(path).encode(*utf8(batch.column("text")))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            shards = batch.column("shard").to_numpy()
            before = np.zeros(len(counts), dtype=np.int64)
            for i, (s, k) in enumerate(zip(shards.tolist(), counts.tolist(), strict=True)):
                if s != shard:
                    shard, start = s, 0
                before[i] = start
                start += k
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), pa.array(counts), pa.array(before), tokens], ["shard", "doc_id", "n_tokens", "shard_start", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, shards: int | None = None) -> None:
    """Writes shards under path/tokens and the manifest (shard, docs, tokens, start) under path/manifest."""
    spark = docs.sparkSession
    n = shards or partitions(spark)
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    deal, _ = range_bucket(rows, "doc_id", n)
    rows = rows.withColumn("shard", deal(F.col("doc_id"), F.col("tie")))
    ordered = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie", "text").drop("tie")
    writer = ordered.mapInArrow(lean(_encode_shards(tokenizer, end_id)), SCHEMA).write
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("shard", "doc_id", "n_tokens", "shard_start")},
    }
    writer.options(**options).parquet(f"{path}/tokens")
    sums = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).orderBy("shard").collect()  # a row a shard
    start, manifest = 0, []
    for s, k, t in sums:
        manifest.append((s, k, t, start))
        start += t
    spark.createDataFrame(manifest, "shard int, docs long, tokens long, start long").coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and, if asked for, tokens."""
    starts = {s: k for s, k in spark.read.parquet(f"{path}/manifest").select("shard", "start").collect()}  # a row a shard
    if not starts:
        base = F.lit(0).cast("long")
    else:
        base = F.get(F.expr("array(" + ",".join(f"{starts.get(s, 0)}L" for s in range(max(starts) + 1)) + ")"), F.col("shard"))
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    return rows.select("doc_id", (base + F.col("shard_start")).alias("start"), "n_tokens", *["tokens"] * tokens)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        flat = memoryview(np.ascontiguousarray(tokens.flatten().to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        bounds = np.concatenate(([0], np.cumsum(batch.column("n_tokens").to_numpy()))) * 4
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
