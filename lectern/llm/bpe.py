"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round packs each adjacent pair of a word into one integer, finds
its rank by binary search over the sorted pair keys, takes each word's lowest rank, and joins all its occurrences from left
to right. Words with no pair left leave the array. Where a merge's product takes part in a rule of lower rank, joining all
occurrences at once could differ from one at a time, so such a merge joins its leftmost occurrence only.
Words of thousands of symbols take rounds of their own, which touch only the places of the lowest rank and the pairs beside them, so that the time goes
with the length.

It serves tokenizer files of the kind: NFC, white space, lower case; a splitting pattern without white space; byte
level; an end-of-word suffix. Tokens never hold a space, so that each chunk between spaces is encoded apart and distinct chunks
once; what a worker remembers of them is bounded in bytes, and long chunks are not remembered.

A null text is empty and has no ids; its decoded text is empty. Long texts are encoded whole, long words in as many rounds as
they need. Special tokens written in a text become their ids, as in the tokenizers library. Repeated rows keep a row each,
other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lectern.llm.common import bounded, table, texts_of

#: Bytes of chunks that a worker remembers between batches, about; beyond it the memory is emptied. Longer chunks than so many code points are not remembered.
CACHE_BYTES = 128 << 20
CACHED_CHUNK = 256
#: Bytes that an entry takes beside its letters and ids.
ENTRY_BYTES = 200
#: Symbols from which on a word has rounds of its own.
LONG_WORD = 2048
#: Symbols merged together.
BATCH_SYMBOLS = 1_000_000
NONE = np.int64(1 << 40)

_MODELS: dict[str, WordBpe] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, k = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + k)
            k += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        import regex

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {k: np.array([v], dtype="<u4").tobytes() for k, v in added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(added, key=len, reverse=True)) + ")").split if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\t-\r \x85\xa0")).findall  # white space among Latin letters
        self.size = max(*vocab.values(), *added.values()) + 1
        letters = byte_letters()
        self.bytes_of = {x: b for b, x in enumerate(letters)}
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], dtype=np.int64)
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])], strict=True))
        ranks = np.arange(len(made))
        lowest = np.full(self.size, NONE)
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        self.single = lowest[made] < ranks  # see the module's text
        self.left, self.right, self.made = left, right, made
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        keys, ranks = keys[order], ranks[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.keys, self.ranks = keys[first], ranks[first]
        self.names = [b""] * self.size
        for k, v in (*vocab.items(), *added.items()):
            self.names[v] = k.encode()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Ids of each word; symbols: of all words, end to end; starts: of each word. No word is empty."""
        count = len(starts)
        done: list[np.ndarray | None] = [None] * count
        ids = np.arange(count)
        lengths = np.diff(np.append(starts, len(symbols)))
        while len(ids):
            owner = np.repeat(np.arange(len(ids)), lengths)
            rank = np.full(len(symbols), NONE)
            if len(symbols) > 1:
                key = symbols[:-1] * self.size + symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
                rank[:-1][hit] = self.ranks[at[hit]]
            begin = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, begin)
            over = least == NONE
            if over.any():
                for w in np.flatnonzero(over).tolist():
                    done[ids[w]] = symbols[begin[w] : begin[w] + lengths[w]]
                stay = ~over
                keep = stay[owner]
                symbols, rank, ids, lengths, least = symbols[keep], rank[keep], ids[stay], lengths[stay], least[stay]
                if not len(ids):
                    break
                owner = np.repeat(np.arange(len(ids)), lengths)
                begin = np.cumsum(lengths) - lengths
            chosen = rank == least[owner]
            where = np.flatnonzero(chosen)
            # in a run such as a a a, every other pair
            fresh = np.concatenate(([True], np.diff(where) != 1))
            run = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))]
            where = where[(where - run) % 2 == 0]
            alone = self.single[least]
            if alone.any():
                of = owner[where]
                where = where[~alone[of] | np.concatenate(([True], of[1:] != of[:-1]))]
            symbols[where] = self.made[rank[where]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[where + 1] = False
            lengths = lengths - np.bincount(owner[where], minlength=len(ids))
            symbols = symbols[keep]
        return done

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one word. Symbols are linked to those before and after them, and places of pairs wait by rank."""
        n = len(symbols)
        symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(rank: int, places: np.ndarray) -> None:
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(ranks, rank)
            waiting[rank].append(places)

        def find(places: np.ndarray) -> None:
            places = places[after[places] < n]
            key = symbols[places] * self.size + symbols[after[places]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            places, found = places[hit], self.ranks[at[hit]]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else found
            for rank, begin, end in zip(found[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=bool(len(found))):
                wait(rank, places[begin:end])

        find(np.arange(n))
        while ranks:
            rank = heapq.heappop(ranks)
            where = np.unique(np.concatenate(waiting.pop(rank)))
            where = where[alive[where] & (after[where] < n)]
            where = where[(symbols[where] == self.left[rank]) & (symbols[after[where]] == self.right[rank])]
            if not len(where):
                continue
            if self.single[rank]:
                if len(where) > 1:
                    wait(rank, where[1:])
                where = where[:1]
            else:  # in a run such as a a a, every other pair
                at = np.arange(len(where))
                run = np.maximum.accumulate(np.where(np.concatenate(([True], after[where[:-1]] != where[1:])), at, 0))
                where = where[(at - run) % 2 == 0]
            gone = after[where]
            symbols[where] = self.made[rank]
            alive[gone] = False
            after[where] = after[gone]
            inner = after[where] < n
            before[after[where[inner]]] = where[inner]
            left = before[where]
            find(np.unique(np.concatenate((where, left[left >= 0]))))
        return symbols[alive]

    def words(self, chunk: str) -> list[str | bytes]:
        """Words of a chunk as text; ids of special tokens as bytes."""
        if self.split_added and "<" in chunk and len(parts := self.split_added(chunk)) > 1:
            return [x for p in parts for x in ([self.added[p]] if p in self.added else self.words(p))]
        if chunk.isascii() or max(chunk) < "\u0250":
            return self.pieces(unicodedata.normalize("NFC", chunk).lower())
        # Unicode data differ by version between libraries: beyond Latin letters, the tokenizer's own tables tell words apart
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return [bytes(self.bytes_of[x] for x in piece).decode() for piece, _ in pieces]

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk; short ones are remembered."""
        split = [self.words(c) for c in chunks]
        distinct = list(dict.fromkeys(w for s in split for w in s if isinstance(w, str)))
        coded: dict[str, bytes] = {}
        part: list[str] = []
        room = BATCH_SYMBOLS
        for word in distinct:
            part.append(word)
            room -= len(word)
            if room < 0:
                coded.update(self.code(part))
                part, room = [], BATCH_SYMBOLS
        if part:
            coded.update(self.code(part))
        out = {c: b"".join([w if isinstance(w, bytes) else coded[w] for w in s]) for c, s in zip(chunks, split, strict=True)}
        for chunk, ids in out.items():
            if len(chunk) <= CACHED_CHUNK:
                self.known[chunk] = ids
                self.held += 4 * len(chunk) + len(ids) + ENTRY_BYTES
        return out

    def code(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        raw = [w.encode() for w in words]
        for word, x in zip(words, raw, strict=True):
            if len(x) >= LONG_WORD:
                flat = np.frombuffer(x, dtype=np.uint8)
                yield word, self.merge_long(np.append(self.inner[flat[:-1]], self.last[flat[-1]])).astype("<u4").tobytes()
        words, raw = [w for w, x in zip(words, raw, strict=True) if len(x) < LONG_WORD], [x for x in raw if len(x) < LONG_WORD]
        if not words:
            return
        lengths = np.array([len(x) for x in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(lengths)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        for word, ids in zip(words, self.merge(symbols, ends - lengths), strict=True):
            yield word, ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        split = [t.split(" ") for t in texts]
        new: set[str] = set()
        for s in split:
            new.update(s)
        coded = {c: known for c in new if (known := self.known.get(c)) is not None}
        if need := [c for c in new if c not in coded]:
            coded.update(self.learn(need))
        return [b"".join([coded[c] for c in s]) for s in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The tokens of each text with one space between, special ones too, in UTF-8: such files have no decoder of their own."""
        names = self.names
        return [b" ".join([names[i] for i in np.frombuffer(c, dtype="<u4").tolist()]) for c in coded]


def model(path: str) -> WordBpe:
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, n_tokens and ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                coded = model(tokenizer).encode(texts_of(batch.column("__text")))
                bounds = np.concatenate(([0], np.cumsum([len(x) >> 2 for x in coded])))
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.diff(bounds), pa.int64()), ids], [*keep, "n_tokens", "ids"])

    rows = bounded(docs).select(*keep, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, docs.select(*keep).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                coded = model(tokenizer).encode(texts_of(batch.column(1)))
                decoded = model(tokenizer).decode(coded)
                digests = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (coded, decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) >> 2 for x in coded], pa.int64()), *map(pa.array, digests)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded(docs).select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
