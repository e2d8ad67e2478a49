"""Texts against a table of keywords: which keywords each text contains, as substrings and as written. Null and empty keywords, and null texts, are in nothing;
keywords that repeat count once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import stored

#: A list of keywords is an automaton in each worker up to these bounds, a join beyond them.
MOST_KEYWORDS = 100_000
MOST_BYTES = 8 << 20
#: Bytes of a gram of the index.
GRAM = 4
#: So many grams are held against texts at a time, an array in each worker; more of them take further passes over the texts.
MOST_GRAMS = 1 << 20
#: An index of no more keywords and bytes meets texts by broadcast.
SMALL_INDEX = 100_000
SMALL_BYTES = 8 << 20
#: About so many bytes of texts are cut into grams at a time.
CHUNK = 1 << 20
#: A table of so many bits of a hash tells most grams that aren't known.
SLOT_BITS = 22
#: A gram that holds more than this share of all grams of texts is dealt to several tasks; there are fewer of them than its inverse.
HOT_SHARE = 1e-5


def _distinct(keywords: DataFrame, keyword: str) -> DataFrame:
    return keywords.select(F.col(keyword).alias("keyword")).where("keyword != ''").distinct()


def fits(keywords: DataFrame, keyword: str = "keyword") -> bool:
    """Whether the distinct keywords are few and short enough for an automaton: one row to the driver."""
    n, size = _distinct(keywords, keyword).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()
    return n <= MOST_KEYWORDS and size <= MOST_BYTES


def contained(texts: DataFrame, keywords: DataFrame, key: Sequence[str], text: str = "line", keyword: str = "keyword") -> DataFrame:
    """(key, keyword): a row for each text and each keyword that it contains. key: columns that tell texts apart, none of them null."""
    return by_automaton(texts, keywords, key, text, keyword) if fits(keywords, keyword) else by_index(texts, keywords, key, text, keyword)


def by_automaton(texts: DataFrame, keywords: DataFrame, key: Sequence[str], text: str = "line", keyword: str = "keyword") -> DataFrame:
    """As contained, by one pass of an Aho-Corasick automaton over each text, without an exchange of texts. For lists within the bounds of fits."""
    words = sorted(r[0] for r in _distinct(keywords, keyword).collect())
    if not words:
        return texts.where("false").select(*key, F.lit("").alias("keyword"))
    shared = texts.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            yield batch.map(lambda t: [] if t is None else sorted({w for _, w in automaton.iter(t)}))

    return texts.select(*key, F.explode(held(F.col(text))).alias("keyword"))


def _grams(raw: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run of n bytes within texts that end there, and where it starts."""
    m = max(0, len(raw) - n + 1)
    code = np.zeros(m, dtype=np.uint32)
    for i in range(n):
        code |= raw[i : i + m].astype(np.uint32) << np.uint32(8 * i)
    within = np.ones(m, dtype=bool)
    for i in range(1, n):  # a run that starts there goes on beyond its text
        over = end - i
        within[over[(over >= 0) & (over < m)]] = False
    at = np.flatnonzero(within)
    return code[at], at


def _slot(code: np.ndarray) -> np.ndarray:
    return code * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)


def _batches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of texts with starts and ends, about CHUNK bytes at a time, from which text on."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    valid = np.asarray(column.is_valid())
    k = 0
    while k < len(column):
        upto = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
        start, end = offsets[k:upto] - offsets[k], offsets[k + 1 : upto + 1] - offsets[k]
        yield k, data[offsets[k] : offsets[upto]], start, np.where(valid[k:upto], end, start)
        k = upto


def _known(raw: np.ndarray, end: np.ndarray, known: dict[int, tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of grams the places of known ones: which they are, by their place among all known ones of that size, as numbers of the index, and where they start."""
    for n, (codes, slots, first) in known.items():
        code, at = _grams(raw, end, n)
        maybe = np.flatnonzero(slots[_slot(code)])  # most are none: a look-up before a search
        code, at = code[maybe], at[maybe]
        place = np.searchsorted(codes, code)
        place[place == len(codes)] = 0
        good = codes[place] == code
        yield place[good] + first, at[good]


def _own_grams(column: pa.Array) -> pa.Array:
    """The distinct grams of each keyword; a keyword that is shorter than a gram is its own. A gram is a number that also tells its size."""
    out: list[list[int]] = [[] for _ in range(len(column))]
    for k, raw, start, end in _batches(column):
        for n in range(1, GRAM + 1):
            code, at = _grams(raw, end, n)
            row = np.searchsorted(end, at, "right")
            size = (end - start)[row]
            own = size >= n if n == GRAM else size == n
            for r, c in np.unique(np.stack([row[own], code[own].astype(np.int64) | n << 8 * GRAM], axis=1), axis=0).tolist():
                out[k + r].append(c)
    return pa.array(out, pa.list_(pa.int64()))


def _held(known: Broadcast):
    """The distinct known grams of each text."""

    def held(column: pa.Array) -> pa.Array:
        grams, known_of = known.value
        found = [np.empty(0, dtype=np.int64)]
        for k, raw, start, end in _batches(column):
            for place, at in _known(raw, end, known_of):
                found.append(np.unique((np.searchsorted(end, at, "right") + k) * len(grams) + place))
        both = np.sort(np.concatenate(found))
        offsets = np.searchsorted(both, np.arange(len(column) + 1) * len(grams))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams[both % len(grams)], pa.int64()))

    return F.arrow_udf(held, "array<bigint>")


def _counted(known: Broadcast):
    """(gram, n): how often a task's texts have each known gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known_of = known.value
        n = np.zeros(len(grams), dtype=np.int64)
        for batch in batches:
            for _, raw, _, end in _batches(batch.column(0)):
                for place, _ in _known(raw, end, known_of):
                    n += np.bincount(place, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(grams[some]), pa.array(n[some])], ["gram", "n"])

    return run


def _parts(grams: DataFrame) -> Iterator[Broadcast]:
    """The grams of a stored table (gram, distinct), about MOST_GRAMS at a time, as _known takes them; texts are passed over once for each."""
    parts = -(-grams.count() // MOST_GRAMS)
    for i in range(parts):
        part = grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == i).toPandas()["gram"].to_numpy(dtype=np.int64)
        part.sort()
        of_size = {}
        for n in np.unique(part >> 8 * GRAM).tolist():
            first, last = np.searchsorted(part >> 8 * GRAM, [n, n + 1]).tolist()
            codes = part[first:last].astype(np.uint32)
            slots = np.zeros(1 << SLOT_BITS, dtype=bool)
            slots[_slot(codes)] = True
            of_size[n] = (codes, slots, first)
        yield grams.sparkSession.sparkContext.broadcast((part, of_size))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def by_index(texts: DataFrame, keywords: DataFrame, key: Sequence[str], text: str = "line", keyword: str = "keyword") -> DataFrame:
    """As contained, for keywords of any number: each keyword is looked for where its rarest gram is (keywords shorter than a gram are their own), then verified.

    Grams are runs of bytes, as UTF-8 holds a keyword's bytes where a text holds the keyword. Those that no keyword has leave no task: texts' grams are held against arrays of the
    keywords' grams. A small index meets the texts where they are, by broadcast; a larger one by an equi-join in which a gram that is frequent is dealt out by salts,
    its keywords copied to each."""
    words = stored(_distinct(keywords, keyword), "keywords")
    here = texts.where(F.col(text).isNotNull())
    of_words = words.select("keyword", F.explode(F.arrow_udf(_own_grams, "array<bigint>")(F.col("keyword"))).alias("gram"))
    asked = stored(of_words.select("gram").distinct(), "grams")
    counts = [here.select(text).mapInArrow(_counted(part), "gram long, n long") for part in _parts(asked)]
    if not counts:
        return texts.where("false").select(*key, F.lit("").alias("keyword"))
    counts = _union(counts)
    counts = stored(counts.groupBy("gram").agg(F.sum("n").alias("n")), "gram_counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(1, int(total * HOT_SHARE))
    met = of_words.join(counts, "gram", "left").groupBy("keyword").agg(F.min_by(F.struct("gram", "n"), F.struct("n", "gram")).alias("r"), F.count_if(F.col("n").isNull()).alias("absent"))
    rarest = stored(met.where("absent = 0").select("keyword", "r.*"), "rarest")  # a gram that no text has: nor the keyword
    looked_for = stored(rarest.select("gram").distinct(), "rarest_grams")
    cells = [here.select(*key, F.col(text).alias("_text"), F.explode(_held(part)(F.col(text))).alias("gram")) for part in _parts(looked_for)]
    if not cells:
        return texts.where("false").select(*key, F.lit("").alias("keyword"))
    verified = F.col("_text").contains(F.col("keyword"))
    n, size = rarest.agg(F.count("*"), F.sum(F.octet_length("keyword"))).first()
    if n <= SMALL_INDEX and size <= SMALL_BYTES:
        return _union(cells).join(F.broadcast(rarest.select("gram", "keyword")), "gram").where(verified).select(*key, "keyword")
    parts = F.when(F.col("n") > most, F.ceil(F.col("n") / most)).otherwise(F.lit(1)).cast("int")
    index = rarest.select("gram", "keyword", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    hot = counts.where(F.col("n") > most).select("gram", parts.alias("_parts"))  # fewer than 1 / HOT_SHARE rows
    salted = _union([c.drop("_text") for c in cells]).join(F.broadcast(hot), "gram", "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*key), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    pairs = salted.join(index, ["gram", "_salt"]).select(*key, "keyword")
    return pairs.join(here.select(*key, F.col(text).alias("_text")), list(key)).where(verified).select(*key, "keyword")
