"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (1 to 3 letters, words padded by a blank) in order of
frequency. A document's own most frequent n-grams are ranked likewise, and its distance to a profile is the sum of how far
each is out of place there; an n-gram that a profile lacks counts as the profile's length. The nearest profile wins,
the smallest name among equals. score is 1 minus the distance over the largest possible.

Profiles come from a sample of labelled rows: of each language, rows chosen by a hash of id and text, about ``rows_per_lang``
(a parameter; all rows where there are fewer). The sample bounds what is learned from; predictions read every whole text.
Every labelled language is learned. A profile of each (8 kB) comes to the driver; tasks hold those of ``BLOCK_LANGS`` languages at a time, and
where there are more, one pass over the texts a block keeps the best so far.

A text that is null or has no letter is `und` with score 0. With nothing learned (no labelled row) every text is `und` in `identify`; the filter
`in_a_language` then keeps what has a letter. Null ids are drawn by their text. Very long texts are read whole. Repeated rows fare
alike, other columns are kept by the filter and ignored otherwise, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded, free_prefix, lean, mix, ranges, slices, table, written

LENGTHS = (1, 2, 3)
PROFILE = 1000
DOCUMENT = 1000
ROWS_PER_LANG = 8000
#: Languages whose profiles are broadcast at once: PROFILE n-grams of at most 24 bytes for each.
BLOCK_LANGS = 2000
#: The drawing of rows has a row a language; up to so many rows it is broadcast, beyond that it is joined by shuffling.
MOST_BROADCAST = 100_000
#: N-grams of all languages whose counts a task holds before it passes them on.
HELD_GRAMS = 1 << 21
#: A text whose score is lower is in none of the learned languages.
LEAST_SCORE = 0.3
BLANK = 32

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to its lower-case letter, to itself for a mark, to a blank for all else."""
    if not _LETTERS:
        import unicodedata

        out = np.full(0x110000, BLANK, dtype=np.uint32)
        for c in range(0x30000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
            elif unicodedata.category(x)[0] == "M":
                out[c] = c
        _LETTERS.append(out)
    return _LETTERS[0]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """64-bit codes of all n-grams of a text; equal n-grams have equal codes."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = letters()[points]
    blank = x == BLANK
    x = x[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint64)
    blank = x == BLANK
    out = [x[~blank]]
    code = x
    for n in LENGTHS[1:]:
        if len(x) < n:
            break
        code = code[:-1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n << 40)
        inner = np.zeros(len(code), dtype=bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + len(code)]
        keep = ~inner if n > 2 else ~(blank[:-1] & blank[1:])
        out.append(code[keep])
    return np.concatenate(out)


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equals by a hash of the code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((mix(values), -counts))][:most]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(rows: DataFrame, rows_per_lang: int = ROWS_PER_LANG, profile: int = PROFILE, seed: int = 7) -> dict[str, np.ndarray]:
    """(doc_id, text, lang) of labelled rows to each language's profile. Counts are summed by task, then by Spark; a profile
    (bounded) for each language comes to the driver."""
    labelled = bounded(rows).select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = written(labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows_per_lang)) / F.count("*")).alias("share")), "lang-shares")
    langs = shares.count()
    if not langs:
        return {}
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = labelled.join(F.broadcast(shares) if langs <= MOST_BROADCAST else shares, "lang").where(drawn).select("lang", "text")

    def parts(sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (values, n) in sums.items():
            for at in range(0, len(values), 50_000):
                part = values[at : at + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[at : at + 50_000])], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, lists in by.items():
                values, n = np.unique(np.concatenate(lists), return_counts=True)
                if lang in sums:
                    values, at = np.unique(np.concatenate((sums[lang][0], values)), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate((sums[lang][1], n))).astype(np.int64)
                sums[lang] = (values, n)
            if sum(len(values) for values, _ in sums.values()) > HELD_GRAMS:
                yield from parts(sums)
                sums.clear()
        yield from parts(sums)

    sums = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("gram"), "gram")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile).select("lang", "gram", "rank").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    named = best.column("lang").combine_chunks().dictionary_encode()
    codes = best.column("gram").to_numpy().view(np.uint64)
    ends = np.cumsum(np.bincount(named.indices.to_numpy(), minlength=len(named.dictionary)))
    return {lang: codes[end - n : end] for lang, end, n in zip(named.dictionary.to_pylist(), ends, np.diff(ends, prepend=0), strict=True)}


class Profiles:
    """Ranks of n-grams by language: for each n-gram a run of (language, rank). Profiles count as of the same length, the longest one's unless given."""

    def __init__(self, profiles: dict[str, np.ndarray], document: int = DOCUMENT, length: int | None = None):
        self.langs, self.document = list(profiles), document
        self.length = length or max(map(len, profiles.values()), default=1)
        sizes = [len(codes) for codes in profiles.values()]
        codes = np.concatenate([*profiles.values(), np.zeros(0, np.uint64)])
        order = np.argsort(codes, kind="stable")
        self.grams, self.starts = np.unique(codes[order], return_index=True)
        self.starts = np.append(self.starts, len(codes))
        self.lang = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.rank = np.concatenate([*[np.arange(n, dtype=np.int32) for n in sizes], np.zeros(0, np.int32)])[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        codes = ranked(grams(text), self.document)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        own = np.flatnonzero(self.grams[at] == codes)
        first, many = self.starts[at[own]], self.starts[at[own] + 1] - self.starts[at[own]]
        entry = ranges(first, many)
        nearer = np.maximum(self.length - np.abs(self.rank[entry] - np.repeat(own, many)), 0)  # than an n-gram that is absent
        total = self.length * len(codes) - np.bincount(self.lang[entry], weights=nearer, minlength=len(self.langs))
        k = int(total.argmin())
        return self.langs[k], 1.0 - float(total[k]) / (self.length * len(codes))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and score of each text, in columns of these names (which are replaced)."""
    langs = sorted(profiles)
    length = max(map(len, profiles.values()), default=1)
    found = docs
    for at in range(0, len(langs) or 1, BLOCK_LANGS):
        block = Profiles({lang: profiles[lang] for lang in langs[at : at + BLOCK_LANGS]}, length=length)
        found = _nearest(written(found, "langs") if at else found, block, names, at > 0)
    return found


def _nearest(docs: DataFrame, profiles: Profiles, names: tuple[str, str], more: bool) -> DataFrame:
    """docs with the nearest of these languages; where there are more blocks, the one that docs have already stays unless this is nearer."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded: PROFILE n-grams for each of BLOCK_LANGS languages
    kept = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in slices(batches):
            found = [predict(x) for x in batch.column("text").to_pylist()]
            if more:
                held = zip(*[batch.column(c).to_pylist() for c in names], strict=True)
                found = [new if new[1] > old[1] else old for new, old in zip(found, held, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*kept, *names])

    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    return bounded(docs).select(*kept, *(names if more else ())).mapInArrow(lean(run), schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = learn(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def in_a_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without those that are in no language: null, without a letter, or farther from every profile than the least score
    allows. Languages are learned from docs themselves; with none to learn from, whatever has a letter stays."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    added = ("lang_pred", "score")
    own = [c for c in docs.columns if c in added]  # columns of docs that have names of ours keep their values
    prefix = free_prefix(docs.columns)
    marked = docs.withColumns({prefix + c: F.col(c) for c in own})
    found = identify(marked, profiles, added).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return found.drop(*added).withColumnsRenamed({prefix + c: c for c in own}).select(*docs.columns)
