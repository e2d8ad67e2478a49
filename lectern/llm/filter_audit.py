"""Filter interaction audit: what each filter removes at each place of each order, by the edges of the lattice of filter sets.

A filter's effect at a step depends on which filters came before, not on their order. So k filters have k * 2**(k-1) edges (set already
applied, next filter), 80 for five, and every step of every order is one of them. Documents are counted by the set of filters that
they fail; these counts (2**k a part and label at most) go to the edges, and a table of the k! * k steps, each with its edge, is joined
to the edges as paths through the lattice. No document is read once for each order.

The duplicate filter fails what is identical to the text of a smaller id. Rows are first counted by (digest of the text, part, labels), which
gathers copies before they are exchanged; of a text's rows, those with the least id pass. Texts count as identical if their SHA-256 is, and
words of a text if 64-bit hashes of them are.

Odd rows: a null text is empty, a null part is the part ``''``. A null id is larger than all ids, and is not smaller than
another null. Rows that share an id are counted each; the least id's rows all pass the duplicate filter. Labels of one id that repeat count
if any of them says 1; a null id has no labels. Very long texts are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded, lean, runs_hash, slices, table, utf8
from lectern.llm.substring_dedup import split

#: The orders of more filters than this are too many to list.
MOST_FILTERS = 7
MEASURES = "id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_chars long, symbols boolean"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|")] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, bounds = utf8(batch.column("text"))
        start, end = split(raw, bounds)
        first = np.searchsorted(start, bounds)
        own = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        words = runs_hash(raw, start, end)
        order = np.lexsort((words, own))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (own[order][1:] != own[order][:-1])
        distinct = np.bincount(own[order][new], minlength=len(bounds) - 1)
        blob = memoryview(np.ascontiguousarray(raw))
        digests = [hashlib.sha256(blob[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        counts = [np.diff(first), distinct, _per_text((raw >= 65) & (raw <= 90), bounds), _per_text((raw & 0xC0) != 0x80, bounds)]
        columns = [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), *[pa.array(x, pa.int64()) for x in counts], pa.array(_per_text(_SYMBOL[raw], bounds) > 0)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "part", "digest", "n_words", "n_distinct", "n_capitals", "n_chars", "symbols"])


def measures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """What filters look at, of each whole text: words (how many, how many distinct), capitals A-Z and characters, whether a symbol occurs, and its digest."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(lean(_measure), MEASURES)


def five_filters() -> dict[str, Column | None]:
    """Failure conditions by letter, on measures; None stands for the duplicate filter."""
    return {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 10 * F.col("n_chars"),
        "D": F.col("symbols"),
        "E": None,
    }


def failures(measured: DataFrame, labels: DataFrame, filters: dict[str, Column | None]) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters that they fail, bit i for the i-th filter. measured has id, part, digest and what filters name."""
    letters = list(filters)
    mask = sum((F.when(filters[c], 1 << i).otherwise(0) for i, c in enumerate(letters) if filters[c] is not None), F.lit(0))
    rows = measured.select("id", "part", "digest", mask.alias("mask"))
    # rows without an id find no label, and are dealt out by their digest
    rows = rows.withColumns({"key": F.coalesce("id", F.xxhash64("digest")), "known": F.col("id").isNotNull()})
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(said.withColumn("known", F.lit(True)), ["key", "known"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    kinds = ["digest", "mask", "part", "good", "toxic"]
    if all(x is not None for x in filters.values()):
        return _by_mask(rows.withColumn("n", F.lit(1)))
    bit = F.lit(1 << next(i for i, c in enumerate(letters) if filters[c] is None))
    # of rows that are alike, how many have their least id (nulls are the largest); the exchange by id, for labels, serves the first count
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    ids = rows.groupBy("key", "known", "id", *kinds).agg(F.count("*").alias("n"))
    alike = ids.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(order).alias("least"), F.min_by("n", order).alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))  # rows of a text: one for each part and label
    alike = alike.withColumn("passed", F.when(F.col("least") == first, F.col("n_least")).otherwise(0))
    both = F.array(F.struct("mask", F.col("passed").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    return _by_mask(alike.select("part", "good", "toxic", F.explode(both).alias("at")).select("part", "good", "toxic", "at.*"))


def _by_mask(rows: DataFrame) -> DataFrame:
    """Rows of n documents, labelled alike, to a row for each part and mask."""
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def lattice(failed: DataFrame, k: int) -> DataFrame:
    """(part, mask, n, good, toxic) to the k * 2**(k-1) edges of each part, zeros included: (part, before, next) and what the filter
    ``next`` does where the set ``before`` was applied."""
    edges = [(s, i) for i in range(k) for s in range(1 << k) if not s >> i & 1]
    listed = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(i).alias("next")) for s, i in edges])
    every = failed.select("*", F.explode(listed).alias("edge")).select("part", "mask", "n", "good", "toxic", "edge.*")
    bit = F.expr("shiftleft(1, next)")
    alive, fails = F.col("mask").bitwiseAND(F.col("before")) == 0, F.col("mask").bitwiseAND(bit) != 0
    total = lambda when, value: F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    counts = every.groupBy("part", "before", "next").agg(
        total(alive & ~fails, "n").alias("kept"), total(alive & fails, "n").alias("removed"), total(~alive & fails, "n").alias("redundant"),
        total(F.col("mask") == bit, "n").alias("unique_fails"), total(alive & fails, "good").alias("good_lost"), total(alive & fails, "toxic").alias("toxic_lost"),
    )
    # an edge lies on as many orders as there are of the filters before it and of those after it
    orders = F.element_at(F.array(*[F.lit(math.factorial(m) * math.factorial(k - 1 - m)) for m in range(k)]), F.bit_count("before") + 1)
    return counts.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "next")).cast("long"))


def paths(spark: SparkSession, letters: list[str]) -> DataFrame:
    """(filter_order, step, before, next): each step of each order, and its edge."""
    rows = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(letters[j] for j in order), step, before, i))
            before |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, before int, next int")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None], part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step; filters: letter to failure condition (of measures), None for duplicates."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    edges = lattice(failures(measures(docs, part), labels, filters), len(filters))
    steps = paths(docs.sparkSession, list(filters))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return edges.join(F.broadcast(steps), ["before", "next"]).select(*columns)  # at most 7! * 7 rows


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, table(spark, sf_dir, "labels"), five_filters())


#: DuckDB SQL for op11_filter_audit's rows, step by step for each order.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         map {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
              'C': 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 10 * length(d.t),
              'D': regexp_matches(d.t, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, d.doc_id IS NULL AND first_id IS NOT NULL)} AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = d.doc_id),
kinds AS (
  SELECT part, fails['A'] AS a, fails['B'] AS b, fails['C'] AS c, fails['D'] AS d, fails['E'] AS e, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
seen AS (
  SELECT k.*, filter_order, step, substr(filter_order, step, 1) AS x,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: [a, b, c, d, e][ascii(l) - 64]) AS failed,
         list_has_any(string_split(substr(filter_order, 1, step - 1), ''), list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: [a, b, c, d, e][ascii(l) - 64])) AS gone
  FROM kinds k, steps),
counted AS (
  SELECT part, filter_order, step, any_value(x) AS x,
         coalesce(sum(n) FILTER (NOT gone AND NOT list_contains(failed, x)), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND list_contains(failed, x)), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND list_contains(failed, x)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = [x]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND list_contains(failed, x)), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND list_contains(failed, x)), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM counted
"""
