"""Mixing sources to target weights by capped water-filling.

Each source wants a share of the total by its weight, but at most ``max_epochs`` times what it has. Sources above that
are clamped, and what they leave is shared by weight among the others, until none is above. In order of
cap / weight, the sources clamped are the first ones, so running sums in that order settle it in one pass, as SQL.

A source whose target is r times its size takes every document floor(r) times, and a seeded part once more: documents
are ordered by a hash of seed and id, and the first ones whose words make up the fraction are repeated. The cut
is found by two histograms of hash steps (4096, then 4096 within the step that the cut falls in), so that no source
is sorted and no task holds one. Of the few documents in the fine step that the cut falls in (mostly one), a fractional
repetition is taken, their first words, in the proportion that meets the target; that leaves less than a word a document.

A null text has size 0, and a null source is a source of its own, the last. Rows with equal ids fare alike; null ids count
as one id. An empty table gives no rows. A source without words has the target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD_PATTERN, free_prefix, table, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
STEPS = 4096
ADDED = ("size", "source_size", "target", "repeats", "part", "taken")
#: The plan has a row a source; up to so many rows it is broadcast, beyond that it is joined by shuffling.
MOST_BROADCAST = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Its windows run over sources, not over documents.

    In order of cap / weight, the level that a source and those after it would share, with those before it clamped,
    rises up to the first source that is not clamped and falls after it: the water stands at the highest.
    """
    every = Window.partitionBy(F.lit(0))
    named = every.orderBy(F.col("source").isNull(), F.col("source"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumns({"weight": F.get(listed, (F.row_number().over(named) - 1) % len(weights)), "cap": F.col("source_size") * F.lit(float(max_epochs))})
    order = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.sum("source_size").over(every) - before) / onward)
    return levels.select("source", "source_size", F.least(F.col("cap"), F.max("level").over(every) * F.col("weight")).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _hash(seed: str) -> Column:
    """32 bits that depend on seed and id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def _cut(steps: DataFrame, step: str) -> DataFrame:
    """(key, step, words, extra) to the first step of each key at whose end the words are more than extra."""
    order = Window.partitionBy("key").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    return sums.where(F.col("before") + F.col("words") > F.col("extra")).groupBy("key").agg(F.min(F.struct(step, "before", "words", "extra")).alias("at")).select("key", "at.*")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs (of any columns, doc_id, source and text among them) with size, source_size, target, repeats (times that the
    whole document is taken), part (first words of it that are taken besides) and taken (repeats * size + part); columns
    of these names are replaced."""
    added = {"key": _key(F.col("source")), "size": size_of(F.col("text")), "coarse": F.shiftright(_hash(seed), 20), "fine": F.shiftright(_hash(seed), 8).bitwiseAND(F.lit(STEPS - 1))}
    sizes = written(docs.select("source", *[c.alias(k) for k, c in added.items()]), "mix-sizes")
    coarse = sizes.groupBy("source", "key", "coarse").agg(F.sum("size").alias("words"))
    goal = targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(_key(F.col("source")).alias("key"), "source_size", "target", F.floor(ratio).cast("int").alias("whole"))
    goal = written(goal.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal")
    small = goal.count() <= MOST_BROADCAST
    few = F.broadcast if small else (lambda df: df)
    cut = _cut(coarse.join(few(goal.select("key", "extra")), "key"), "coarse")
    cut = written(cut.select("key", F.col("coarse").alias("cut"), (F.col("extra") - F.col("before")).alias("extra")), "mix-cut")
    inside = sizes.join(few(cut), "key").where(F.col("coarse") == F.col("cut"))
    fine = _cut(inside.groupBy("key", "fine", "extra").agg(F.sum("size").alias("words")), "fine")
    fraction = (F.col("extra") - F.col("before")) / F.col("words")
    plan = goal.join(cut.drop("extra"), "key", "left").join(fine.select("key", F.col("fine").alias("fine_cut"), fraction.alias("fraction")), "key", "left")
    plan = written(plan.select("key", "source_size", "target", "whole", "cut", "fine_cut", "fraction"), "mix-plan")
    own = free_prefix(docs.columns)
    names = {c: own + c for c in ("key", "coarse", "fine", "cut", "fine_cut", "fraction", "whole")}
    plan = few(plan.withColumnsRenamed(names))
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*kept, *[c.alias(names.get(k, k)) for k, c in added.items()]).join(plan, names["key"])
    more = (F.col(names["coarse"]) < F.col(names["cut"])) | ((F.col(names["coarse"]) == F.col(names["cut"])) & (F.col(names["fine"]) < F.col(names["fine_cut"])))
    at_cut = (F.col(names["coarse"]) == F.col(names["cut"])) & (F.col(names["fine"]) == F.col(names["fine_cut"]))
    rows = rows.withColumn("repeats", F.col(names["whole"]) + F.coalesce(more, F.lit(False)).cast("int"))
    rows = rows.withColumn("part", F.when(at_cut, F.floor(F.col("size") * F.col(names["fraction"]))).otherwise(F.lit(0)).cast("long"))
    return rows.select(*kept, "size", "source_size", "target", "repeats", "part", (F.col("repeats") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as often as it is taken, a part of it as a text of its first words."""
    own = [c for c in docs.columns if c in ADDED]  # columns of docs that have names of ours keep their values
    prefix = free_prefix(docs.columns)
    rows = mix_sources(docs.withColumnsRenamed({c: prefix + c for c in own}), **options)
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})")), 1, F.col("part").cast("int")), " ")
    copies = F.array_repeat(F.lit(False), F.col("repeats"))
    cut = free_prefix(rows.columns) + "cut"
    every = rows.withColumn(cut, F.explode(F.when(F.col("part") > 0, F.concat(copies, F.array(F.lit(True)))).otherwise(copies)))
    every = every.withColumn("text", F.when(F.col(cut), head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        every = every.withColumn("n_chars", F.when(F.col(cut), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return every.drop(*ADDED).withColumnsRenamed({prefix + c: c for c in own}).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats", "part")


#: DuckDB SQL for op10_mixing's rows: the same arithmetic on integers and exact doubles.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM documents),
steps AS (SELECT source, h >> 20 AS coarse, (h >> 8) & 4095 AS fine, size FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size * 3.0::DOUBLE) OVER w_before, 0)) / sum(weight) OVER w_onward AS level
  FROM sources
  WINDOW w_before AS (ORDER BY source_size * 3.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w_onward AS (ORDER BY source_size * 3.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goals AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goals),
extra AS (SELECT *, target - whole * source_size AS extra FROM goal),
coarse AS (
  SELECT s.source, s.coarse, sum(size)::BIGINT AS words FROM steps s GROUP BY 1, 2),
coarse_sums AS (
  SELECT c.*, e.extra, coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY c.coarse ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM coarse c JOIN extra e ON c.source IS NOT DISTINCT FROM e.source),
cut AS (
  SELECT source, min(coarse) AS cut, arg_min(extra - before, coarse) AS extra FROM coarse_sums WHERE before + words > extra GROUP BY source),
fine AS (
  SELECT s.source, s.fine, c.extra, sum(size)::BIGINT AS words
  FROM steps s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source AND s.coarse = c.cut GROUP BY 1, 2, 3),
fine_sums AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY fine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fine),
fine_cut AS (
  SELECT source, min(fine) AS fine_cut, arg_min((extra - before) / words, fine) AS fraction
  FROM fine_sums WHERE before + words > extra GROUP BY source),
plan AS (
  SELECT e.*, c.cut, f.fine_cut, f.fraction FROM extra e
  LEFT JOIN cut c ON e.source IS NOT DISTINCT FROM c.source
  LEFT JOIN fine_cut f ON e.source IS NOT DISTINCT FROM f.source),
out AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, s.source,
         (p.whole + CASE WHEN coalesce((h >> 20) < cut OR ((h >> 20) = cut AND ((h >> 8) & 4095) < fine_cut), false) THEN 1 ELSE 0 END)::INTEGER AS repeats,
         CASE WHEN (h >> 20) = cut AND ((h >> 8) & 4095) = fine_cut THEN floor(s.size * fraction) ELSE 0 END::BIGINT AS part
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (repeats * size + part)::BIGINT AS taken, source, repeats, part FROM out
"""
