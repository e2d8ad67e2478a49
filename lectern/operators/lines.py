"""Operators on lines (source, page, line_no, line). Order is only ever that of page and line_no within a source.

By default windows over a source do it, as one exchange of the lines then serves a whole parser. With ``long`` a source may be of any length: scans
go by blocks of its lines, so that it is many tasks, for an exchange or two of a row a block more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import contains_any, is_letter, strip

SCOPES = {"source": ("source",), "page": ("source", "page")}
#: A block holds the lines of a page by so many of their numbers, and a span the blocks of so many pages.
BLOCK_LINES = 4096
SPAN_PAGES = 1024


def in_order(scope: str = "source") -> Window:
    return Window.partitionBy(*SCOPES[scope]).orderBy("page", "line_no")


def so_far(scope: str = "source") -> Window:
    return in_order(scope).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def stripped(lines: DataFrame) -> DataFrame:
    """Lines without white space at their ends; empty ones go. A line is stripped once, through a generator: else each predicate on it would do so again."""
    return lines.withColumn("line", F.explode(F.array(strip(F.col("line"))))).where(F.col("line") != "").select(*lines.columns)


def without_noise(lines: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Stripped lines without those equal to a filter and without single letters."""
    line = F.col("line")
    out = stripped(lines).where(~is_letter(line))
    return out.where(~line.isin(*filters)) if filters else out


def longer_than(lines: DataFrame, n: int = 2) -> DataFrame:
    return stripped(lines).where(F.length("line") > n)


def _with_first(lines: DataFrame, hit: Column, scope: str) -> DataFrame:
    """lines with the place of their scope's first hit, null if there is none. First hits of blocks give those of scopes, which come back to the lines
    by block, so that a scope of any length is many tasks. Keys are structs, so that null is a key too."""
    marked = lines.withColumns({**_blocks(scope), "_here": F.struct("page", "line_no")})
    blocks = marked.groupBy("_block", "_scope").agg(F.min(F.when(hit, F.col("_here"))).alias("_own"))
    first = blocks.groupBy("_scope").agg(F.min("_own").alias("_first"))
    return marked.join(blocks.join(first, "_scope").select("_block", "_first"), "_block")


def from_first(lines: DataFrame, hit: Column, scope: str = "source", long: bool = False) -> DataFrame:
    """Each scope's lines from its first hit on; all of them if there is none. long: first hits are an aggregate, joined back by block, without a window."""
    if not long:
        every = Window.partitionBy(*SCOPES[scope])
        marked = lines.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
        marked = marked.withColumns({"_from": F.max("_hit").over(so_far(scope)), "_any": F.max("_hit").over(every)})
        return marked.where((F.col("_from") == 1) | (F.col("_any") == 0)).drop("_hit", "_from", "_any")
    return _with_first(lines, hit, scope).where(F.col("_first").isNull() | (F.col("_here") >= F.col("_first"))).select(*lines.columns)


def trimmed_to_keyword(lines: DataFrame, keywords: Sequence[str], fold: bool = True, long: bool = False) -> DataFrame:
    return from_first(lines, contains_any(F.col("line"), keywords, upper=fold), long=long)


def after_marker(lines: DataFrame, pattern: str, scope: str = "source", long: bool = False) -> DataFrame:
    """Lines after the first that matches; all of them if none does. long: as in from_first."""
    if not long:
        marked = lines.withColumn("_n", F.row_number().over(in_order(scope)))
        first = F.min(F.when(F.col("line").rlike(pattern), F.col("_n"))).over(Window.partitionBy(*SCOPES[scope]))
        return marked.withColumn("_first", F.coalesce(first, F.lit(0))).where(F.col("_n") > F.col("_first")).drop("_n", "_first")
    return _with_first(lines, F.col("line").rlike(pattern), scope).where(F.col("_first").isNull() | (F.col("_here") > F.col("_first"))).select(*lines.columns)


def first_rows(lines: DataFrame, n: int) -> DataFrame:
    """Each source's first n lines. The limit holds before rows are exchanged too, so that a task passes on n of a source at most."""
    return lines.withColumn("_row", F.row_number().over(in_order())).where(F.col("_row") <= n).drop("_row")


def numbered(lines: DataFrame, name: str = "row_no", scope: str = "source") -> DataFrame:
    return lines.withColumn(name, F.row_number().over(in_order(scope)))


def _key(*columns: str) -> Column:
    return F.struct(*columns)


def _blocks(scope: str) -> dict[str, Column]:
    """Blocks of lines that follow each other: of a page, so many of its line numbers. Then the spans of blocks, so many pages each, within a scope."""
    part = F.floor(F.col("line_no") / BLOCK_LINES)
    pages = F.floor(F.col("page") / SPAN_PAGES)
    return {"_block": F.struct("source", "page", part.alias("part")), "_span": F.struct("source", pages.alias("pages") if scope == "source" else F.col("page").alias("pages")), "_scope": _key(*SCOPES[scope])}


def _before(blocks: DataFrame, names: Sequence[str]) -> DataFrame:
    """(_block, names): of each block the latest non-null values in the blocks before it in its scope, by spans and then over spans. blocks: _block, _span, _scope, names."""
    in_span = Window.partitionBy("_span").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    over_spans = Window.partitionBy("_scope").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.groupBy("_scope", "_span").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_block"))).alias(n) for n in names])
    spans = spans.select("_span", *[F.last(n, ignorenulls=True).over(over_spans).alias(f"_far_{n}") for n in names])
    near = blocks.select("_block", "_span", *[F.last(n, ignorenulls=True).over(in_span).alias(n) for n in names])
    return near.join(spans, "_span").select("_block", *[F.coalesce(n, f"_far_{n}").alias(n) for n in names])


def carried_all(lines: DataFrame, values: dict[str, Column], scope: str = "source", long: bool = False) -> DataFrame:
    """For each name a column with its latest non-null value up to the row, by a window over each scope; long: by a segmented scan. Lines are exchanged once, by block; a block's last values (a row
    a block) are carried over the blocks of a scope and added back, so that a scope of any length is many tasks."""
    if not long:
        return lines.withColumns({n: F.last(v, ignorenulls=True).over(so_far(scope)) for n, v in values.items()})
    marked = lines.withColumns({**_blocks(scope), **{f"_own_{n}": v for n, v in values.items()}})
    last = {n: F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), F.col("line_no"))).alias(n) for n in values}
    blocks = marked.groupBy("_block", "_span", "_scope").agg(*last.values())
    before = _before(blocks, list(values)).withColumnsRenamed({n: f"_before_{n}" for n in values})
    order = Window.partitionBy("_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked.withColumns({f"_own_{n}": F.last(f"_own_{n}", ignorenulls=True).over(order) for n in values}).join(before, "_block")
    kept = [c for c in lines.columns if c not in values]
    return rows.select(*kept, *[F.coalesce(f"_own_{n}", f"_before_{n}").alias(n) for n in values])


def carried(lines: DataFrame, name: str, value: Column, scope: str = "source", long: bool = False) -> DataFrame:
    """A column with the latest non-null value up to the row."""
    return carried_all(lines, {name: value}, scope, long)


def since_reset(value: Column, reset: Column) -> Column:
    """An event to be carried: a value, or (where reset holds) that there is none any more; its field ``value``."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"))).when(reset, F.struct(F.lit(None).cast("string").alias("value")))


def carried_within(lines: DataFrame, name: str, value: Column, reset: Column, scope: str = "source", long: bool = False) -> DataFrame:
    """As carried, forgetting what came before the latest row where reset holds. Values are texts."""
    return carried_all(lines, {name: since_reset(value, reset)}, scope, long).withColumn(name, F.col(name)["value"])


def with_next(lines: DataFrame, name: str = "next_line", default: str | None = "", scope: str = "source", long: bool = False) -> DataFrame:
    """The next row's line (default after the last one), by a window over each scope; long: within blocks, and for a block's last row the head of the block after it, which
    is found among the heads of its span and, at a span's end, of the next one."""
    if not long:
        return lines.withColumn(name, F.lead("line", 1, default).over(in_order(scope)))
    marked = lines.withColumns(_blocks(scope))
    heads = marked.groupBy("_block", "_span", "_scope").agg(F.min_by(F.struct("line"), "line_no").alias("_head"))
    spans = heads.groupBy("_scope", "_span").agg(F.min_by("_head", "_block").alias("_head"))
    spans = spans.select("_span", F.lead("_head").over(Window.partitionBy("_scope").orderBy("_span")).alias("_far"))
    after = heads.select("_block", "_span", F.lead("_head").over(Window.partitionBy("_span").orderBy("_block")).alias("_near"))
    after = after.join(spans, "_span").select("_block", F.coalesce("_near", "_far").alias("_after"))
    order = Window.partitionBy("_block").orderBy("line_no")
    rows = marked.withColumn("_next", F.lead(F.struct("line")).over(order)).join(after, "_block")
    following = F.coalesce("_next", "_after")
    return rows.select(*[c for c in lines.columns if c != name], F.when(following.isNull(), F.lit(default)).otherwise(following["line"]).alias(name))


def line_counts(lines: DataFrame, *by: str) -> DataFrame:
    return lines.groupBy(*by).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def scanned(lines: DataFrame, most: int = 100, sources: DataFrame | None = None) -> DataFrame:
    """Each source and whether its first page has too little text for a text layer. sources: all of them (source), so that those without
    any line, as a file without a text layer has none, are there too, and true."""
    length = F.sum(F.when(F.col("page") == 1, F.length(strip(F.col("line"))) + 1).otherwise(0))
    found = lines.groupBy("source").agg((length - 1 <= most).alias("scanned"))
    if sources is None:
        return found
    return sources.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("scanned", F.lit(True)).alias("scanned"))
