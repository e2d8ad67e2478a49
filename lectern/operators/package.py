"""Keyword parsers: census lines paired with the next one, election lines, and plain words, named by number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Config
from lectern.functions.text import contains_any, split_wide, split_words, squeeze
from lectern.operators.lines import trimmed_to_keyword, with_next, without_noise
from lectern.operators.schema import names_column

KEYWORDS = {k: tuple(v) for k, v in DEFAULTS["parsing"]["keywords"].items()}
MAPPINGS = DEFAULTS["parsing"]["column_mappings"]
FILTERS = tuple(DEFAULTS["parsing"]["filters"])


def _record(names: Column, cells: Column, pad: str | None) -> Column:
    """Name to cell; names without a cell get pad, or no entry if it is null. Surplus cells are dropped."""
    n = F.size(names) if pad is not None else F.least(F.size(names), F.size(cells))
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(cells, i), F.lit(pad)))
    return F.map_from_arrays(F.slice(names, 1, n), values)


def paired(lines: DataFrame, keywords: Sequence[str], long: bool = False) -> DataFrame:
    """Region lines (those with a keyword), each with the next line that has ALL or a keyword, even if that is a region line too."""
    line = F.col("line")
    matching = lines.where(line.contains("ALL") | F.upper(line).contains("ALL") | contains_any(line, keywords))
    return with_next(matching, "data_line", long=long).where(contains_any(line, keywords))


def parse_census_pairs(lines: DataFrame, keywords: Sequence[str] = KEYWORDS["census"], mappings: dict[str, list[str]] | None = None, long: bool = False) -> DataFrame:
    """(source, page, line_no, record): a map of names to texts with REGION and SOURCE_IMAGE."""
    data = squeeze(F.regexp_replace("data_line", "( SEXE.|SEXE.)", ""))
    rows = paired(lines, keywords, long).withColumn("cells", split_words(data)).where(F.size("cells") > 0)
    rows = rows.withColumn("names", names_column(mappings or MAPPINGS, F.size("cells"))).where(F.col("names").isNotNull())
    own = F.create_map(F.lit("REGION"), F.col("line"), F.lit("SOURCE_IMAGE"), F.col("source"))
    record = F.map_filter(_record(F.col("names"), F.col("cells"), ""), lambda k, v: ~k.isin("REGION", "SOURCE_IMAGE"))
    return rows.select("source", "page", "line_no", "line", F.size("cells").alias("n_cols"), F.map_concat(record, own).alias("record"))


def parse_election(lines: DataFrame, keywords: Sequence[str] = KEYWORDS["election"], mappings: dict[str, list[str]] | None = None) -> DataFrame:
    rows = lines.where(contains_any(F.col("line"), keywords)).withColumn("cells", split_wide(F.col("line")))
    numbered = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.concat(F.lit("COL_"), i.cast("string")))
    names = F.coalesce(names_column(mappings or MAPPINGS, F.size("cells"), "election"), numbered)
    own = F.create_map(F.lit("SOURCE_IMAGE"), F.col("source"))
    record = F.map_filter(_record(names, F.col("cells"), None), lambda k, v: k != "SOURCE_IMAGE")
    return rows.select("source", "page", "line_no", "line", F.size("cells").alias("n_cols"), F.map_concat(record, own).alias("record"))


def parse_generic(lines: DataFrame) -> DataFrame:
    """(source, page, line_no, cells): words of each line that has any."""
    return lines.withColumn("cells", split_words(F.col("line"))).where(F.size("cells") > 0).select("source", "page", "line_no", "cells")


def parse_lines(lines: DataFrame, config: Config | None = None, long: bool = False) -> DataFrame:
    """Noise away, trimmed to the first keyword, then parsed as the settings say; records as maps. long: sources of any length, by blocks."""
    config = config or Config()
    keywords, mappings = config.keywords(), config.get("parsing", "column_mappings")
    rows = trimmed_to_keyword(without_noise(lines, config.get("parsing", "filters")), keywords, long=long)
    kind = config.get("parsing", "data_format")
    if kind == "census":
        return parse_census_pairs(rows, keywords, mappings, long).select("source", "page", "line_no", "record")
    if kind == "election":
        return parse_election(rows, keywords, mappings).select("source", "page", "line_no", "record")
    cells = parse_generic(rows)
    names = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.concat(F.lit("COL_"), i.cast("string")))
    record = F.map_concat(F.map_from_arrays(names, F.col("cells")), F.create_map(F.lit("SOURCE_IMAGE"), F.col("source")))
    return cells.select("source", "page", "line_no", record.alias("record"))


def record_names(rows: DataFrame) -> list[str]:
    """Keys of all records, in order of first appearance; a row a key comes to the driver."""
    keys = rows.select("source", "page", "line_no", F.posexplode(F.map_keys("record")).alias("pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("source", "page", "line_no", "pos")).alias("at"))
    return [k for (k,) in first.orderBy("at").select("key").collect()]


def parse_next_lines(lines: DataFrame, keywords: Sequence[str] = KEYWORDS["census"], widths: dict[int, str] | None = None) -> DataFrame:
    """The oldest form: case counts, single spaces split, and one width, the greatest, names all rows of a source.

    A source whose last keyword line has no line after it, or whose greatest width has no names, gives one row with an error instead of records.
    """
    widths = widths or {n: f"census_religion_{n}" for n in (7, 8, 9)}
    line = F.col("line")
    rows = trimmed_to_keyword(lines.where(~line.isin(*FILTERS, "")), keywords, fold=False)
    matching = rows.where(line.contains("ALL") | contains_any(line, keywords, upper=False))
    pairs = with_next(matching, "data_line", default=None).where(contains_any(line, keywords, upper=False))
    data = F.trim(F.regexp_replace(F.regexp_replace("data_line", "( SEXE.|SEXE.)", ""), " +", " "))
    pairs = pairs.withColumn("cells", F.split(data, " "))
    from pyspark.sql import Window

    every = Window.partitionBy("source")
    pairs = pairs.withColumns({"_width": F.max(F.size("cells")).over(every), "_broken": F.max(F.col("data_line").isNull()).over(every)})
    names = F.lit(None).cast("array<string>")
    for n, key in widths.items():
        names = F.when(F.col("_width") == n, F.array(*map(F.lit, MAPPINGS[key]))).otherwise(names)
    error = F.when(F.col("_broken"), "a region has no line after it").when(names.isNull(), F.concat(F.lit("no names for "), F.col("_width").cast("string"), F.lit(" columns")))
    own = F.create_map(F.lit("REGION"), line, F.lit("FILE_NAME"), F.col("source"))
    record = F.when(error.isNull(), F.map_concat(_record(names, F.col("cells"), ""), own))
    rows = pairs.select("source", "page", "line_no", record.alias("record"), error.alias("error"))
    failed = rows.where(F.col("error").isNotNull()).groupBy("source").agg(F.min("page").alias("page"), F.min("line_no").alias("line_no"), F.first("error").alias("error"))
    return rows.where(F.col("error").isNull()).unionByName(failed.withColumn("record", F.lit(None).cast("map<string,string>")))
