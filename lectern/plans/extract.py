"""From lines or files to a table, by the first method that finds rows."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators.analytics import statuses
from lectern.operators.census import PRESETS, parse_census
from lectern.operators.cleaning import cleaned, sorted_by
from lectern.operators.lines import longer_than
from lectern.operators.package import parse_lines, record_names
from lectern.operators.schema import named
from lectern.operators.universal import universal_rows
from lectern.plans.storage import stored
from lectern.sources.decode import Decoder, decoded, lines_of
from lectern.sources.files import listed, named_files

CASCADE = ("hierarchical", "universal", "text")


def by_method(lines: DataFrame, methods: Sequence[str] = CASCADE) -> DataFrame:
    """(source, page, line_no, method, cells) of each source, by its first method that gives a row; sources without any have none.

    Methods are cheap next to reading, so each runs on all lines, and a window by source, by which the parsers' rows are dealt already, keeps the
    first one's. Plans stay as long as the list of methods; a chain of anti-joins would repeat each method in all that come after it.
    """
    out = None
    for rank, method in enumerate(methods):
        if method in PRESETS:
            rows = parse_census(lines, method)
            cells = F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns if c not in ("source", "line_no")])
            page = F.col("PAGE") if "PAGE" in rows.columns else F.lit(1)
            rows = rows.select("source", page.alias("page"), "line_no", cells.alias("cells"))
        elif method == "universal":
            rows = universal_rows(longer_than(lines))
        else:
            rows = lines.where("trim(line) <> ''").select("source", "page", "line_no", F.array("line").alias("cells"))
        rows = rows.withColumns({"method": F.lit(method), "_rank": F.lit(rank)})
        out = rows if out is None else out.unionByName(rows)
    first = F.min("_rank").over(Window.partitionBy("source"))
    return out.withColumn("_first", first).where("_rank = _first").select("source", "page", "line_no", "method", "cells")


def method_used(lines: DataFrame, methods: Sequence[str] = CASCADE, ocr: DataFrame | None = None) -> DataFrame:
    """A row a source: its method, null if none found anything, and its rows."""
    found = with_ocr(lines, ocr, methods).groupBy("source").agg(F.first("method").alias("method"), F.count("*").alias("n_rows"))
    sources = lines.select("source") if ocr is None else lines.select("source").union(ocr.select("source"))
    return sources.distinct().join(found, "source", "left").select("source", "method", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def extract(lines: DataFrame, config: Config | None = None) -> DataFrame:
    """The package's parser as a table: a column for each name that a record has. Sources may be of any length."""
    return tabled(parse_lines(lines, config, long=True))


def tabled(records: DataFrame) -> DataFrame:
    """(source, page, line_no, record) as a table in their order."""
    names = record_names(records)
    return sorted_by(named(records, names, keep=("source", "page", "line_no")), "source", "page", "line_no").select(*[f"`{n}`" for n in names])


def extract_files(
    spark: SparkSession, paths: str | Sequence[str], config: Config | None = None, methods: Sequence[str] = ("text", "ocr"), decoders: dict[str, Decoder] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The table of all files, and the files that couldn't be read (source, error). Each file is decoded once; what it held is stored."""
    rows = stored(decoded(listed(spark, paths, content=True), methods, decoders), "decoded")
    records = stored(parse_lines(lines_of(rows), config, long=True), "records")
    return tabled(records), rows.where("error IS NOT NULL").select("source", "error")


def cascade(files: DataFrame, methods: Sequence[str] = CASCADE, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """(source, page, line_no, method, cells, error) of files (path, content): the first method that finds rows in the text layer; where there is no text
    layer or no method finds any, by OCR (method ocr). A file in which nothing is found is one row with its error."""
    text = stored(decoded(files, ("text",), decoders), "text-layer")
    found = with_ocr(lines_of(text), None, methods)
    left = files.join(found.select(F.col("source").alias("path")).distinct(), "path", "left_anti")
    seen = stored(decoded(left, ("ocr",), decoders), "ocr")
    found = with_ocr(lines_of(text), lines_of(seen), methods).withColumn("error", F.lit(None).cast("string"))
    errors = seen.join(found.select("source").distinct(), "source", "left_anti").groupBy("source").agg(F.coalesce(F.min("error"), F.lit("no rows")).alias("error"))
    return found.unionByName(errors, allowMissingColumns=True)


def with_ocr(lines: DataFrame, ocr: DataFrame | None = None, methods: Sequence[str] = CASCADE) -> DataFrame:
    """by_method on the lines of the text layer, and for sources in which it finds none, the lines that OCR read, as rows of one cell."""
    found = by_method(lines, methods)
    if ocr is None:
        return found
    read = longer_than(ocr).join(found.select("source").distinct(), "source", "left_anti")
    return found.unionByName(read.select("source", "page", "line_no", F.lit("ocr").alias("method"), F.array("line").alias("cells")))


def extract_census(lines: DataFrame, preset: str = "r_complete", numeric: Sequence[str] | None = None) -> DataFrame:
    """A census preset's table without repeats, in factor order, without rows that have no number."""
    rows = parse_census(lines, preset)
    return cleaned(rows.drop("source", "line_no"), numeric or PRESETS[preset].names)


def batch(
    spark: SparkSession, paths: Sequence[str], output_dir: str, config: Config | None = None, methods: Sequence[str] = ("text", "ocr"), decoders: dict[str, Decoder] | None = None
) -> DataFrame:
    """A file of its own for each input, and (input, output, status); a failure is that input's status.

    All inputs are decoded and parsed by one job each; what is left for each input is to write its rows, one writer a file."""
    from lectern.sinks.files import export

    files = {path: named_files(spark, path) for path in paths}
    there = sorted({f for found in files.values() for f in found})
    if there:
        rows = stored(decoded(listed(spark, there, content=True), methods, decoders), "decoded")
        records = stored(parse_lines(lines_of(rows), config, long=True), "records")
        errors = dict(rows.where("error IS NOT NULL").groupBy("source").agg(F.min("error")).collect())  # a row a failed input
    results = []
    for path, found in files.items():
        failed = [errors[f] for f in found if f in errors]
        if not found or failed:
            results.append((path, None, failed[0] if failed else "no such file"))
            continue
        try:
            out = export(tabled(records.where(F.col("source").isin(found))), config, Path(output_dir) / Path(path).stem)
            results.append((path, out or None, None if out else "no rows"))
        except Exception as e:  # noqa: BLE001  one input's failure is its status
            results.append((path, None, str(e).split("\n")[0][:300]))
    return statuses(spark.createDataFrame(results, "input string, output string, error string"))
