"""Lines from text columns and text files, always with their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import split_wide


def lines_from_text(df: DataFrame, key: str | Column, text: str = "text", page_break: str | None = "\f", keep: Sequence[str] = ()) -> DataFrame:
    """(source, page, line_no, line), and columns to keep: pages from 1, lines of a page from 0. A null text has no lines. Without a page break all is page 1."""
    key = F.col(key) if isinstance(key, str) else key
    rows = df.select(key.cast("string").alias("source"), F.col(text).alias("_text"), *keep).where(F.col("_text").isNotNull())
    if page_break is None:
        pages = rows.select("source", F.lit(1).alias("page"), "_text", *keep)
    else:
        pages = rows.select("source", F.posexplode(F.split("_text", page_break)).alias("page", "_text"), *keep).withColumn("page", F.col("page") + 1)
    return pages.select("source", "page", F.posexplode(F.split("_text", "\r?\n")).alias("line_no", "line"), *keep)


def lines_from_path(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, each file a source."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")
    return lines_from_text(files, "path", "value")


def lines_from_results(results: DataFrame) -> DataFrame:
    """Lines of OCR results (image_path, lines, error); failed ones are left out, blank lines too."""
    good = results.where("error IS NULL") if "error" in results.columns else results
    rows = good.select(F.col("image_path").alias("source"), F.lit(1).alias("page"), F.posexplode("lines").alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def cells_from_lines(lines: DataFrame) -> DataFrame:
    """Each line as cells between gaps of two or more spaces."""
    return lines.withColumn("cells", split_wide(F.col("line")))


def single_cells(lines: DataFrame) -> DataFrame:
    return lines.withColumn("cells", F.array("line"))


def reading_order(items: DataFrame) -> DataFrame:
    """Layout items (source, page, text, bbox) as lines by the height of their first corner."""
    from pyspark.sql import Window

    top = F.get(F.get("bbox", F.lit(0)), F.lit(1))
    order = Window.partitionBy("source", "page").orderBy(top.asc_nulls_last(), "text")
    return items.where(F.col("text").isNotNull()).select("source", "page", (F.row_number().over(order) - 1).alias("line_no"), F.col("text").alias("line"))
