"""Tables of unknown layout: lines classified, number style detected, header chosen, cells typed, rows evened."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import cell, cell_text, regrouped
from lectern.functions.text import contains_any, count_any, count_char, count_matches, split_words
from lectern.operators.lines import carried_all, first_rows, in_order, since_reset
from lectern.operators.schema import evened, widest

#: Words that tell kinds of lines apart.
HEADER_WORDS = ("TABLE", "POPULATION", "COUNT", "AREA/", "REGION", "DISTRICT", "COLUMN", "VOTERS", "VOTES", "PERCENTAGE", "RELIGION", "CATEGORY")
SECTION_WORDS = ("OVERALL", "RURAL", "URBAN", "DISTRICT", "DIVISION", "CONSTITUENCY", "PROVINCE", "STATE", "COUNTY", "REGION")
COLUMN_WORDS = ("SEX", "TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "MALE", "FEMALE", "AREA", "COUNT", "VOTES", "VOTERS")
GENERIC_WORDS = ("TOTAL", "SEX", "GENDER", "AGE", "POPULATION", "MALE", "FEMALE", "VOTERS", "DISTRICT", "REGION", "AREA", "COUNT", "NUMBER")
REGION_WORDS = ("DISTRICT", "DIVISION")
SAMPLE_ROWS = 20


def counted(lines: DataFrame) -> DataFrame:
    """Pattern counts of each line."""
    line = F.col("line")
    return lines.withColumns(
        {
            "n_numbers": count_matches(line, r"(?U)\b\d{2,}[,\d]*\b"),
            "n_words": count_matches(line, r"(?U)\b[A-Za-z]{3,}\b"),
            "n_dashes": count_char(line, "-"),
            "n_commas": count_matches(line, r"\d{1,3},\d{3}"),
            "n_column_words": count_any(line, COLUMN_WORDS),
        }
    )


def classified(lines: DataFrame, long: bool = False) -> DataFrame:
    """kind (header, region, section, data or null), and region and section as they stand at the line.

    Headers come first, so that a district line is a header, not a region.
    """
    line = F.col("line")
    bare = F.col("n_numbers") == 0
    kind = (
        F.when(contains_any(line, HEADER_WORDS) & bare, "header")
        .when(contains_any(line, SECTION_WORDS) & bare, F.when(contains_any(line, REGION_WORDS), "region").otherwise("section"))
        .when((F.col("n_words") >= 1) & (~bare | (F.col("n_dashes") >= 3)), "data")
    )
    rows = counted(lines).withColumn("kind", kind)
    is_region = F.col("kind") == "region"
    section = since_reset(F.when(F.col("kind") == "section", line), is_region)
    rows = carried_all(rows, {"region": F.when(is_region, line), "section": section}, long=long)
    return rows.withColumn("section", F.col("section")["value"])


def with_style(lines: DataFrame, long: bool = False) -> DataFrame:
    """french: whether a source's first 20 lines hold fewer than three numbers with comma groups."""
    if not long:
        numbered = lines.withColumn("_row", F.row_number().over(in_order()))
        commas = F.sum(F.when(F.col("_row") <= SAMPLE_ROWS, count_matches(F.col("line"), r"\d{1,3},\d{3}"))).over(Window.partitionBy("source"))
        return numbered.withColumn("french", F.coalesce(commas, F.lit(0)) < 3).drop("_row")
    commas = F.sum(count_matches(F.col("line"), r"\d{1,3},\d{3}"))
    own = first_rows(lines, SAMPLE_ROWS).groupBy(F.struct("source").alias("_source")).agg((F.coalesce(commas, F.lit(0)) < 3).alias("french"))
    return lines.withColumn("_source", F.struct("source")).join(own, "_source").drop("_source")  # a row a source


def typed(line: Column, french: Column) -> Column:
    """The line's tokens as typed cells."""
    return regrouped(F.transform(split_words(line), lambda x: cell(x)), french)


def chosen_headers(rows: DataFrame) -> DataFrame:
    """Each source's first header line with three column words or more (null if none)."""
    good = (F.col("kind") == "header") & (F.col("n_column_words") >= 3)
    return rows.groupBy("source").agg(F.min_by(F.when(good, F.col("line")), F.when(good, F.struct("page", "line_no"))).alias("header"))


def header_names(header: str) -> list[str]:
    """Column names of a header line: cells between wide gaps, or words; a short part with a slash goes with the next one."""
    parts = re.split(r"\s{2,}", header)
    if len(parts) < 5:
        parts = header.split()
    names: list[str] = []
    glue = False
    for k, part in enumerate(parts):
        if glue:
            names[-1] += part
            glue = False
        else:
            names.append(part)
            glue = len(part) <= 6 and "/" in part and k + 1 < len(parts)
    return [n.strip() for n in names if n.strip()]


def universal_rows(lines: DataFrame, long: bool = False) -> DataFrame:
    """(source, page, line_no, cells): region, section and typed cells of each data line, as text."""
    rows = with_style(classified(lines, long), long).where(F.col("kind") == "data")
    cells = F.transform(typed(F.col("line"), F.col("french")), lambda c: cell_text(c))
    context = F.array(F.coalesce("region", F.lit("")), F.coalesce("section", F.lit("")))
    return rows.select("source", "page", "line_no", F.concat(context, cells).alias("cells"))


def universal_table(lines: DataFrame, prefix: str = "Col_") -> DataFrame:
    """One table of all data lines, named by the first good header there is (by source), else by number; rows are distinct."""
    rows = universal_rows(lines)
    header = chosen_headers(classified(lines)).where(F.col("header").isNotNull()).agg(F.min_by("header", "source")).first()[0]
    width = widest(rows)
    names = ["REGION", "SECTION", *(header_names(header) if header else [f"Column_{i + 1}" for i in range(max(0, width - 2))])]
    return evened(rows, names, width, prefix=prefix).dropDuplicates()


def structured(rows: DataFrame) -> DataFrame:
    """(source, page, row_no, cells) with kind: header if words outnumber numbers or a header word occurs, else data if there are two numbers."""
    text = F.array_join(F.filter("cells", lambda c: c.isNotNull() & (c != "")), " ")
    n_numbers, n_words = count_matches(text, r"\d{2,}"), count_matches(text, "[A-Za-z]{3,}")
    header = ((n_words > n_numbers) & (n_words > 0)) | contains_any(text, GENERIC_WORDS)
    return rows.withColumns({"n_words": n_words, "n_numbers": n_numbers, "kind": F.when(header, "header").when(n_numbers >= 2, "data")})


def exploded_numbers(cells: Column) -> Column:
    """Each cell as all the whole numbers in it, itself if it has none, null if empty; cells fan out, text beside numbers is lost."""

    def values(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(r"(\d[\d,]*)"))
        numbers = F.transform(found, lambda x: F.coalesce(F.replace(x, F.lit(","), F.lit("")).try_cast("bigint").cast("string"), x))
        text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        return F.when(c.isNull() | (c == ""), F.array(F.lit(None).cast("string"))).when(F.size(found) > 0, numbers).otherwise(F.array(text))

    return F.flatten(F.transform(cells, values))


def generic_rows(rows: DataFrame) -> DataFrame:
    data = structured(rows).where(F.col("kind") == "data").withColumn("cells", exploded_numbers(F.col("cells")))
    return data.where(F.exists("cells", lambda c: c.isNotNull())).select("source", "page", "row_no", "cells")


def generic_table(rows: DataFrame, prefix: str = "Column_") -> DataFrame:
    """One table of all data rows, named by the first header row; rows are distinct."""
    data = generic_rows(rows)
    header = structured(rows).where(F.col("kind") == "header").agg(F.min_by("cells", F.struct("source", "page", "row_no"))).first()[0]
    names = [str(c) if c else f"{prefix}{i + 1}" for i, c in enumerate(header)] if header else []
    return evened(data, names, widest(data), prefix=prefix).dropDuplicates()
