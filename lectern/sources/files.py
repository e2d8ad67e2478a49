"""Files: listings by kind, and names made from patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import zero_padded
from lectern.plans.storage import stored

PDF = ("pdf",)
#: Lines of a csv file whose rows are numbered together.
STRETCH = 1 << 14
IMAGES = ("jpg", "jpeg", "png")


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _statuses(spark: SparkSession, path: str) -> list:
    """The files that a path, folder or pattern names, as the file system lists them: no content is read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(where) or []:
        found += [x for x in fs.listStatus(status.getPath()) if x.isFile()] if status.isDirectory() else [status]
    return found


def named_files(spark: SparkSession, path: str) -> list[str]:
    """The qualified paths of the files that a path, folder or pattern names, as they stand in listings."""
    return sorted(x.getPath().toString() for x in _statuses(spark, path))


def listed(spark: SparkSession, path: str | Sequence[str], suffixes: Sequence[str] = PDF, content: bool = False) -> DataFrame:
    """path, modificationTime and length (and content) of files with these suffixes in any case, sorted by path. Content isn't read unless asked for.
    Files of no bytes are there too, which readers of content leave out."""
    glob = "*.{" + ",".join(_any_case(s) for s in suffixes) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", False)
    paths = [path] if isinstance(path, str) else list(path)
    rows = reader.load(paths)
    kind = "(?i)\\.(" + "|".join(map(re.escape, suffixes)) + ")$"
    rows = rows.where(F.col("path").rlike(kind) & (F.col("length") > 0)).select("path", "modificationTime", "length", *["content"] * content)
    empty = {x.getPath().toString(): x.getModificationTime() for p in paths for x in _statuses(spark, p) if x.getLen() == 0}
    if empty:
        none = spark.createDataFrame(list(empty.items()), "path string, ms long").where(F.col("path").rlike(kind))
        none = none.select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), *[F.lit(b"").alias("content")] * content)
        rows = rows.unionByName(none)
    return rows.orderBy("path")


def url_table(spark: SparkSession, base_url: str, file_pattern: str, first: int, last: int, data_type: str = "") -> DataFrame:
    """code (three digits at least), name and url for each number from first to last, both included."""
    code = zero_padded(F.col("id"), 3)
    name = F.lit(file_pattern)
    name = F.replace(F.replace(name, F.lit("{district_code}"), F.col("code")), F.lit("{data_type}"), F.lit(data_type))
    rows = spark.range(first, last + 1).withColumn("code", code).withColumn("name", name)
    return rows.select("id", "code", "name", F.concat(F.lit(base_url), F.col("name")).alias("url"))


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows of a scan of one file with their place, from 0: each partition's rows are numbered, and a row a partition says how many are before it."""
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    sizes = rows.groupBy(F.shiftright("place", 33).alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    starts = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1)])
    return rows.withColumn("place", F.get(starts, F.shiftright("place", 33).cast("int")) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))


def json_records(spark: SparkSession, path: str, schema: str, indent: int = 2) -> DataFrame:
    """place and the fields of the records of one JSON file as the sink writes it, by many tasks: a line feed, the indent and a brace end a record
    and stand nowhere else, as values escape line feeds and what is nested stands deeper."""
    end = "\n" + " " * indent + "}"
    text = spark.read.option("lineSep", end).text(path).where(F.col("value").contains("{"))
    record = F.from_json(F.concat(F.regexp_replace("value", r"^[\[,]", ""), F.lit("}")), schema)
    return in_file_order(text).select("place", record.alias("r")).select("place", "r.*")


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """place and the fields of the rows of one csv file with a header, by many tasks. A line with an odd number of quotes opens or closes a cell that holds a line feed: if there
    are none, each line is a row. If there are, lines get the number of the row that they belong to by sums over stretches of lines, and are joined."""
    lines = spark.read.option("lineSep", "\n").text(path)
    odd = ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("long")
    if lines.where(odd == 1).isEmpty():
        rows = in_file_order(lines)
    else:
        marked = stored(in_file_order(lines).withColumns({"_odd": odd, "_at": F.floor(F.col("place") / STRETCH)}), "csv-lines")
        own = Window.partitionBy("_at").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        past = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
        opened = marked.groupBy("_at").agg(F.sum("_odd").alias("_n")).select("_at", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_opened"))
        marked = marked.withColumn("_own", F.coalesce(F.sum("_odd").over(own), F.lit(0))).join(opened, "_at")
        marked = stored(marked.select("value", "place", "_at", ((F.col("_own") + F.col("_opened")) % 2 == 0).cast("long").alias("_first")), "csv-rows")
        begun = marked.groupBy("_at").agg(F.sum("_first").alias("_n")).select("_at", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_begun"))
        upto = Window.partitionBy("_at").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        row = marked.withColumn("_own", F.sum("_first").over(upto)).join(begun, "_at").groupBy((F.col("_own") + F.col("_begun") - 1).alias("place"))
        joined = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
        rows = row.agg(F.array_join(joined, "\n").alias("value"))
    record = F.from_csv(F.regexp_replace("value", "\r$", ""), F.lit(schema), {"escape": '"', "multiLine": "true"})
    return rows.where("place > 0").select((F.col("place") - 1).alias("place"), record.alias("r")).select("place", "r.*")


def filesystem(path: str):
    """The file system of a path or URI, for Python in tasks and commits, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
