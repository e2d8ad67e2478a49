"""Queries of listings, fetches, layout items, settings, and of tables that are sorted, renamed and written in every format."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators import cleaning as C
from lectern.operators import profile as P
from lectern.operators.census import parse_census
from lectern.plans.storage import shared_dir
from lectern.queries.render import MEASURES_SQL, SECTION, SEX, census_lines, table
from lectern.sinks.files import export, export_all
from lectern.sources.fetch import fetched
from lectern.sources.files import listed
from lectern.sources.lines import lines_from_results, reading_order
from lectern.sources.workbook import WorkbookSource

Spark = SparkSession


def file_listing(spark: Spark, sf: str) -> DataFrame:
    """The tables by their own files under a pattern, with suffixes in any case; a table is one file, or a folder of them."""
    files = listed(spark, f"{sf}/*.parquet", ("PARQUET", "pdf"))
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet(/[^/]*)?$", 1)
    return files.groupBy(name.alias("name")).agg(F.max(F.col("length") > 0).alias("has_bytes"))


def fetch_statuses(spark: Spark, sf: str) -> DataFrame:
    """All pages' urls, host by host, from a server of our own: found, missing and failing by the url's length."""

    def served(url: str, timeout: float) -> tuple[int, bytes]:
        n = len(url)
        return (200, url.encode()) if n % 3 == 0 else (404, b"") if n % 3 == 1 else (500, b"")

    rows = fetched(table(spark, sf, "pages").select("url"), retries=3, delay=0, fetch=served)
    return rows.select("url", "host", *[F.col(c).cast("bigint").alias(c) for c in ("turn", "status", "attempts")], F.decode("content", "UTF-8").alias("content"), "error")


def layout_order(spark: Spark, sf: str) -> DataFrame:
    """Items of a page, an order, by the height of their first corner; items without one come last, equals by text."""
    corner = F.array(F.array(F.col("l_partkey").cast("double"), F.floor(F.col("l_quantity") / 10).cast("double")))
    text = F.when(F.col("l_returnflag") != "A", F.concat_ws(" ", F.col("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), F.lit(1).alias("page"), text.alias("text"), F.when(F.col("l_linenumber") % 4 != 3, corner).alias("bbox"))
    return reading_order(items).select("source", F.col("line_no").cast("bigint").alias("line_no"), "line")


def result_lines(spark: Spark, sf: str) -> DataFrame:
    """OCR results: failed ones are skipped, blank lines too."""
    o = table(spark, sf, "orders")
    lines = F.array(F.col("o_orderpriority"), F.lit("  "), F.col("o_orderstatus"), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("odd"))
    results = o.select(F.col("o_orderkey").cast("string").alias("image_path"), lines.alias("lines"), F.when(F.col("o_orderstatus") == "P", "unreadable").alias("error"))
    return lines_from_results(results).select("source", F.col("line_no").cast("bigint").alias("line_no"), "line")


def renamed_numbers(spark: Spark, sf: str) -> DataFrame:
    """Columns under new names, numeric ones found by type, rows without any number gone; a column that isn't there is passed over."""
    c = table(spark, sf, "customer")
    rows = C.renamed(c.select(F.upper("c_mktsegment"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 2 > 0, F.floor("c_acctbal"))), ["SEGMENT", "NATION", "BALANCE"])
    rows = C.as_numbers(C.distinct(rows), [*C.numeric_columns(rows), "MISSING"])
    return C.without_empty(rows, ["NATION", "BALANCE", "MISSING"]).toDF("segment", "nation", "balance")


def memory_usage(spark: Spark, sf: str) -> DataFrame:
    return P.summary(table(spark, sf, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))).select("rows", "memory_usage")


def shifting_dashes(spark: Spark, sf: str) -> DataFrame:
    """The preset that leaves dashes out: what comes after them moves up, and rows with fewer than seven values go. Context is carried over many lines."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    tokens = F.concat_ws(" ", *[F.when((key + i) % 4 != 0, (F.col("o_custkey") + i).cast("string")).otherwise("—" if i % 2 else "-") for i in range(9)])
    label, section = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (SEX, SECTION))
    data = F.concat_ws(" ", F.coalesce(label[F.col("o_orderpriority")], F.lit("NONE")), tokens)
    line = F.when(key % 8 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(" District"))).when(key % 8 == 1, section[F.col("o_orderstatus")]).otherwise(data)
    lines = o.select(F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("source"), F.lit(1).alias("page"), key.alias("line_no"), line.alias("line"))
    rows = parse_census(lines, "r_complete", long=True)
    return rows.select("source", F.col("line_no").cast("bigint").alias("line_no"), *[F.col(c).alias(c.lower()) for c in rows.columns if c not in ("source", "line_no")])


def region_sort(spark: Spark, sf: str) -> DataFrame:
    """Rows by region (nulls last), section and sex, written by the dispatcher as JSON whatever the path's suffix; place is the record's place in the file."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    region = F.when(F.col("n_regionkey") > 1, F.col("n_name"))
    rows = rows.groupBy(region.alias("REGION"), F.col("c_mktsegment").alias("SECTION"), F.when(F.col("c_custkey") % 2 == 0, "MALE").otherwise("FEMALE").alias("SEX")).agg(F.count("*").alias("n"))
    path = export(C.sorted_by(rows, "REGION", "SECTION", "SEX"), Config(values={"export": {"format": "json"}}), f"{_new_dir(spark)}/sorted.csv")
    found = spark.read.schema("REGION string, SECTION string, SEX string, n long").json(path, multiLine=True)
    return found.select(F.monotonically_increasing_id().alias("place"), F.col("REGION").alias("region"), F.col("SECTION").alias("section"), F.col("SEX").alias("sex"), "n")


def _new_dir(spark: Spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}.out"


def _read(spark: Spark, kind: str, path: str, schema: str) -> DataFrame:
    """Rows of a written file, read by one task, in file order."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, escape='"', multiLine=True)
    return reader.json(path, multiLine=True) if kind == "json" else reader.format("workbook").load(path)


def export_formats(spark: Spark, sf: str) -> DataFrame:
    """A census by page, region, section and sex, in a file of each format under the path that the settings name."""
    rows = parse_census(census_lines(spark, sf, page_by_nation=True), "multipage").select("PAGE", "REGION", "SECTION", "SEX", "TOTAL", "MUSLIM")
    paths = export_all(C.sorted_by(rows, "PAGE", "REGION", "SECTION", "SEX"), Config(values={"export": {"output_dir": _new_dir(spark), "output_filename": "census"}}))
    found = None
    for kind, path in paths.items():
        own = _read(spark, kind, path, "PAGE long, REGION string, SECTION string, SEX string, TOTAL long, MUSLIM long")
        own = own.select(F.lit(kind).alias("format"), F.lit(Path(path).name).alias("file"), F.monotonically_increasing_id().alias("place"), *[F.col(c).alias(c.lower()) for c in own.columns])
        found = own if found is None else found.unionByName(own)
    return found


def settings_round_trip(spark: Spark, sf: str) -> DataFrame:
    """Settings at several depths, saved as YAML and read again over the defaults; what makes them unusable."""
    with tempfile.TemporaryDirectory() as d:
        first = Config(values={"ocr": {"preprocessing": {"resize_factor": 2}}})
        first.set("parsing", "data_format", "election")
        first.set("own", "deep", "est", "ключ")
        first.save(Path(d) / "settings.yaml")
        config = Config(Path(d) / "settings.yaml")
        missing = Config(Path(d) / "none.yaml")
    wrong = Config(values={"export": {"format": "pdf"}, "download": {"base_url": ""}})
    rows = {
        "resize_factor": config.get("ocr", "preprocessing", "resize_factor"),
        "interpolation": config.get("ocr", "preprocessing", "interpolation"),
        "deepest": config.get("own", "deep", "est"),
        "absent": config.get("own", "deep", "est", "more", default="none"),
        "keywords": len(config.keywords()),
        "default_format": missing.get("parsing", "data_format"),
        "problems": len(config.problems()),
        "wrong": ", ".join(x.split()[0] for x in wrong.problems()),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "name string, value string")


QUERIES = {f.__name__: f for f in (file_listing, fetch_statuses, layout_order, result_lines, renamed_numbers, memory_usage, shifting_dashes, region_sort, export_formats, settings_round_trip)}

_SEX = "CASE o_orderpriority WHEN '5-LOW' THEN 'ALL' WHEN '1-URGENT' THEN 'MALE' WHEN '2-HIGH' THEN 'FEMALE' WHEN '3-MEDIUM' THEN 'TRANSGENDER' END"
_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
_SHIFTED = ("total", "muslim", "christian", "hindu", "qadiani_ahmadi", "scheduled_castes", "others")

ORACLE_SQL = {
    "file_listing": f"SELECT unnest({list(_TABLES)!r}) AS name, true AS has_bytes",
    "fetch_statuses": r"""WITH u AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, length(url) % 3 AS k FROM pages WHERE url IS NOT NULL)
        SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY url) AS turn, CASE k WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 500 END::BIGINT AS status, CASE k WHEN 2 THEN 3 ELSE 1 END::BIGINT AS attempts, CASE k WHEN 0 THEN url END AS content, CASE k WHEN 1 THEN 'status 404' WHEN 2 THEN 'status 500' END AS error FROM u""",
    "layout_order": """WITH i AS (SELECT l_orderkey::VARCHAR AS source, l_shipdate || ' ' || l_linenumber AS line, CASE WHEN l_linenumber % 4 <> 3 THEN floor(l_quantity / 10) END AS top FROM lineitem WHERE l_returnflag <> 'A')
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY top NULLS LAST, line) - 1 AS line_no, line FROM i""",
    "result_lines": """WITH r AS (SELECT o_orderkey::VARCHAR AS source, [o_orderpriority, '  ', o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'odd' END] AS l FROM orders WHERE o_orderstatus <> 'P'),
        x AS (SELECT source, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM r) SELECT source, line_no, line FROM x WHERE trim(line) <> ''""",
    "renamed_numbers": """WITH r AS (SELECT DISTINCT upper(c_mktsegment) AS segment, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey::DOUBLE END AS nation, CASE WHEN c_custkey % 2 > 0 THEN floor(c_acctbal)::DOUBLE END AS balance FROM customer)
        SELECT * FROM r WHERE nation IS NOT NULL OR balance IS NOT NULL""",
    "memory_usage": """SELECT count(*) AS rows, sum(strlen('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"' || CASE WHEN n_regionkey > 0 THEN ',"n_regionkey":' || n_regionkey ELSE '' END || '}'))::BIGINT AS memory_usage FROM nation""",
    "shifting_dashes": f"""WITH l AS (SELECT *, 's' || (o_custkey % 5) AS source, CASE WHEN o_orderkey % 8 = 0 THEN o_custkey || ' District' END AS r,
          CASE WHEN o_orderkey % 8 = 1 THEN CASE o_orderstatus WHEN 'O' THEN 'OVERALL' WHEN 'F' THEN 'RURAL' ELSE 'URBAN' END END AS s FROM orders),
        c AS (SELECT *, last_value(r IGNORE NULLS) OVER w AS region, last_value(s IGNORE NULLS) OVER w AS section FROM l WINDOW w AS (PARTITION BY source ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)),
        v AS (SELECT *, {_SEX} AS sex, list_transform(list_filter(range(9), lambda i: (o_orderkey + i) % 4 <> 0), lambda i: o_custkey + i) AS k FROM c WHERE o_orderkey % 8 > 1)
        SELECT source, o_orderkey AS line_no, region, section, sex, {", ".join(f"k[{i + 1}]::BIGINT AS {n}" for i, n in enumerate(_SHIFTED))}, source AS source_image FROM v WHERE sex IS NOT NULL AND len(k) >= 7""",
    "region_sort": """WITH g AS (SELECT CASE WHEN n_regionkey > 1 THEN n_name END AS region, c_mktsegment AS section, CASE WHEN c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS sex, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
        SELECT row_number() OVER (ORDER BY region NULLS LAST, section NULLS LAST, sex) - 1 AS place, * FROM g""",
    "export_formats": f"""WITH {MEASURES_SQL}, r AS (SELECT n_nationkey + 1 AS page, n_name || ' DISTRICT' AS region, section, CASE sex WHEN 'ALL SEXES' THEN 'ALL' ELSE sex END AS sex, m0 AS total, m1 AS muslim FROM measures),
        f AS (SELECT unnest(['excel', 'csv', 'json']) AS format, unnest(['census.xlsx', 'census.csv', 'census.json']) AS file)
        SELECT f.format, f.file, row_number() OVER (PARTITION BY f.format ORDER BY page, region, section, sex) - 1 AS place, page::BIGINT AS page, region, section, sex, total, muslim FROM r CROSS JOIN f""",
    "settings_round_trip": """SELECT unnest(['resize_factor', 'interpolation', 'deepest', 'absent', 'keywords', 'default_format', 'problems', 'wrong']) AS name,
        unnest(['2', 'cubic', 'ключ', 'none', '6', 'census', '0', 'download.base_url, export.format']) AS value""",
}
