"""Queries over one source that holds all lines: scans by blocks, against SQL windows over the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import lines as L
from lectern.operators.package import KEYWORDS, paired
from lectern.operators.universal import with_style
from lectern.queries.render import table

Spark = SparkSession
LINES_A_PAGE = 50


def order_lines(spark: Spark, sf: str) -> DataFrame:
    """All orders as the lines of one source, fifty keys a page."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    line = F.when(key % 97 == 0, F.concat(F.lit("DISTRICT "), "o_custkey")).when(key % 13 == 0, F.concat_ws(" ", F.lit("ALL"), "o_custkey", "o_orderstatus")).otherwise(F.concat_ws(" ", "o_orderpriority", "o_custkey"))
    return o.select(F.lit("orders").alias("source"), F.floor(key / LINES_A_PAGE).cast("int").alias("page"), (key % LINES_A_PAGE).cast("int").alias("line_no"), line.alias("line"), key.cast("long").alias("key"))


def one_source_context(spark: Spark, sf: str) -> DataFrame:
    """The region and, since the latest region, the section of each line, and the line after it."""
    rows = order_lines(spark, sf)
    line = F.col("line")
    region = F.when(line.startswith("DISTRICT"), line)
    rows = L.carried_all(rows, {"region": region, "section": L.since_reset(F.when(line.startswith("ALL"), line), region.isNotNull())}, long=True)
    return L.with_next(rows.withColumn("section", F.col("section")["value"]), "following", long=True).select("key", "region", "section", "following")


def one_source_pairs(spark: Spark, sf: str) -> DataFrame:
    """Lines with a census keyword, each with the next one that counts."""
    return paired(order_lines(spark, sf), KEYWORDS["census"], long=True).select("key", "line", "data_line")


def one_source_firsts(spark: Spark, sf: str) -> DataFrame:
    """What comes after the first line of a district, of lines from the first that is no order of low priority; and whether numbers are French by the first twenty."""
    rows = L.from_first(order_lines(spark, sf), ~F.col("line").startswith("5-LOW"), long=True)
    return with_style(L.after_marker(rows, "^DISTRICT", long=True), long=True).select("key", "french")


QUERIES = {f.__name__: f for f in (one_source_context, one_source_pairs, one_source_firsts)}

_LINES = """l AS (SELECT o_orderkey::BIGINT AS key, CASE WHEN o_orderkey % 97 = 0 THEN 'DISTRICT ' || o_custkey WHEN o_orderkey % 13 = 0 THEN 'ALL ' || o_custkey || ' ' || o_orderstatus ELSE o_orderpriority || ' ' || o_custkey END AS line FROM orders)"""
_KEYWORD = " OR ".join(f"contains(upper(line), '{k.upper()}')" for k in KEYWORDS["census"])

ORACLE_SQL = {
    "one_source_context": f"""WITH {_LINES}, r AS (SELECT *, last_value(CASE WHEN line LIKE 'DISTRICT%' THEN line END IGNORE NULLS) OVER w AS region,
          count(CASE WHEN line LIKE 'DISTRICT%' THEN 1 END) OVER w AS part, coalesce(lead(line) OVER (ORDER BY key), '') AS following FROM l WINDOW w AS (ORDER BY key ROWS UNBOUNDED PRECEDING))
        SELECT key, region, last_value(CASE WHEN line LIKE 'ALL%' THEN line END IGNORE NULLS) OVER (PARTITION BY part ORDER BY key ROWS UNBOUNDED PRECEDING) AS section, following FROM r""",
    "one_source_pairs": f"""WITH {_LINES}, m AS (SELECT *, {_KEYWORD} AS named FROM l WHERE contains(upper(line), 'ALL') OR {_KEYWORD}),
        n AS (SELECT *, coalesce(lead(line) OVER (ORDER BY key), '') AS data_line FROM m) SELECT key, line, data_line FROM n WHERE named""",
    "one_source_firsts": f"""WITH {_LINES}, f AS (SELECT * FROM l WHERE key >= (SELECT min(key) FROM l WHERE line NOT LIKE '5-LOW%')), a AS (SELECT * FROM f WHERE key > (SELECT min(key) FROM f WHERE line LIKE 'DISTRICT%')),
        t AS (SELECT line FROM a ORDER BY key LIMIT 20) SELECT key, (SELECT sum(len(regexp_extract_all(line, '\\d{{1,3}},\\d{{3}}'))) FROM t) < 3 AS french FROM a""",
}
