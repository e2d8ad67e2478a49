"""Queries of cleaning, profiling, analytics, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import stem, zero_padded
from lectern.operators import analytics as A
from lectern.operators import cleaning as C
from lectern.operators import profile as P
from lectern.operators.schema import evened, union_ragged
from lectern.plans.storage import shared_dir
from lectern.queries.render import table
from lectern.sinks.files import to_csv, to_excel, to_json
from lectern.sources.files import csv_records, in_file_order, json_records, url_table
from lectern.sources.workbook import WorkbookSource

Spark = SparkSession


def distinct_rows(spark: Spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return C.distinct(docs.select("text", "lang")).groupBy("lang").agg(F.count("*").alias("n"))


def distinct_first_seen(spark: Spark, sf: str) -> DataFrame:
    return C.distinct_in_order(table(spark, sf, "events").select("event_type", F.pmod("user_id", F.lit(50)).alias("bucket"), "event_id"), "event_id")


def _sections(spark: Spark, sf: str) -> DataFrame:
    section = F.when(F.col("o_orderstatus") == "O", "OVERALL").when(F.col("o_orderstatus") == "F", "RURAL").when(F.col("o_orderpriority") != "5-LOW", "URBAN")
    return table(spark, sf, "orders").groupBy(section.alias("SECTION"), F.upper(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("SEX")).agg(F.count("*").alias("n"))


FACTORS = {"SECTION": ("OVERALL", "RURAL", "URBAN"), "SEX": ("LOW", "URGENT", "HIGH")}


def factor_sort(spark: Spark, sf: str) -> DataFrame:
    """The order as places."""
    rows = C.placed(_sections(spark, sf), C.level("SECTION", FACTORS["SECTION"]), C.level("SEX", FACTORS["SEX"]), F.col("SEX"))
    return rows.select(F.coalesce("SECTION", F.lit("?")).alias("section"), F.col("SEX").alias("sex"), "n", F.col("place").cast("int").alias("place"))


def order_places(spark: Spark, sf: str) -> DataFrame:
    """Each line of an order and its place among all, by price downwards, quantity and key; prices repeat."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("price"))
    return C.placed(rows, F.col("price").desc(), F.col("key"), F.col("line"))


def drop_all_null(spark: Spark, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return C.without_empty(rows, ["quality", "toxic"])


def numeric_cast(spark: Spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("d"))).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("value"))
    return C.as_numbers(rows, ["value"])


def _labelled(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")


def null_counts(spark: Spark, sf: str) -> DataFrame:
    return P.null_counts(_labelled(spark, sf)).toDF("name", "n")


def completeness(spark: Spark, sf: str) -> DataFrame:
    return P.completeness(_labelled(spark, sf)).withColumn("percent", F.round("percent", 4))


def column_profile(spark: Spark, sf: str) -> DataFrame:
    return P.column_info(_labelled(spark, sf)).drop("Type").toDF("name", "non_null", "nulls", "uniques")


def describe_numeric(spark: Spark, sf: str) -> DataFrame:
    rows = P.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])
    return rows.select(F.col("Column").alias("name"), "count", *[F.round(F.col(f"`{c}`"), 3).alias(n) for c, n in (("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "q1"), ("50%", "q2"), ("75%", "q3"), ("max", "max"))])


def confidence_stats(spark: Spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("image_path"), F.when(F.col("event_type") == "error", -1).otherwise(F.floor("value")).alias("conf"))
    return P.confidence(e).select("image_path", *[F.round(c, 4).alias(c) for c in ("mean", "min", "max", "std")])


def summary_stats(spark: Spark, sf: str) -> DataFrame:
    s = P.summary(_labelled(spark, sf))
    return s.select("rows", "columns", F.array_join("column_names", ",").alias("names"), F.try_element_at("null_counts", F.lit("quality")).alias("quality_nulls"), F.size("null_counts").alias("with_nulls"))


def group_sum_pct(spark: Spark, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("total"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity").cast("bigint")).alias("discounted"), F.when(F.col("l_tax") < 0, 1).alias("never"))
    return A.group_shares(li, ["l_returnflag", "l_linestatus"], "total", ["discounted", "never"])


def pct_round(spark: Spark, sf: str) -> DataFrame:
    o = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("part"), F.pmod("p_partkey", F.lit(9)).alias("total"))
    return A.with_shares(o, "total", ["part"]).select("p_partkey", F.col("part_PCT").alias("pct"))


def filter_select_sort(spark: Spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 1000")
    return o.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")


#: The segments of customers, and one that none has.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")


def unpivot_positive(spark: Spark, sf: str) -> DataFrame:
    ps = table(spark, sf, "customer").groupBy("c_nationkey").pivot("c_mktsegment", list(SEGMENTS)).agg(F.count("c_custkey"))
    return A.unpivoted(ps, ["c_nationkey"], list(SEGMENTS), "segment", "customers", positive=True)


def top_n_preview(spark: Spark, sf: str) -> DataFrame:
    sums = A.group_sums(table(spark, sf, "orders").select("o_custkey", F.floor("o_totalprice").alias("price")), ["o_custkey"], ["price"])
    return A.top(sums, 10, "price", "o_custkey")


def subtotal_levels(spark: Spark, sf: str) -> DataFrame:
    """Each level of section and sex, with its totals over the other."""
    o = table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return o.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("section"), F.coalesce("o_orderpriority", F.lit("ALL")).alias("sex"), "n", "level")


def union_ragged_tables(spark: Spark, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return union_ragged(a, b)


def ragged_rows(spark: Spark, sf: str) -> DataFrame:
    """Rows of one to five cells as columns, names for the first two."""
    rows = table(spark, sf, "part").select("p_partkey", F.slice(F.array(*[F.concat(F.lit(f"c{i}-"), F.col("p_size").cast("string")) for i in range(5)]), F.lit(1), F.pmod("p_partkey", F.lit(5)) + 1).alias("cells"))
    return evened(rows, ["first", "second"], 5, keep=["p_partkey"])


def batch_status(spark: Spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("input"), F.concat(F.lit("out/"), F.col("o_orderkey").cast("string")).alias("output"), F.when(F.col("o_orderstatus") == "P", "no rows").alias("error"))
    return A.status_counts(A.statuses(o))


def path_parts(spark: Spark, sf: str) -> DataFrame:
    o = table(spark, sf, "nation")
    return o.select("n_nationkey", stem(F.concat(F.lit("/data/in.d/"), "n_name", F.lit(".v2.pdf"))).alias("stem"), zero_padded(F.col("n_nationkey") * 100, 3).alias("code"))


def url_pattern(spark: Spark, sf: str) -> DataFrame:
    return url_table(spark, "https://example.org/files/", "{district_code}{data_type}.pdf", 1, 135, "09").select("code", "url")


def relational_join(spark: Spark, sf: str) -> DataFrame:
    """What tables from several documents are joined for: sums by region, semi and anti joins by a list."""
    customer, nation, region, orders = (table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    listed = region.where("r_name <> 'ASIA'").select("r_regionkey")
    rows = nation.join(listed, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").join(customer, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(F.floor("o_totalprice")).cast("bigint").alias("price"))


def _written(spark: Spark, sf: str, sink) -> str:
    """Orders as one file, in descending order of their key, with what formats must quote and gaps."""
    name = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('" <&> é'))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), name.alias("name"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("customer"))
    return sink(rows.repartition("key").orderBy(F.desc("key")), f"{shared_dir(spark)}/{uuid.uuid4().hex}.out/orders")


_FILE = "key long, name string, customer long"


def csv_round_trip(spark: Spark, sf: str) -> DataFrame:
    return csv_records(spark, _written(spark, sf, to_csv), _FILE)


def json_round_trip(spark: Spark, sf: str) -> DataFrame:
    return json_records(spark, _written(spark, sf, to_json), _FILE)


def excel_round_trip(spark: Spark, sf: str) -> DataFrame:
    """A sheet is a task; places go on from one to the next."""
    spark.dataSource.register(WorkbookSource)
    return in_file_order(spark.read.format("workbook").schema(_FILE).load(_written(spark, sf, to_excel))).select("place", "key", "name", "customer")


QUERIES = {
    f.__name__.removesuffix("_tables"): f
    for f in (
        distinct_rows, distinct_first_seen, factor_sort, order_places, drop_all_null, numeric_cast, null_counts, completeness, column_profile, describe_numeric, confidence_stats, summary_stats,
        group_sum_pct, pct_round, filter_select_sort, unpivot_positive, top_n_preview, subtotal_levels, union_ragged_tables, ragged_rows, batch_status, path_parts, url_pattern, relational_join,
        csv_round_trip, json_round_trip, excel_round_trip,
    )
}

_LABELLED = "labelled AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_ORDERS = """SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place, o_orderkey::BIGINT AS key, o_orderpriority || ', "' || o_orderstatus || '" <&> é' AS name,
        CASE WHEN o_custkey % 3 > 0 THEN o_custkey END::BIGINT AS customer FROM orders"""


def _described(column: str) -> str:
    x = f"{column}::DOUBLE"
    q = lambda p: f"round(quantile_cont({x}, {p}), 3)"
    return f"SELECT '{column}' AS name, count({column}) AS count, round(avg({x}), 3) AS mean, round(stddev_samp({x}), 3) AS std, min({x}) AS min, {q(0.25)} AS q1, {q(0.5)} AS q2, {q(0.75)} AS q3, max({x}) AS max FROM lineitem"


ORACLE_SQL = {
    "distinct_rows": "SELECT lang, count(*) AS n FROM (SELECT DISTINCT text, lang FROM documents) GROUP BY lang",
    "distinct_first_seen": "SELECT event_type, user_id % 50 AS bucket, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "factor_sort": """WITH s AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'OVERALL' WHEN o_orderstatus = 'F' THEN 'RURAL' WHEN o_orderpriority <> '5-LOW' THEN 'URBAN' END AS section, upper(split_part(o_orderpriority, '-', 2)) AS sex FROM orders),
        g AS (SELECT section, sex, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT coalesce(section, '?') AS section, sex, n, row_number() OVER (ORDER BY CASE section WHEN 'OVERALL' THEN 1 WHEN 'RURAL' THEN 2 WHEN 'URBAN' THEN 3 ELSE 4 END, CASE sex WHEN 'LOW' THEN 1 WHEN 'URGENT' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END, sex)::INTEGER AS place FROM g""",
    "drop_all_null": f"WITH {_LABELLED} SELECT doc_id, quality, toxic FROM labelled WHERE quality IS NOT NULL OR toxic IS NOT NULL",
    "numeric_cast": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::DOUBLE END AS value FROM orders",
    "null_counts": f"WITH {_LABELLED}, n AS (SELECT 'quality' AS name, count(*) - count(quality) AS n FROM labelled UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM labelled UNION ALL SELECT 'lang', count(*) - count(lang) FROM labelled UNION ALL SELECT 'source', count(*) - count(source) FROM labelled) SELECT * FROM n WHERE n > 0",
    "completeness": f"WITH {_LABELLED}, n AS (SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, count(doc_id) + count(lang) + count(source) + count(quality) + count(toxic) AS n_full FROM labelled) SELECT n_rows, n_columns, n_full, round(n_full * 100.0 / (n_rows * 5), 4)::DOUBLE AS percent FROM n",
    "column_profile": f"WITH {_LABELLED} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS uniques FROM labelled" for c in ("doc_id", "lang", "source", "quality", "toxic")),
    "order_places": "WITH r AS (SELECT l_orderkey AS key, l_linenumber AS line, floor(l_extendedprice / 100)::BIGINT AS price FROM lineitem) SELECT *, row_number() OVER (ORDER BY price DESC, key, line) AS place FROM r",
    "describe_numeric": " UNION ALL ".join(map(_described, ("l_quantity", "l_extendedprice", "l_linenumber"))),
    "confidence_stats": """WITH c AS (SELECT user_id::VARCHAR AS image_path, CASE WHEN event_type = 'error' THEN NULL ELSE floor(value) END AS conf FROM events)
        SELECT image_path, coalesce(round(avg(conf), 4), 0)::DOUBLE AS mean, coalesce(min(conf), 0)::DOUBLE AS min, coalesce(max(conf), 0)::DOUBLE AS max, coalesce(round(stddev_pop(conf), 4), 0)::DOUBLE AS std FROM (SELECT image_path, nullif(conf, -1) AS conf FROM c) GROUP BY 1""",
    "summary_stats": f"WITH {_LABELLED} SELECT count(*) AS rows, 5::INTEGER AS columns, 'doc_id,lang,source,quality,toxic' AS names, count(*) - count(quality) AS quality_nulls, ((count(quality) < count(*))::INT + (count(toxic) < count(*))::INT + (count(lang) < count(*))::INT + (count(source) < count(*))::INT)::INTEGER AS with_nulls FROM labelled",
    "group_sum_pct": """WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS total, coalesce(sum(CASE WHEN l_discount > 0.05 THEN l_quantity::BIGINT END), 0)::BIGINT AS discounted FROM lineitem GROUP BY 1, 2)
        SELECT l_returnflag, l_linestatus, total, discounted, 0::BIGINT AS never, round_even(discounted::DOUBLE / total * 100, 2) AS "discounted_PCT", 0::DOUBLE AS "never_PCT" FROM s""",
    "pct_round": "SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN round_even(p_size::DOUBLE / (p_partkey % 9)::DOUBLE * 100, 2) END AS pct FROM part",
    "filter_select_sort": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 1000",
    "unpivot_positive": "SELECT c_nationkey, c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1, 2",
    "top_n_preview": "SELECT o_custkey, sum(floor(o_totalprice))::BIGINT AS price FROM orders GROUP BY 1 ORDER BY price DESC, o_custkey DESC LIMIT 10",
    "subtotal_levels": "SELECT coalesce(o_orderstatus, 'ALL') AS section, coalesce(o_orderpriority, 'ALL') AS sex, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "union_ragged": "SELECT s_suppkey AS key, s_name AS name, NULL::INTEGER AS size FROM supplier UNION ALL SELECT p_partkey, NULL, p_size FROM part",
    "ragged_rows": "SELECT p_partkey, 'c0-' || p_size AS first, " + ", ".join(f"CASE WHEN p_partkey % 5 >= {i} THEN 'c{i}-' || p_size END AS {n}" for i, n in ((1, "second"), (2, "Column_3"), (3, "Column_4"), (4, "Column_5"))) + " FROM part",
    "batch_status": "SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS successful, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) AS total FROM orders",
    "path_parts": "SELECT n_nationkey, n_name || '.v2' AS stem, format('{:03d}', n_nationkey * 100) AS code FROM nation",
    "url_pattern": "SELECT format('{:03d}', i) AS code, 'https://example.org/files/' || format('{:03d}', i) || '09.pdf' AS url FROM generate_series(1, 135) AS t(i)",
    "relational_join": "SELECT n_name, count(*) AS orders, sum(floor(o_totalprice))::BIGINT AS price FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE r_name <> 'ASIA' GROUP BY n_name",
    "csv_round_trip": _ORDERS,
    "json_round_trip": _ORDERS,
    "excel_round_trip": _ORDERS,
}
