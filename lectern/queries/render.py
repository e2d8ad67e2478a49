"""Report lines made from relational tables, so that what the parsers find can be held against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.numbers import thousands


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Lines of all documents, with further columns of theirs."""
    from lectern.sources.lines import lines_from_text

    return lines_from_text(table(spark, sf_dir, "documents"), "doc_id", page_break=None, keep=more)


#: Sections and sexes of the rendered census, by order status and priority, and its seven measures.
SECTION = {"O": "OVERALL", "F": "RURAL", "P": "URBAN"}
SEX = {"5-LOW": "ALL SEXES", "1-URGENT": "MALE", "2-HIGH": "FEMALE", "3-MEDIUM": "TRANSGENDER"}
MEASURES = ("TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "QADIANI/AHMADI", "SCHEDULED CASTES", "OTHERS")


def _once(text: Column) -> Column:
    """A text made once, as if it had been read: through a generator, else each predicate on it would make it again."""
    return F.explode(F.array(text))


def census_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all orders by nation, status and printed line; the last two are often 0. Priorities without a line of their own count to the last line."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    price = F.floor("o_totalprice")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    *own, last = SEX
    rows = rows.withColumn("o_orderpriority", F.when(F.col("o_orderpriority").isin(*own), F.col("o_orderpriority")).otherwise(last))
    m = [F.count("*"), F.sum(price), F.max(price), F.min(price), F.count_distinct("o_custkey"), F.count_if(price % 97 == 0), F.count_if(price % 1009 == 0)]
    return rows.groupBy("r_name", "n_nationkey", "n_name", "o_orderstatus", "o_orderpriority").agg(*[x.cast("bigint").alias(f"m{i}") for i, x in enumerate(m)])


def _lookup(column: str, values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(column)]


def number(value: Column, style: str = "english") -> Column:
    """A number as reports print it; 0 is a dash."""
    text = thousands(value)
    text = F.replace(text, F.lit(","), F.lit(" ")) if style == "french" else text
    return F.when(value == 0, "-").otherwise(text)


def census_lines(spark: SparkSession, sf_dir: str, noise: tuple[str, str] = ("", ""), style: str = "english", region_word: str = "DISTRICT", page_by_nation: bool = False) -> DataFrame:
    """A source a region of the world: title and column lines, then for each nation its line, its sections, and a line for each sex.

    noise: digits replaced by letters as a bad scan would."""
    rows = census_measures(spark, sf_dir)
    section = _lookup("o_orderstatus", {k: i for i, k in enumerate(SECTION)})
    sex = _lookup("o_orderpriority", {k: i for i, k in enumerate(SEX)})
    page = (F.col("n_nationkey") + 1).cast("int") if page_by_nation else F.lit(1)
    at = 10 + F.col("n_nationkey") * 100
    numbers = F.translate(F.concat_ws(" ", *[number(F.col(f"m{i}"), style) for i in range(len(MEASURES))]), *noise)
    data = rows.select("r_name", page.alias("page"), (at + section * 20 + sex + 5).cast("int").alias("line_no"), _once(F.concat_ws(" ", _lookup("o_orderpriority", SEX), numbers)).alias("line"))
    nations = rows.select("r_name", "n_nationkey", "n_name").distinct().select("r_name", page.alias("page"), at.cast("int").alias("line_no"), F.concat("n_name", F.lit(f" {region_word}")).alias("line"))
    sections = rows.select("r_name", "n_nationkey", "o_orderstatus").distinct().select("r_name", page.alias("page"), (at + section * 20 + 4).cast("int").alias("line_no"), _lookup("o_orderstatus", SECTION).alias("line"))
    head = [(0, "TABLE 9 - POPULATION BY SEX AND RELIGION"), (1, "AREA/ SEX TOTAL MUSLIM CHRISTIAN HINDU AHMADI CASTES OTHERS"), (2, "1 2 3 4 5 6 7 8")]
    heads = rows.select("r_name").distinct().select("r_name", F.lit(1).alias("page"), F.explode(F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(x).alias("line")) for i, x in head])).alias("h")).select("r_name", "page", "h.*")
    return data.unionByName(nations).unionByName(sections).unionByName(heads).withColumnRenamed("r_name", "source")


#: The measures straight from the tables; {x} is filled in for each query.
MEASURES_SQL = """
measures AS (
  SELECT r_name, n_nationkey, n_name, o_orderstatus,
         CASE o_orderpriority WHEN '5-LOW' THEN 'ALL SEXES' WHEN '1-URGENT' THEN 'MALE' WHEN '2-HIGH' THEN 'FEMALE' ELSE 'TRANSGENDER' END AS sex,
         count(*)::BIGINT AS m0, sum(floor(o_totalprice))::BIGINT AS m1, max(floor(o_totalprice))::BIGINT AS m2,
         min(floor(o_totalprice))::BIGINT AS m3, count(DISTINCT o_custkey)::BIGINT AS m4,
         count(*) FILTER (WHERE floor(o_totalprice)::BIGINT % 97 = 0)::BIGINT AS m5,
         count(*) FILTER (WHERE floor(o_totalprice)::BIGINT % 1009 = 0)::BIGINT AS m6,
         CASE o_orderstatus WHEN 'O' THEN 'OVERALL' WHEN 'F' THEN 'RURAL' ELSE 'URBAN' END AS section
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4, 5)
"""
