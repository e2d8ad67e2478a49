"""Queries of texts against tables of keywords, and of lines that arrive in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import split_words
from lectern.operators import keywords as K
from lectern.plans.storage import shared_dir
from lectern.queries.parsing import LINES_SQL
from lectern.queries.render import doc_lines, table
from lectern.sources.lines import lines_from_text
from lectern.streaming.context import carried_stream, started

Spark = SparkSession
#: Parts in which lines arrive.
PARTS = 3


def _words(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.explode(split_words(F.col("text"))).alias("keyword"))


def keyword_hits(spark: Spark, sf: str) -> DataFrame:
    """How many words of the benchmark texts each line of the documents contains, those that contain any: by automaton."""
    hits = K.contained(doc_lines(spark, sf), _words(spark, sf), ["source", "line_no"])
    return hits.groupBy(F.col("source").cast("long").alias("doc_id"), "line_no").agg(F.count("*").alias("n_keywords"))


def keyword_index(spark: Spark, sf: str) -> DataFrame:
    """How many lines of the documents contain each benchmark text's first word, and each name of a customer and of a supplier's nation: by the index of rarest grams."""
    words = table(spark, sf, "benchmark").select(F.get(split_words(F.col("text")), F.lit(0)).alias("keyword"))
    names = table(spark, sf, "customer").select(F.col("c_name").alias("keyword")).unionByName(table(spark, sf, "nation").select(F.lower("n_name").alias("keyword")))
    hits = K.by_index(doc_lines(spark, sf), words.unionByName(names), ["source", "line_no"])
    return hits.groupBy("keyword").agg(F.count("*").alias("n_lines"))


def streamed_context(spark: Spark, sf: str) -> DataFrame:
    """Lines of documents by their source, a document a page, which arrive in parts (thirds of the ids) as files: the latest line with a capital T, and since then the latest with an A."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    part = F.floor((F.col("doc_id") - F.lit(low)) * PARTS / F.lit((high or 0) - (low or 0) + 1)).cast("int")
    lines = lines_from_text(docs.withColumn("part", part), F.coalesce("source", F.lit("")), page_break=None, keep=["doc_id", "part"]).withColumn("page", F.col("doc_id").cast("int")).drop("doc_id")
    for k in range(PARTS):  # one after the other, as files come; a source's lines of a part are one file
        lines.where(F.col("part") == k).drop("part").repartition("source").write.mode("append").parquet(f"{folder}/in")
    line = F.col("line")
    files = spark.readStream.schema(lines.drop("part").schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    top = F.when(line.startswith("T"), line)
    out = carried_stream(files, {"region": top, "section": F.when(line.startswith("A"), line)}, {"section": top.isNotNull()})
    started(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(F.col("page").cast("long").alias("doc_id"), "line_no", "region", "section", "n_lines")


QUERIES = {f.__name__: f for f in (keyword_hits, keyword_index, streamed_context)}

ORACLE_SQL = {
    "keyword_hits": rf"""WITH {LINES_SQL}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS keyword FROM benchmark)
        SELECT doc_id, line_no::INT AS line_no, count(*) AS n_keywords FROM lines, w WHERE keyword <> '' AND contains(line, keyword) GROUP BY 1, 2""",
    "keyword_index": rf"""WITH {LINES_SQL}, w AS (SELECT regexp_split_to_array(trim(text), '\s+')[1] AS keyword FROM benchmark UNION SELECT c_name FROM customer UNION SELECT lower(n_name) FROM nation)
        SELECT keyword, count(*) AS n_lines FROM lines, w WHERE keyword <> '' AND contains(line, keyword) GROUP BY 1""",
    "streamed_context": rf"""WITH {LINES_SQL}, l AS (SELECT coalesce(documents.source, '') AS source, doc_id, line_no, line FROM lines JOIN documents USING (doc_id)),
        r AS (SELECT *, last_value(CASE WHEN line LIKE 'T%' THEN line END IGNORE NULLS) OVER w AS region, count(CASE WHEN line LIKE 'T%' THEN 1 END) OVER w AS part, count(*) OVER w AS n_lines
              FROM l WINDOW w AS (PARTITION BY source ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, line_no::INT AS line_no, region, CASE WHEN line LIKE 'T%' THEN CASE WHEN line LIKE 'A%' THEN line END ELSE last_value(CASE WHEN line LIKE 'A%' THEN line END IGNORE NULLS) OVER (PARTITION BY source, part ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) END AS section, n_lines FROM r""",
}
