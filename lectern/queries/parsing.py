"""Queries of the line operators and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions.text import contains_any
from lectern.operators import lines as L
from lectern.operators.census import parse_census
from lectern.operators.package import FILTERS, KEYWORDS, MAPPINGS, parse_census_pairs, parse_election, parse_generic, parse_next_lines
from lectern.operators.schema import looked_up, mapping_table, names_column, union_ragged
from lectern.operators.universal import chosen_headers, classified, counted, generic_rows, structured, universal_rows, universal_table, with_style
from lectern.config import Config
from lectern.plans.extract import extract, method_used
from lectern.queries.render import MEASURES_SQL, SEX, census_lines, doc_lines, table

Spark = SparkSession
TRIM_WORDS = ("LICENSE", "THE ", "DER ")
PAIR_WORDS = ("FR", "EINE", "THAT")

#: Lines of all documents: line_no from 0.
LINES_SQL = r"""
raw AS (SELECT doc_id, lang, doc_id::VARCHAR AS source, regexp_split_to_array(text, '\r?\n') AS parts FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, lang, source, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM raw),
stripped AS (SELECT doc_id, lang, source, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '')
"""


def lines_scan(spark: Spark, sf: str) -> DataFrame:
    return L.line_counts(doc_lines(spark, sf, "lang"), "lang")


def noise_filter(spark: Spark, sf: str) -> DataFrame:
    return L.line_counts(L.without_noise(doc_lines(spark, sf, "lang"), FILTERS), "lang")


def short_line_filter(spark: Spark, sf: str) -> DataFrame:
    return L.longer_than(doc_lines(spark, sf), 20).groupBy("source").agg(F.count("*").alias("n_lines"))


def keyword_trim(spark: Spark, sf: str) -> DataFrame:
    rows = L.trimmed_to_keyword(L.stripped(doc_lines(spark, sf)), TRIM_WORDS)
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.min("line_no").cast("bigint").alias("first_line"))


def keyword_predicate_counts(spark: Spark, sf: str) -> DataFrame:
    lines = doc_lines(spark, sf)
    hits = lines.select(*[contains_any(F.col("line"), [w]).alias(w) for w in KEYWORDS["census"]])
    one = hits.agg(*[F.count_if(F.col(f"`{w}`")).alias(f"n{i}") for i, w in enumerate(KEYWORDS["census"])])
    return one.select(F.explode(F.array(*[F.struct(F.lit(w).alias("keyword"), F.col(f"n{i}").alias("n")) for i, w in enumerate(KEYWORDS["census"])])).alias("r")).select("r.*")


def census_pairing(spark: Spark, sf: str) -> DataFrame:
    rows = parse_census_pairs(L.without_noise(doc_lines(spark, sf), FILTERS), PAIR_WORDS)
    return rows.select("source", F.col("line_no").cast("bigint").alias("line_no"), F.col("n_cols").cast("bigint").alias("n_cols"), *[F.try_element_at("record", F.lit(c)).alias(c.lower()) for c in ("SEX", "MUSLIM", "OTHERS", "POLLING_STATION")])


def legacy_pairing(spark: Spark, sf: str) -> DataFrame:
    rows = parse_next_lines(census_lines(spark, sf), widths={8: "census_religion_8", 9: "census_religion_9"})
    return rows.select("source", "error", F.col("line_no").cast("bigint").alias("line_no"), *[F.try_element_at("record", F.lit(c)).alias(c.lower()) for c in ("REGION", "SEX", "TOTAL", "OTHERS")])


def _dispatch(kind: str, columns: tuple[str, ...]):
    """The whole of the package's parser: noise, first keyword, the parser that the settings name, and a column for each key of a record."""

    def query(spark: Spark, sf: str) -> DataFrame:
        o = table(spark, sf, "orders")
        words = {"census": ("ALL ", "DISTRICT "), "election": ("STATION   PS-", "POLLING   PS-"), "generic": ("line ", "row ")}[kind]
        wide = "   " if kind == "election" else " "
        is_head = F.col("o_orderkey") % 4 == 0
        cells = F.concat_ws(wide, *[F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("_")) for c in ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")], *[F.lit(str(i)) for i in range(2 if kind == "census" else 0)])
        text = F.when(F.col("o_orderkey") % 16 == 15, "x").when(is_head, F.concat(F.lit(words[1]), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit(words[0]), cells))
        lines = o.select(F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string")).alias("source"), F.lit(1).alias("page"), F.col("o_orderkey").alias("line_no"), text.alias("line"))
        table_ = extract(lines, Config(values={"parsing": {"data_format": kind}}))
        return table_.select(*[F.col(f"`{c}`").alias(c.lower()) if c in table_.columns else F.lit(None).cast("string").alias(c.lower()) for c in columns])

    return query


def column_name_lookup(spark: Spark, sf: str) -> DataFrame:
    """By a join and as an expression, for widths up to 500; election names apply whatever the width."""
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.pmod("p_size", F.lit(12))).otherwise(F.col("p_size") * 10).alias("n"))
    found = looked_up(rows, mapping_table(spark, MAPPINGS), "n")
    either = F.array_join(names_column(MAPPINGS, F.col("n")), ",")
    return found.select("p_partkey", F.col("n").cast("bigint").alias("n"), F.array_join("names", ",").alias("names"), either.alias("by_expression"), F.size(names_column(MAPPINGS, F.col("n"), "election")).cast("bigint").alias("election_names"))


def election_split(spark: Spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    text = F.concat_ws("   ", F.concat(F.lit("STATION PS-"), F.col("o_orderkey").cast("string")), F.col("o_custkey").cast("string"), F.floor("o_totalprice").cast("string"), F.col("o_orderstatus"))
    lines = o.select(F.lit("orders").alias("source"), F.lit(1).alias("page"), F.col("o_orderkey").alias("line_no"), text.alias("line"))
    rows = parse_election(lines)
    names = MAPPINGS["election_standard"]
    return rows.select(*[F.try_element_at("record", F.lit(n)).alias(n.lower()) for n in names])


def generic_columns(spark: Spark, sf: str) -> DataFrame:
    rows = parse_generic(doc_lines(spark, sf))
    return rows.select("source", F.col("line_no").cast("bigint").alias("line_no"), F.size("cells").cast("bigint").alias("n_cols"), *[F.get("cells", F.lit(i)).alias(f"col_{i}") for i in range(4)])


def _census(preset: str, noise: tuple[str, str] = ("", ""), **options: object):
    def query(spark: Spark, sf: str) -> DataFrame:
        rows = parse_census(census_lines(spark, sf, noise, **options), preset)
        columns = [c for c in rows.columns if c not in ("line_no", "source", "SOURCE_IMAGE")]
        names = {"AREA/SEX": "sex", "QADIANI/AHMADI": "qadiani_ahmadi", "SCHEDULED CASTES": "scheduled_castes"}
        return rows.select("source", *[F.col(f"`{c}`").alias(names.get(c, c.lower())) for c in columns])

    return query


_NULLED = ", ".join(f"nullif(m{i}, 0)" for i in range(7))
_VALUES = ("total", "muslim", "christian", "hindu", "qadiani_ahmadi", "scheduled_castes", "others")


def _census_sql(sex: str = "sex", value: str = "nullif({m}, 0)", page: str = "", where: str = "true") -> str:
    values = ", ".join(f"{value.format(m=f'm{i}')} AS {n}" for i, n in enumerate(_VALUES))
    return f"WITH {MEASURES_SQL} SELECT r_name AS source, {page} n_name || ' DISTRICT' AS region, section, {sex} AS sex, {values} FROM measures WHERE {where}"


_SHORT = "CASE sex WHEN 'ALL SEXES' THEN 'ALL' ELSE sex END"
#: Dashes are left out: what comes after them moves up, and only rows without a dash keep seven values.
_WHOLE = "m5 > 0 AND m6 > 0"


def line_classifier(spark: Spark, sf: str) -> DataFrame:
    rows = classified(census_lines(spark, sf, region_word="DIVISION"))
    return rows.groupBy("source", F.coalesce("kind", F.lit("none")).alias("kind"), "region", "section").agg(F.count("*").alias("n"), F.sum("n_numbers").cast("bigint").alias("n_numbers"), F.sum("n_dashes").cast("bigint").alias("n_dashes"))


def header_chooser(spark: Spark, sf: str) -> DataFrame:
    return chosen_headers(classified(census_lines(spark, sf, region_word="DIVISION")))


def pattern_counts(spark: Spark, sf: str) -> DataFrame:
    rows = counted(doc_lines(spark, sf))
    return rows.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_dashes", "n_commas", "n_column_words")])


def locale_detect(spark: Spark, sf: str) -> DataFrame:
    english = census_lines(spark, sf).withColumn("source", F.concat(F.lit("en "), "source"))
    french = census_lines(spark, sf, style="french").withColumn("source", F.concat(F.lit("fr "), "source"))
    return with_style(english.unionByName(french)).groupBy("source").agg(F.bool_and("french").alias("french"), F.count("*").alias("n_lines"))


def token_typing(spark: Spark, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    kind = F.pmod("p_partkey", F.lit(5))
    price = F.format_number("p_retailprice", 0)
    token = F.when(kind == 0, price).when(kind == 1, F.translate(price, "01", "Ol")).when(kind == 2, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).when(kind == 3, F.when(F.col("p_size") % 2 == 0, "-").otherwise("—")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%")))
    return p.select("p_partkey", N.cell(token).alias("c")).select("p_partkey", "c.i", "c.d", "c.s")


def french_regroup(spark: Spark, sf: str) -> DataFrame:
    """Numbers of at most two groups, apart from each other by words, so that the grouping can be told. A second group that begins with a zero is a number of its own."""
    s = table(spark, sf, "supplier")
    a = F.abs(F.floor("s_acctbal"))
    text = F.concat_ws(" ", F.lit("BAL"), F.replace(F.format_number(a, 0), F.lit(","), F.lit(" ")), F.lit("KEY"), F.col("s_suppkey").cast("string"))
    rows = s.withColumn("cells", N.regrouped(F.transform(F.split(text, " "), lambda x: N.cell(x)), F.lit(True)))
    n = F.size("cells")
    return rows.select("s_suppkey", F.get("cells", F.lit(1))["i"].alias("balance"), F.when(n == 5, F.get("cells", F.lit(2))["i"]).alias("rest"), F.element_at("cells", -1)["i"].alias("suppkey"), n.cast("bigint").alias("n"))


def universal_data(spark: Spark, sf: str) -> DataFrame:
    rows = universal_rows(census_lines(spark, sf, region_word="DIVISION"))
    names = ["region", "section", "sex", *_VALUES]
    return rows.select("source", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def universal_columns(spark: Spark, sf: str) -> DataFrame:
    table_ = universal_table(census_lines(spark, sf, region_word="DIVISION"))
    return table_.toDF(*[c.lower().replace("/", "_") for c in table_.columns])


def generic_structure(spark: Spark, sf: str) -> DataFrame:
    """Suppliers as rows of cells under a header row; each number of a cell comes out on its own."""
    s = table(spark, sf, "supplier")
    cells = F.array(F.concat_ws(" ", F.format_number(F.abs(F.floor("s_acctbal")), 0), F.lit("cr")), F.lit(None).cast("string"), F.concat_ws(".", (F.col("s_suppkey") + 10).cast("string"), (F.col("s_nationkey") + 10).cast("string")))
    data = s.select(F.lit("s").alias("source"), F.lit(1).alias("page"), (F.col("s_suppkey") + 1).cast("int").alias("row_no"), cells.alias("cells"))
    head = data.limit(1).select("source", "page", F.lit(0).alias("row_no"), F.array(F.lit("Name of bank"), F.lit(""), F.lit("Share")).alias("cells"))
    return generic_rows(head.unionByName(data)).select(F.col("row_no").cast("bigint").alias("row_no"), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)])


def generic_kinds(spark: Spark, sf: str) -> DataFrame:
    rows = doc_lines(spark, sf).select("source", "page", F.col("line_no").alias("row_no"), F.array("line").alias("cells"))
    return structured(rows).groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.sum("n_numbers").cast("bigint").alias("n_numbers"), F.sum("n_words").cast("bigint").alias("n_words"))


def scanned_detector(spark: Spark, sf: str) -> DataFrame:
    """Documents, and files of which no line is known."""
    documents, region = table(spark, sf, "documents"), table(spark, sf, "region")
    files = documents.select(F.col("doc_id").cast("string").alias("source")).unionByName(region.select(F.concat(F.lit("no text "), "r_name").alias("source")))
    return L.scanned(doc_lines(spark, sf), 300, files)


def method_cascade(spark: Spark, sf: str) -> DataFrame:
    """Census sources for the first method, rendered number tables for the second, plain words for the third."""
    census = census_lines(spark, sf)
    o = table(spark, sf, "customer")
    numbers = o.select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("source"), F.lit(1).alias("page"), F.col("c_custkey").cast("int").alias("line_no"), F.concat_ws(" ", "c_mktsegment", F.lit("balance"), (F.col("c_custkey") + 100).cast("string")).alias("line"))
    words = table(spark, sf, "region").select(F.concat(F.lit("words "), "r_name").alias("source"), F.lit(1).alias("page"), F.col("r_regionkey").alias("line_no"), F.lit("no numbers here").alias("line"))
    blank = table(spark, sf, "region").select(F.concat(F.lit("blank "), "r_name").alias("source"), F.lit(1).alias("page"), F.col("r_regionkey").alias("line_no"), F.lit(" ").alias("line"))
    # files without a text layer: OCR reads some, some have nothing
    seen = table(spark, sf, "nation").select(F.concat(F.lit("image "), "n_name").alias("source"), F.lit(1).alias("page"), F.col("n_nationkey").cast("int").alias("line_no"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).otherwise(F.lit(" ")).alias("line"))
    return method_used(union_ragged(census, numbers, words, blank), ocr=seen)


QUERIES = {
    "lines_scan": lines_scan,
    "noise_filter": noise_filter,
    "short_line_filter": short_line_filter,
    "keyword_trim": keyword_trim,
    "keyword_predicate_counts": keyword_predicate_counts,
    "census_pairing": census_pairing,
    "legacy_pairing": legacy_pairing,
    "package_census": _dispatch("census", ("REGION", "SEX", "TOTAL", "MUSLIM", "OTHERS", "SOURCE_IMAGE")),
    "package_election": _dispatch("election", ("POLLING_STATION", "REGISTERED_VOTERS", "COL_0", "COL_1", "COL_5", "SOURCE_IMAGE")),
    "package_generic": _dispatch("generic", ("COL_0", "COL_1", "COL_4", "SOURCE_IMAGE")),
    "column_name_lookup": column_name_lookup,
    "election_split": election_split,
    "generic_columns": generic_columns,
    "hierarchical_census": _census("hierarchical"),
    "improved_census": _census("improved"),
    "smart_census": _census("smart", ("0125", "OlZS")),
    "multipage_census": _census("multipage", ("025", "oZS"), page_by_nation=True),
    "complete_census": _census("complete", ("025", "oZs")),
    "r_complete_census": _census("r_complete", ("025", "OzS")),
    "line_classifier": line_classifier,
    "header_chooser": header_chooser,
    "pattern_counts": pattern_counts,
    "locale_detect": locale_detect,
    "token_typing": token_typing,
    "french_regroup": french_regroup,
    "universal_data": universal_data,
    "universal_columns": universal_columns,
    "generic_structure": generic_structure,
    "generic_kinds": generic_kinds,
    "scanned_detector": scanned_detector,
    "method_cascade": method_cascade,
}

_FILTERED = "filtered AS (SELECT * FROM stripped WHERE line NOT IN ('OVERALL', 'RURAL', 'URBAN') AND NOT regexp_full_match(line, '\\p{L}'))"
_KW = "(" + " OR ".join(f"contains(upper(line), '{w}')" for w in PAIR_WORDS) + ")"
_TRIM = "(" + " OR ".join(f"contains(upper(line), '{w}')" for w in TRIM_WORDS) + ")"
_COLS = "contains(upper(line), '{w}')::INT"
_COLUMN_WORDS = ("SEX", "TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "MALE", "FEMALE", "AREA", "COUNT", "VOTES", "VOTERS")
_GENERIC_WORDS = ("TOTAL", "SEX", "GENDER", "AGE", "POPULATION", "MALE", "FEMALE", "VOTERS", "DISTRICT", "REGION", "AREA", "COUNT", "NUMBER")
_TEXT = {i: f"CASE m{i} WHEN 0 THEN '-' ELSE format('{{:,}}', m{i}) END" for i in range(7)}
_TEXTS = " || ' ' || ".join(_TEXT.values())

_DISPATCHED = "rows AS (SELECT *, 's' || (o_custkey % 7) AS source, o_orderkey % 4 = 0 AS head FROM orders WHERE o_orderkey % 16 <> 15)"

ORACLE_SQL = {
    "lines_scan": f"WITH {LINES_SQL} SELECT lang, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM lines GROUP BY lang",
    "noise_filter": f"WITH {LINES_SQL}, {_FILTERED} SELECT lang, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM filtered GROUP BY lang",
    "short_line_filter": f"WITH {LINES_SQL} SELECT source, count(*) AS n_lines FROM stripped WHERE length(line) > 20 GROUP BY source",
    "keyword_trim": f"""WITH {LINES_SQL},
        hits AS (SELECT *, min(CASE WHEN {_TRIM} THEN line_no END) OVER (PARTITION BY source) AS hit FROM stripped)
        SELECT source, count(*) AS n_lines, min(line_no) AS first_line FROM hits WHERE line_no >= coalesce(hit, 0) GROUP BY source""",
    "keyword_predicate_counts": f"WITH {LINES_SQL}, kw AS (SELECT unnest({list(KEYWORDS['census'])!r}) AS keyword) SELECT keyword, count(*) FILTER (WHERE contains(upper(line), keyword)) AS n FROM lines, kw GROUP BY keyword",
    "census_pairing": f"""WITH {LINES_SQL}, {_FILTERED},
        matching AS (SELECT * FROM filtered WHERE contains(upper(line), 'ALL') OR {_KW}),
        nexts AS (SELECT *, lead(line, 1, '') OVER (PARTITION BY source ORDER BY line_no) AS data FROM matching),
        clean AS (SELECT source, line_no, trim(regexp_replace(regexp_replace(data, '( SEXE.|SEXE.)', '', 'g'), '\\s+', ' ', 'g')) AS data FROM nexts WHERE {_KW}),
        cells AS (SELECT source, line_no, string_split(data, ' ') AS c FROM clean WHERE data <> '')
        SELECT source, line_no, len(c) AS n_cols, CASE WHEN len(c) <> 5 THEN c[1] END AS sex, CASE WHEN len(c) <> 5 THEN c[3] END AS muslim,
               CASE WHEN len(c) IN (8, 9) THEN c[8] END AS others, CASE WHEN len(c) = 5 THEN c[1] END AS polling_station
        FROM cells WHERE len(c) IN (5, 7, 8, 9)""",
    "legacy_pairing": f"""WITH {MEASURES_SQL},
        regions AS (SELECT r_name, n_nationkey, min(n_name) || ' DISTRICT' AS region FROM measures GROUP BY 1, 2),
        ends AS (SELECT r_name AS source, n_nationkey, region, NULL AS data FROM regions),
        firsts AS (SELECT r_name, n_nationkey, min({{'o': CASE section WHEN 'OVERALL' THEN 0 WHEN 'RURAL' THEN 1 ELSE 2 END, 'l': 'ALL ' || {_TEXTS}}}) FILTER (WHERE sex = 'ALL SEXES') AS f FROM measures GROUP BY 1, 2),
        rows AS (SELECT r_name AS source, n_nationkey, region, f.l AS line FROM regions JOIN firsts USING (r_name, n_nationkey))
        SELECT source, NULL::VARCHAR AS error, 10 + n_nationkey * 100 AS line_no, region, split_part(line, ' ', 1) AS sex, split_part(line, ' ', 2) AS total, split_part(line, ' ', 8) AS others FROM rows""",
    "package_census": f"""WITH {_DISPATCHED},
        nexts AS (SELECT *, lead(head) OVER w AS next_head, lead(o_custkey) OVER w AS c, lead(o_orderkey) OVER w AS k FROM rows WINDOW w AS (PARTITION BY source ORDER BY o_orderkey))
        SELECT 'DISTRICT ' || o_orderkey AS region, 'ALL' AS sex, c::VARCHAR AS total, k::VARCHAR AS muslim, NULL::VARCHAR AS others, source AS source_image FROM nexts WHERE head AND NOT next_head""",
    "package_election": f"""WITH {_DISPATCHED} SELECT CASE WHEN head THEN 'POLLING' ELSE 'STATION' END AS polling_station, 'PS-' || CASE WHEN head THEN o_orderkey ELSE o_custkey END AS registered_voters,
        NULL::VARCHAR AS col_0, NULL::VARCHAR AS col_1, NULL::VARCHAR AS col_5, source AS source_image FROM rows""",
    "package_generic": f"""WITH {_DISPATCHED} SELECT CASE WHEN head THEN 'row' ELSE 'line' END AS col_0, (CASE WHEN head THEN o_orderkey ELSE o_custkey END)::VARCHAR AS col_1,
        CASE WHEN NOT head THEN o_orderstatus END AS col_4, source AS source_image FROM rows""",
    "column_name_lookup": """WITH n AS (SELECT p_partkey, (CASE WHEN p_partkey % 3 > 0 THEN p_size % 12 ELSE p_size * 10 END)::BIGINT AS n FROM part)
        SELECT *, names AS by_expression, CASE WHEN n > 0 THEN 5 END::BIGINT AS election_names FROM (SELECT p_partkey, n, CASE n WHEN 5 THEN 'POLLING_STATION,REGISTERED_VOTERS,VOTES_CAST,VALID_VOTES,REJECTED_VOTES'
          WHEN 7 THEN 'SEX,TOTAL,MUSLIM,CHRISTIAN,HINDU,QADIANI/AHMADI,CASTE/SCHEDULED' WHEN 8 THEN 'SEX,TOTAL,MUSLIM,CHRISTIAN,HINDU,QADIANI/AHMADI,CASTE/SCHEDULED,OTHERS'
          WHEN 9 THEN 'SEX,TOTAL,MUSLIM,CHRISTIAN,HINDU,QADIANI/AHMADI,CASTE/SCHEDULED,OTHERS,EXTRACOL' END AS names FROM n)""",
    "election_split": "SELECT 'STATION PS-' || o_orderkey AS polling_station, o_custkey::VARCHAR AS registered_voters, floor(o_totalprice)::BIGINT::VARCHAR AS votes_cast, o_orderstatus AS valid_votes, NULL::VARCHAR AS rejected_votes FROM orders",
    "generic_columns": f"""WITH {LINES_SQL}, cells AS (SELECT source, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS c FROM lines)
        SELECT source, line_no, len(c) AS n_cols, c[1] AS col_0, c[2] AS col_1, c[3] AS col_2, c[4] AS col_3 FROM cells WHERE len(c) > 0""",
    "hierarchical_census": _census_sql(value="nullif({m}, 0)::DOUBLE"),
    "improved_census": _census_sql(value="nullif({m}, 0)::VARCHAR"),
    "smart_census": _census_sql(_SHORT),
    "multipage_census": _census_sql(_SHORT, page="(n_nationkey + 1)::INTEGER AS page,"),
    "complete_census": _census_sql(_SHORT, value="CASE {m} WHEN 0 THEN '' ELSE {m}::VARCHAR END"),
    "r_complete_census": _census_sql(_SHORT, where=_WHOLE),
    "line_classifier": f"""WITH {MEASURES_SQL},
        nations AS (SELECT DISTINCT r_name, n_nationkey, n_name FROM measures),
        texts AS (SELECT r_name, n_name, section, {_TEXTS} AS line, sex FROM measures),
        data AS (SELECT r_name, n_name || ' DIVISION' AS region, section, line, len(regexp_extract_all(line, '\\b\\d{{2,}}[,\\d]*\\b')) AS nums, length(line) - length(replace(line, '-', '')) AS dashes FROM texts),
        every AS (
          SELECT r_name AS source, CASE WHEN nums > 0 OR dashes >= 3 THEN 'data' ELSE 'none' END AS kind, region, section, nums, dashes FROM data
          UNION ALL SELECT r_name, 'region', n_name || ' DIVISION', NULL, 0, 0 FROM nations
          UNION ALL SELECT DISTINCT r_name, 'section', n_name || ' DIVISION', section, 0, 0 FROM measures
          UNION ALL SELECT DISTINCT r_name, unnest(['header', 'header', 'none']), NULL, NULL, 0, 0 FROM measures
          UNION ALL SELECT DISTINCT r_name, 'header', NULL, NULL, 0, 1 FROM measures
          UNION ALL SELECT DISTINCT r_name, 'drop', NULL, NULL, 0, 0 FROM measures),
        fixed AS (
          SELECT * FROM every WHERE kind NOT IN ('header', 'none', 'drop') OR region IS NOT NULL
          UNION ALL SELECT DISTINCT r_name, 'header', NULL, NULL, 0, 1 FROM measures
          UNION ALL SELECT DISTINCT r_name, 'header', NULL, NULL, 0, 0 FROM measures
          UNION ALL SELECT DISTINCT r_name, 'none', NULL, NULL, 0, 0 FROM measures)
        SELECT source, kind, region, section, count(*) AS n, sum(nums)::BIGINT AS n_numbers, sum(dashes)::BIGINT AS n_dashes FROM fixed GROUP BY 1, 2, 3, 4""",
    "header_chooser": f"WITH {MEASURES_SQL} SELECT DISTINCT r_name AS source, 'AREA/ SEX TOTAL MUSLIM CHRISTIAN HINDU AHMADI CASTES OTHERS' AS header FROM measures",
    "pattern_counts": f"""WITH {LINES_SQL} SELECT sum(length(line) - length(replace(line, '-', '')))::BIGINT AS n_dashes,
        sum(len(regexp_extract_all(line, '\\d{{1,3}},\\d{{3}}')))::BIGINT AS n_commas, sum({" + ".join(_COLS.format(w=w) for w in _COLUMN_WORDS)})::BIGINT AS n_column_words FROM lines""",
    "locale_detect": f"""WITH {MEASURES_SQL}, n AS (SELECT r_name, count(*) + count(DISTINCT n_nationkey) + count(DISTINCT (n_nationkey, section)) + 3 AS n_lines FROM measures GROUP BY 1)
        SELECT 'en ' || r_name AS source, false AS french, n_lines FROM n UNION ALL SELECT 'fr ' || r_name, true, n_lines FROM n""",
    "token_typing": """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN round_even(p_retailprice, 0)::BIGINT END AS i,
        CASE WHEN p_partkey % 5 = 2 THEN p_size + 0.5::DOUBLE END AS d, CASE WHEN p_partkey % 5 = 4 THEN p_size || '%' END AS s FROM part""",
    "french_regroup": """WITH a AS (SELECT s_suppkey, abs(floor(s_acctbal))::BIGINT AS a FROM supplier), p AS (SELECT *, a >= 1000 AND a % 1000 < 100 AS parted FROM a)
        SELECT s_suppkey, CASE WHEN parted THEN a // 1000 ELSE a END AS balance, CASE WHEN parted THEN a % 1000 END AS rest, s_suppkey AS suppkey, CASE WHEN parted THEN 5 ELSE 4 END::BIGINT AS n FROM p""",
    "universal_data": f"""WITH {MEASURES_SQL} SELECT r_name AS source, n_name || ' DIVISION' AS region, section, sex, {", ".join(f"nullif(m{i}, 0)::VARCHAR AS {n}" for i, n in enumerate(_VALUES))} FROM measures""",
    "universal_columns": f"""WITH {MEASURES_SQL} SELECT DISTINCT n_name || ' DIVISION' AS region, section, sex AS area_sex, {", ".join(f"nullif(m{i}, 0)::VARCHAR AS {n}" for i, n in enumerate(("total", "muslim", "christian", "hindu", "ahmadi", "castes", "others")))} FROM measures""",
    "generic_structure": """SELECT s_suppkey + 1 AS row_no, abs(floor(s_acctbal))::BIGINT::VARCHAR AS c0, NULL::VARCHAR AS c1, (s_suppkey + 10)::VARCHAR AS c2, (s_nationkey + 10)::VARCHAR AS c3
        FROM supplier WHERE len(regexp_extract_all(format('{:,}', abs(floor(s_acctbal))::BIGINT), '\\d{2,}')) + 2 >= 2""",
    "generic_kinds": f"""WITH {LINES_SQL}, counts AS (SELECT line, len(regexp_extract_all(line, '\\d{{2,}}')) AS nums, len(regexp_extract_all(line, '[A-Za-z]{{3,}}')) AS words FROM lines)
        SELECT CASE WHEN (words > nums AND words > 0) OR {" OR ".join(f"contains(upper(line), '{w}')" for w in _GENERIC_WORDS)} THEN 'header' WHEN nums >= 2 THEN 'data' ELSE 'none' END AS kind,
               count(*) AS n, sum(nums)::BIGINT AS n_numbers, sum(words)::BIGINT AS n_words FROM counts GROUP BY 1""",
    "scanned_detector": f"""WITH {LINES_SQL}, found AS (SELECT source, sum(length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) + 1) - 1 <= 300 AS scanned FROM lines GROUP BY source)
        SELECT d.doc_id::VARCHAR AS source, coalesce(f.scanned, true) AS scanned FROM documents d LEFT JOIN found f ON d.doc_id::VARCHAR = f.source
        UNION ALL SELECT 'no text ' || r_name, true FROM region""",
    "method_cascade": f"""WITH {MEASURES_SQL} SELECT r_name AS source, 'hierarchical' AS method, count(*) AS n_rows FROM measures GROUP BY 1
        UNION ALL SELECT 'nation ' || c_nationkey, 'universal', count(*) FROM customer GROUP BY 1
        UNION ALL SELECT 'words ' || r_name, 'text', 1 FROM region UNION ALL SELECT 'blank ' || r_name, NULL, 0 FROM region
        UNION ALL SELECT 'image ' || n_name, CASE WHEN n_regionkey > 0 THEN 'ocr' END, (n_regionkey > 0)::INT FROM nation""",
}
