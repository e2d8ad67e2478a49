"""Column functions, settings, cleaning, profiles and analytics."""

import copy

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Config, merged
from lectern.functions import numbers as N
from lectern.functions import text as T
from lectern.operators import analytics as A
from lectern.operators import cleaning as C
from lectern.operators import profile as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.strip(F.lit(" \t a b  "))) == "a b"
    assert one(spark, T.split_words(F.lit(" 1 132 655 "))) == ["1", "132", "655"] and one(spark, T.split_words(F.lit(""))) == []
    assert one(spark, T.split_wide(F.lit("a b   c"))) == ["a b", "c"]
    assert one(spark, T.contains_any(F.lit("see africa"), ["FR"])) is True and one(spark, T.contains_any(F.lit("fxr"), ["F.R"])) is False
    assert one(spark, T.count_any(F.lit("FEMALE"), ["MALE", "FEMALE", "SEX"])) == 2
    assert one(spark, T.zero_padded(F.lit(1234), 3)) == "1234" and one(spark, T.zero_padded(F.lit(7), 3)) == "007"
    assert one(spark, T.stem(F.lit("/a.b/c.d.pdf"))) == "c.d" and one(spark, T.stem(F.lit("plain"))) == "plain"
    assert one(spark, T.join_cells(F.array(F.lit("a"), F.lit(None), F.lit(""), F.lit("b")))) == "a b"


@pytest.mark.parametrize(
    "token,cell",
    [("1,436,082", (1436082, None, None)), ("-", (None,) * 3), ("—", (None,) * 3), ("O", (0, None, None)), ("l2S", (125, None, None)), ("II", (11, None, None)), ("ZOOS", (2005, None, None)), ("12.5", (None, 12.5, None)), ("5.", (None, 5.0, None)), ("1.2.3", (None, None, "1.2.3")), ("12.5%", (None, None, "12.5%")), ("MALE", (None, None, "MALE")), ("SOLO", (None, None, "SOLO")), ("²", (None, None, "²")), ("99999999999999999999", (None, None, "99999999999999999999"))],
)
def test_cells(spark, token, cell):
    assert tuple(one(spark, N.cell(F.lit(token)))) == cell


def regrouped(spark, text, french=True):
    cells = N.regrouped(F.transform(F.split(F.lit(text), " "), lambda t: N.cell(t)), F.lit(french))
    return one(spark, F.transform(cells, lambda c: N.cell_text(c)))


def test_regrouping(spark):
    assert regrouped(spark, "ABOBO 1 132 655 350 731 71 148 9") == ["ABOBO", "1132655", "350731", "71148", "9"]
    assert regrouped(spark, "X 5 731 562") == ["X", "5731", "562"]
    assert regrouped(spark, "Y 1 048 655") == ["Y", "1", "48655"]
    assert regrouped(spark, "Q 0 123 7") == ["Q", "123", "7"]
    assert regrouped(spark, "all SEXES 1 132", False) == ["ALL SEXES", "1", "132"]
    assert regrouped(spark, "- 12 -") == [None, "12", None]


def folded(tokens):
    """The grouping rule, token by token."""
    out, i = [], 0
    while i < len(tokens):
        n, j = tokens[i], i + 1
        if n < 1000:
            room = 2 if n <= 4 else 1
            while j < len(tokens) and room and 100 <= tokens[j] <= 999:
                n, j, room = n * 1000 + tokens[j], j + 1, room - 1
        out.append(n)
        i = j
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 1500)), min_size=1, max_size=12))
def test_regrouping_property(spark, tokens):
    assert regrouped(spark, " ".join(map(str, tokens))) == [str(n) for n in folded(tokens)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=20))
def test_numbers_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("t", N.thousands(F.col("v")))
    assert df.where(~N.cell(F.col("t"))["i"].eqNullSafe(F.col("v"))).count() == 0


def test_percent(spark):
    assert one(spark, N.percent(F.lit(1), F.lit(0))) is None and one(spark, N.percent(F.lit(1), F.lit(800))) == 0.12


def test_settings(tmp_path):
    before = copy.deepcopy(DEFAULTS)
    path = tmp_path / "c.yaml"
    path.write_text("download:\n  data_type: 09\n  district_range: [5, 6]\nparsing:\n  filters: []\n  column_mappings: {}\n")
    c = Config(path)
    assert c.get("download", "data_type") == "09" and c.get("download", "district_range") == [5, 6] and c.get("download", "timeout") == 30
    assert c.get("parsing", "filters") == [] and "election_standard" in c.get("parsing", "column_mappings")
    c.set("parsing", "data_format", "nonsense")
    assert c.problems() and not Config().problems() and DEFAULTS == before
    c.get("download")["x"] = 1
    assert "x" not in Config().get("download")
    path.write_text("")
    assert Config(path).values == before and Config(tmp_path / "none.yaml").values == before
    c.save(path)
    assert Config(path).values == c.values
    assert merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def test_cleaning(spark):
    rows = [("b", "URBAN", "MALE", "1"), ("b", "URBAN", "MALE", "1"), ("a", "RURAL", "ALL", " 2.5 "), ("a", "OVERALL", "TRANSGENDER", "x"), ("a", None, "ALL", "0"), (None, "OVERALL", "ALL", "7"), ("a", "OVERALL", "FEMALE", "3d")]
    df = spark.createDataFrame(rows, "REGION string, SECTION string, SEX string, TOTAL string").repartition(3)
    got = [tuple(r) for r in C.cleaned(df, ["TOTAL", "absent"]).collect()]
    assert got == [("a", "RURAL", "ALL", 2.5), ("a", None, "ALL", 0.0), ("b", "URBAN", "MALE", 1.0), (None, "OVERALL", "ALL", 7.0)]
    assert C.distinct(spark.createDataFrame([(None, 1), (None, 1)], "a int, b int")).count() == 1
    firsts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "pos int, v string")
    assert sorted(map(tuple, C.distinct_in_order(firsts, "pos").select("pos", "v").collect())) == [(1, "x"), (2, "y")]
    assert C.numeric_columns(firsts) == ["pos"] and C.renamed(firsts, ["a", "b"]).columns == ["a", "b"]


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (3.0, "a"), (10.0, "b")], "v double, `a/b c` string")
    d = P.describe(df).first()
    assert (d["25%"], d["50%"], d["75%"]) == (1.75, 2.5, 4.75) and d["std"] == pytest.approx(4.08248290463863)
    assert [tuple(r) for r in P.null_counts(df).collect()] == [("a/b c", 1)]
    assert P.completeness(df).first()["percent"] == pytest.approx(87.5)
    info = {r["Column"]: tuple(r)[1:] for r in P.column_info(df).collect()}
    assert info == {"v": ("double", 4, 0, 4), "a/b c": ("string", 3, 1, 2)}
    assert {r["Unique"] for r in P.column_info(df, approximate=True).collect()} == {4, 2}
    s = P.summary(df).first()
    assert s["rows"] == 4 and s["null_counts"] == {"a/b c": 1} and s["memory_usage"] > 0
    conf = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("p", 10), ("p", -1), ("q", -1)], "image_path string, conf int")
    got = {r["image_path"]: tuple(r)[1:] for r in P.confidence(conf).collect()}
    assert got["p"] == pytest.approx((4.0, 1.0, 10.0, 3.5355339059327378)) and got["q"] == (0.0,) * 4
    none = df.where("false")
    assert P.completeness(none).first()["percent"] is None and P.null_counts(none).count() == 0 and P.summary(none).first()["memory_usage"] == 0


def test_analytics(spark):
    df = spark.createDataFrame([("a", 10, 5, 0), ("a", None, None, None), ("b", 0, 1, 2)], "g string, t int, x int, y int")
    got = {r["g"]: tuple(r)[1:] for r in A.group_shares(df, ["g"], "t", ["x", "y"]).collect()}
    assert got == {"a": (10, 5, 0, 50.0, 0.0), "b": (0, 1, 2, None, None)}
    long = A.unpivoted(df, ["g"], ["x", "y"], positive=True).collect()
    assert sorted((r["g"], r["Religion"], r["Population"]) for r in long) == [("a", "x", 5), ("b", "x", 1), ("b", "y", 2)]
    assert [r["t"] for r in A.top(df, 2, "t").collect()] == [10, 0] and [r["t"] for r in A.bottom(df, 1, "t").collect()] == [0]
    batch = A.statuses(spark.createDataFrame([("i", "o", None), ("j", None, "broken")], "input string, output string, error string"))
    assert tuple(A.status_counts(batch).first()) == (1, 1, 2) and {r["status"] for r in batch.collect()} == {"SUCCESS", "FAILED: broken"}


def test_settings_at_any_depth():
    c = Config()
    assert c.get("ocr", "preprocessing", "resize_factor") == 1.2 and c.get("ocr", "x", "y", default=3) == 3 and c.get("ocr", "engine", "x") is None
    c.set("ocr", "preprocessing", "resize_factor", 2.0)
    c.set("a", "b", "c", 1)
    assert c.get("ocr", "preprocessing", "resize_factor") == 2.0 and c.get("a", "b", "c") == 1
    assert Config().get("ocr", "preprocessing", "resize_factor") == 1.2


def test_strip_is_unicode_white_space_and_made_once(spark):
    from pyspark.sql import functions as F

    from lectern.operators.lines import without_noise

    points = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c"))
    text = F.concat("c", F.lit("a b"), "c", F.lit("\r\n"))
    assert points.where(~T.strip(text).eqNullSafe(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))).count() == 0
    lines = spark.range(3).select(F.lit("s").alias("source"), F.lit(1).alias("page"), F.col("id").alias("line_no"), F.concat(F.lit(" "), "id").alias("line"))
    assert without_noise(lines, ["x"])._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
