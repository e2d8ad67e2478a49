"""What a table holds: one aggregation, then unpivoted to a row a column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

from lectern.operators.cleaning import numeric_columns


#: Ranges that a pass towards an exact quantile counts.
RANGES = 1024
#: Whole numbers are counted by bitmaps where their range has fewer bits than so many a value.
BITS_A_VALUE = 64


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _unpivoted(one: DataFrame, columns: Sequence[str], fields: Sequence[str], names: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("Column"), *[F.col(f"{f}_{i}").alias(n) for f, n in zip(fields, names, strict=True)]) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    """Columns that have nulls, and how many."""
    one = df.agg(*[F.count_if(_col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    return _unpivoted(one, df.columns, ["n"], ["Nulls"]).where("Nulls > 0")


def completeness(df: DataFrame) -> DataFrame:
    """Rows, columns, cells that aren't null and their percentage."""
    full = F.lit(0)
    for c in df.columns:
        full = full + F.count(_col(c))
    one = df.agg(F.count("*").alias("n_rows"), full.cast("long").alias("n_full"))
    n = len(df.columns)
    return one.select("n_rows", F.lit(n).cast("long").alias("n_columns"), "n_full", F.try_divide(F.col("n_full") * 100.0, F.col("n_rows") * n).alias("percent"))


def _as_text(name: str, kind: DataType) -> Column | None:
    """A value as a text that no other value of its column has; None for types without one."""
    c = _col(name)
    if isinstance(kind, StringType):
        return c if kind.simpleString() == "string" else None
    if isinstance(kind, (DoubleType, FloatType)):
        return (c + F.lit(0.0).cast(kind)).cast("string")  # one zero
    if isinstance(kind, TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, BinaryType):
        return F.hex(c)
    return c.cast("string") if isinstance(kind, (IntegralType, DecimalType, BooleanType, DateType, TimestampNTZType)) else None


def _dense(row: Row, i: int) -> bool:
    return row[f"low_{i}"] is not None and row[f"high_{i}"] - row[f"low_{i}"] < BITS_A_VALUE * row[f"full_{i}"]


def column_info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Column, Type, Non-Null, Null and Unique (nulls aside), a row a column in their order. approximate: sketches instead of exact distinct counts.

    Exact ones take no copy of a row for each column: a pass counts values and finds the range of whole numbers; those that lie close together are counted by bitmaps, a
    bit a number, and other values as (column, text), once in each task before they are exchanged. Arrays and structs are counted as Spark does by default."""
    kinds = [f.dataType for f in df.schema]
    whole = [i for i, k in enumerate(kinds) if isinstance(k, IntegralType)]
    texts = {i: _as_text(c, kinds[i]) for i, c in enumerate(df.columns)}
    count = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [x for i, c in enumerate(df.columns) for x in (F.count(_col(c)).alias(f"full_{i}"), F.count_if(_col(c).isNull()).alias(f"null_{i}"))]
    aggs += [count(_col(c)).alias(f"unique_{i}") for i, c in enumerate(df.columns) if approximate or texts[i] is None]
    aggs += [f(_col(df.columns[i])).alias(f"{n}_{i}") for i in whole for n, f in (("low", F.min), ("high", F.max)) if not approximate]
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    if approximate:
        rows = _unpivoted(df.agg(*aggs), df.columns, ["full", "null", "unique"], ["Non-Null", "Null", "Unique"])
        return rows.withColumn("Type", types[F.col("Column")]).select("Column", "Type", "Non-Null", "Null", "Unique")
    one = df.agg(*aggs).first()
    bits = [i for i in whole if _dense(one, i)]
    facts = [F.struct(F.lit(i).alias("k"), F.lit(c).alias("Column"), F.lit(kinds[i].simpleString()).alias("Type"), F.lit(one[f"full_{i}"]).cast("long").alias("Non-Null"), F.lit(one[f"null_{i}"]).cast("long").alias("Null"),
                      F.lit(one[f"unique_{i}"] if texts[i] is None else 0).cast("long").alias("_own")) for i, c in enumerate(df.columns)]
    rows = df.sparkSession.range(1).select(F.explode(F.array(*facts)).alias("f")).select("f.*")
    found = []
    if bits:
        place = {i: _col(df.columns[i]).cast("long") - F.lit(one[f"low_{i}"]).cast("long") for i in bits}
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.bitmap_bucket_number(place[i]).alias("bucket"), F.bitmap_bit_position(place[i]).alias("bit")) for i in bits])).alias("x")).select("x.*")
        maps = cells.where("bit IS NOT NULL").groupBy("k", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        found.append(maps.groupBy("k").agg(F.sum(F.bitmap_count("bits")).alias("n")))
    if rest := [i for i in texts if texts[i] is not None and i not in bits]:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), texts[i].alias("value")) for i in rest])).alias("x")).select("x.*")
        found.append(cells.where("value IS NOT NULL").distinct().groupBy("k").agg(F.count("*").alias("n")))
    counts = found[0] if len(found) == 1 else found[0].unionByName(found[1]) if found else rows.select("k", F.lit(0).cast("long").alias("n")).where("false")
    out = rows.join(F.broadcast(counts), "k", "left").orderBy("k")  # a row a column
    return out.select("Column", "Type", "Non-Null", "Null", (F.coalesce("n", F.lit(0)) + F.col("_own")).alias("Unique"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], parts: Sequence[float] = (0.25, 0.5, 0.75)) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column, exact (None without values; NaN counts as none): the values around each rank are found by refinement. A pass counts the values
    in each of RANGES ranges of the interval in which a rank's value lies, with their least and greatest; the range that holds the rank is the next
    interval, until it is one value. A task keeps and the driver gets RANGES rows a rank at most, whatever the number of values."""
    value = {c: F.when(~F.isnan(_col(c).cast("double")), _col(c).cast("double")) for c in columns}
    one = df.agg(*[f(value[c]).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    ranks = {(c, r) for i, c in enumerate(columns) if one[f"n{i}"] for p in parts for r in (math.floor(p * (one[f"n{i}"] - 1)), math.ceil(p * (one[f"n{i}"] - 1)))}
    # rank: least and greatest value that it may have, and how many are less than these
    state = {(c, r): (one[f"low{i}"], one[f"high{i}"], 0) for i, c in enumerate(columns) for (d, r) in ranks if d == c}
    while left := sorted({(c, *state[c, r]) for c, r in ranks if state[c, r][0] < state[c, r][1]}):
        asked = []
        for k, (c, low, high, _) in enumerate(left):
            v, inside = value[c], value[c].between(low, high)
            scale = 1 if math.isfinite(high - low) else 2
            share = (v / scale - low / scale) / (high / scale - low / scale)
            asked.append(F.when(inside, F.struct(F.lit(k).alias("k"), F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int").alias("range"), v.alias("v"))))
        rows = df.select(F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("x")).select("x.*")
        found: dict[int, list] = {}
        for k, at, n, low, high in rows.groupBy("k", "range").agg(F.count("*"), F.min("v"), F.max("v")).collect():
            found.setdefault(k, []).append((at, n, low, high))
        places = {x: k for k, x in enumerate(left)}
        for c, r in ranks:
            if (c, *state[c, r]) not in places:
                continue
            below = state[c, r][2]
            for _, n, low, high in sorted(found[places[(c, *state[c, r])]]):
                if r < below + n:
                    state[c, r] = (low, high, below)
                    break
                below += n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        at = [p * (one[f"n{i}"] - 1) for p in parts]
        ends = [(state[c, math.floor(x)][0], state[c, math.ceil(x)][0]) if one[f"n{i}"] else (None, None) for x in at]
        out[c] = [None if a is None else a + (x - math.floor(x)) * (b - a) for x, (a, b) in zip(at, ends, strict=True)]
    return out


def describe(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """count, mean, std (of a sample), min, quartiles (exact and interpolated, by a few passes over the column; approximate: by mergeable sketches) and max
    of numeric columns, a row a column."""
    columns = list(columns or numeric_columns(df))
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "q": lambda c: F.percentile_approx(c.cast("double"), [0.25, 0.5, 0.75]), "max": F.max}
    one = df.agg(*[f(_col(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in parts.items() if approximate or k != "q"])
    if not approximate:
        exact = exact_quantiles(df, columns)
        one = one.withColumns({f"q_{i}": F.array(*[F.lit(x).cast("double") for x in exact[c]]) for i, c in enumerate(columns)})
    flat = one.select(*[(F.col(f"{k}_{i}").cast("double") if k in ("min", "max") else F.col(f"{k}_{i}")).alias(f"{k}_{i}") for i in range(len(columns)) for k in parts])
    rows = _unpivoted(flat, columns, list(parts), list(parts))
    return rows.select("Column", "count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("25%", "50%", "75%"))], "max")


def confidence(rows: DataFrame, by: Sequence[str] = ("image_path",), value: str = "conf") -> DataFrame:
    """mean, min, max and std (of the population) of confidences, -1 left out; zeros where there is none."""
    good = F.when(F.col(value) != -1, F.col(value).cast("double"))
    out = {"mean": F.avg(good), "min": F.min(good), "max": F.max(good), "std": F.stddev_pop(good)}
    return rows.groupBy(*by).agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in out.items()])


def summary(df: DataFrame) -> DataFrame:
    """rows, columns, column_names, null_counts (of columns that have any) and memory_usage (bytes of the rows as JSON)."""
    one = df.select("*", F.octet_length(F.to_json(F.struct(*[_col(c) for c in df.columns]))).alias("_bytes")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("memory_usage"), *[F.count_if(_col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    counts = F.map_filter(F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.col(f"n_{i}"))]), lambda k, v: v > 0)
    return one.select("rows", F.lit(len(df.columns)).alias("columns"), F.array(*map(F.lit, df.columns)).alias("column_names"), counts.alias("null_counts"), "memory_usage")
