"""Tidying of parsed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lectern.plans.storage import stored

#: Factor levels in their order.
LEVELS = {"SECTION": ("OVERALL", "RURAL", "URBAN"), "SEX": ("ALL", "MALE", "FEMALE", "TRANSGENDER")}


def distinct(df: DataFrame, *keys: str) -> DataFrame:
    """Rows without repeats; nulls are equal to nulls."""
    return df.dropDuplicates(list(keys) or None)


def distinct_in_order(df: DataFrame, position: str) -> DataFrame:
    """Rows without repeats, each with the first position it had."""
    return df.groupBy(*[c for c in df.columns if c != position]).agg(F.min(position).alias(position))


def level(column: str, levels: Sequence[str]) -> Column:
    """The place of a value among its levels; values that are none, and null, come last."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(len(levels) + 1))


def factor_sorted(df: DataFrame, levels: dict[str, Sequence[str]] | None = None, first: Sequence[str] = ("REGION",)) -> DataFrame:
    keys = [F.col(c).asc_nulls_last() for c in first if c in df.columns]
    keys += [level(c, x) for c, x in (levels or LEVELS).items() if c in df.columns]
    return df.orderBy(*keys)


def sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending, nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in this order (rows that tie in all of it in any order): ranges of the order are sorted each, and rows are numbered
    within theirs and by the sizes of the ranges before, a number a range, so that no task holds more than a range."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn(name, F.monotonically_increasing_id()), "placed")  # the range above 33 bits, the row in it below
    sizes = dealt.groupBy(F.shiftright(name, 33).alias("_range")).agg(F.count("*").alias("_n")).orderBy("_range").collect()
    before, at = {}, 0
    for part, n in sizes:
        before[part] = at
        at += n
    starts = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1)])
    return dealt.withColumn(name, F.get(starts, F.shiftright(name, 33).cast("int")) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def without_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in one of the columns."""
    return df.na.drop(how="all", subset=[c for c in columns if c in df.columns])


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; what isn't a number becomes null."""
    out = {}
    for c in columns:
        if c in df.columns:
            out[c] = F.col(c).cast("double") if isinstance(df.schema[c].dataType, NumericType) else F.when(F.trim(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(c).try_cast("double"))
    return df.withColumns(out)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def cleaned(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Distinct rows in factor order, numbers typed, rows without any number gone."""
    return factor_sorted(without_empty(as_numbers(distinct(df), numeric), numeric))
