"""Filters, shares, grouped sums and reshaping of tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import percent


def with_shares(df: DataFrame, total: str, parts: Sequence[str], suffix: str = "_PCT", digits: int = 2) -> DataFrame:
    return df.withColumns({f"{p}{suffix}": percent(F.col(f"`{p}`"), F.col(f"`{total}`"), digits) for p in parts})


def group_sums(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums without nulls, 0 where all are null."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(f"`{v}`"), F.lit(0)).alias(v) for v in values])


def group_shares(df: DataFrame, by: Sequence[str], total: str, parts: Sequence[str], digits: int = 2) -> DataFrame:
    return with_shares(group_sums(df, by, [total, *parts]), total, parts, digits=digits)


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "Religion", value: str = "Population", positive: bool = False) -> DataFrame:
    out = df.unpivot(list(ids), list(columns), name, value)
    return out.where(F.col(value) > 0) if positive else out


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows with the greatest values, nulls last."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def bottom(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in this order (that of the input, if its order columns are given)."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows, in this order."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n).orderBy(*order)


def statuses(results: DataFrame) -> DataFrame:
    """(input, output, error) to (input, output, status)."""
    return results.select("input", "output", F.when(F.col("error").isNull(), "SUCCESS").otherwise(F.concat(F.lit("FAILED: "), F.col("error"))).alias("status"))


def status_counts(batch: DataFrame) -> DataFrame:
    ok = F.col("status") == "SUCCESS"
    return batch.agg(F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))
