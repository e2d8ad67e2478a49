"""Column names by number of columns, and ragged rows made even."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def names_for(mappings: dict[str, list[str]], n: int, prefix: str = "census") -> list[str] | None:
    """The names of a row of n columns: {prefix}_religion_{n}, else {prefix}_standard whatever n, else the first mapping of n names."""
    for key in (f"{prefix}_religion_{n}", f"{prefix}_standard"):
        if key in mappings:
            return list(mappings[key])
    return next((list(names) for names in mappings.values() if len(names) == n), None)


def names_column(mappings: dict[str, list[str]], n: Column, prefix: str = "census") -> Column:
    """names_for as an expression, for rows of any width: one literal branch for each mapping that can apply."""
    literal = lambda names: F.array(*map(F.lit, names))
    if f"{prefix}_standard" in mappings:
        out = literal(mappings[f"{prefix}_standard"])
    else:
        out = F.lit(None).cast("array<string>")
        for names in reversed(list(mappings.values())):  # the first of a length comes last and wins
            out = F.when(n == len(names), literal(names)).otherwise(out)
    for key, names in mappings.items():
        width = key.removeprefix(f"{prefix}_religion_")
        if width != key and width.isdecimal() and key == f"{prefix}_religion_{int(width)}":
            out = F.when(n == int(width), literal(names)).otherwise(out)
    return F.when(n > 0, out)


def mapping_table(spark: SparkSession, mappings: dict[str, list[str]]) -> DataFrame:
    rows = [(i, key, names, len(names)) for i, (key, names) in enumerate(mappings.items())]
    return spark.createDataFrame(rows, "ord int, key string, names array<string>, n_cols int")


def looked_up(rows: DataFrame, mappings: DataFrame, n: str, prefix: str = "census") -> DataFrame:
    """rows with names, by a join on a small table of mappings (a row a key) with the priorities of names_for."""
    m = F.broadcast(mappings)  # configuration, not data
    exact = F.col("key") == F.concat(F.lit(f"{prefix}_religion_"), F.col(n).cast("string"))
    standard = F.col("key") == f"{prefix}_standard"
    priority = F.when(exact, 0).when(standard, 1).otherwise(2)
    widths = rows.select(n).distinct().join(m, exact | standard | (F.col("n_cols") == F.col(n)), "left")
    best = widths.groupBy(n).agg(F.min_by("names", F.struct(priority, F.col("ord"))).alias("names"))
    return rows.join(best, n, "left")


def unique_names(names: Sequence[str]) -> list[str]:
    """Names that repeat (whatever their case) get _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        k = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        new = name if k == 1 else f"{name}_{k}"
        while k > 1 and new.lower() in seen:
            k += 1
            new = f"{name}_{k}"
        seen.setdefault(new.lower(), 1)
        out.append(new)
    return out


def widest(rows: DataFrame, cells: str = "cells") -> int:
    """The longest row: one aggregate, one number to the driver."""
    return rows.agg(F.coalesce(F.max(F.size(cells)), F.lit(0))).first()[0]


def evened(rows: DataFrame, names: Sequence[str], width: int, cells: str = "cells", prefix: str = "Column_", first: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """A column a cell: missing cells are null, missing names numbered by place, surplus names dropped."""
    every = unique_names([*names[:width], *[f"{prefix}{k + first}" for k in range(len(names), width)]])
    return rows.select(*keep, *[F.get(cells, F.lit(k)).alias(name) for k, name in enumerate(every)])


def named(rows: DataFrame, names: Sequence[str], values: str = "record", keep: Sequence[str] = ()) -> DataFrame:
    """A column a key of a map; missing keys are null."""
    return rows.select(*[F.try_element_at(values, F.lit(n)).alias(n) for n in names], *keep)


def union_ragged(first: DataFrame, *more: DataFrame) -> DataFrame:
    out = first
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
