"""Dirty numbers: repair of misread digits, typing of cells, thousands written as separate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASHES = ("-", "—")
#: Letters that stand for digits in misread numbers, by kind of document.
REPAIR_TABLE = ("OolISZ", "001152")
REPAIR_SMART = ("OoZzSslI", "00225511")
REPAIR_PAGES = ("OoZzSs", "002255")
REPAIR_PLAIN = ("Zso", "250")
REPAIR_R = ("ZzSsOo", "225500")

#: A cell is a whole number, a decimal number or a text; all three null means no value.
CELL = "struct<i:bigint,d:double,s:string>"


def repaired(token: Column, table: tuple[str, str] = REPAIR_TABLE, drop: str = ", ") -> Column:
    letters, digits = table
    return F.translate(F.translate(token, drop, ""), letters, digits)


def is_dash(token: Column, dashes: tuple[str, ...] = DASHES) -> Column:
    return token.isin(*dashes)


def is_digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def whole(token: Column) -> Column:
    """A whole number, or null if it isn't one or has more digits than fit."""
    return F.when(token.rlike("^[+-]?[0-9]+$"), token.try_cast("bigint"))


def decimal(token: Column) -> Column:
    """A number in digits with at most one point, or null. Guarded by a pattern: casts take more than that."""
    return F.when(token.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), token.try_cast("double"))


def cell(token: Column, table: tuple[str, str] = REPAIR_TABLE, dashes: tuple[str, ...] = DASHES) -> Column:
    """A token typed: null for a dash, else a number after repair, else the token as it stands."""
    clean = repaired(token, table)
    i = F.when(is_digits(clean), clean.try_cast("bigint"))
    d = F.when(clean.rlike(r"^([0-9]+\.[0-9]*|\.[0-9]+)$"), clean.try_cast("double"))
    s = F.when(~is_dash(clean, dashes) & i.isNull() & d.isNull(), token)
    return F.struct(i.alias("i"), d.alias("d"), s.alias("s"))


def cell_text(c: Column) -> Column:
    """A typed cell as text, whole decimals without their point, null for no value."""
    d = F.when(c["d"] == F.floor(c["d"]), F.floor(c["d"]).cast("string")).otherwise(c["d"].cast("string"))
    return F.coalesce(c["i"].cast("string"), d, c["s"])


def regrouped(cells: Column, apply: Column) -> Column:
    """Typed cells with ALL, SEXES made one, and, where apply holds, thousands written as groups made one number.

    A whole number below 1000 takes up to two further groups (100 to 999) if it is 4 or less, else one; a number that starts with such a
    group but has none after it stays as it is.
    """
    state = "struct<out:array<{c}>,acc:bigint,left:int>".format(c=CELL)
    none = F.lit(None).cast("bigint")
    empty = F.lit(None).cast("string")

    def number(n: Column) -> Column:
        return F.array(F.struct(n.alias("i"), F.lit(None).cast("double").alias("d"), empty.alias("s")))

    def flushed(acc: Column) -> Column:
        return F.when(acc["acc"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], number(acc["acc"])))

    def packed(out: Column, value: Column, left: Column) -> Column:
        return F.struct(out.alias("out"), value.cast("bigint").alias("acc"), left.cast("int").alias("left"))

    def step(acc: Column, x: Column) -> Column:
        joins = acc["acc"].isNotNull() & (acc["left"] > 0) & x["i"].between(100, 999)
        opens = apply & x["i"].isNotNull() & (x["i"] < 1000)
        last = F.try_element_at(acc["out"], F.lit(-1))
        sexes = acc["acc"].isNull() & (F.upper(x["s"]) == "SEXES") & (F.upper(last["s"]) == "ALL")
        both = F.array(F.struct(none.alias("i"), F.lit(None).cast("double").alias("d"), F.lit("ALL SEXES").alias("s")))
        return (
            F.when(F.coalesce(joins, F.lit(False)), packed(acc["out"], acc["acc"] * 1000 + x["i"], acc["left"] - 1))
            .when(F.coalesce(opens, F.lit(False)), packed(flushed(acc), x["i"], F.when(x["i"] <= 4, 2).otherwise(1)))
            .when(F.coalesce(sexes, F.lit(False)), packed(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), both), none, F.lit(0)))
            .otherwise(packed(F.concat(flushed(acc), F.array(x)), none, F.lit(0)))
        ).cast(state)

    start = F.struct(F.array().cast(f"array<{CELL}>").alias("out"), none.alias("acc"), F.lit(0).cast("int").alias("left")).cast(state)
    return F.aggregate(cells, start, step, flushed)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """Half to even, null where the total is 0 or null."""
    return F.bround(F.try_divide(part.cast("double"), total.cast("double")) * 100, digits)
