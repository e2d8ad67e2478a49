"""Census pages: region and section headers that hold until the next one, and a line of numbers for each sex.

One operator serves all variants; a preset says how they differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions.text import contains_any, one_of, split_words
from lectern.operators.lines import after_marker, carried_all, stripped

#: Words of census pages and names of their columns.
SECTIONS = ("OVERALL", "RURAL", "URBAN")
SEXES = ("ALL SEXES", "MALE", "FEMALE", "TRANSGENDER")
HIERARCHY = ("TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "QADIANI/AHMADI", "SCHEDULED CASTES", "OTHERS")
FLAT = ("TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "QADIANI_AHMADI", "SCHEDULED_CASTES", "OTHERS")
REGIONS = ("DISTRICT", "SUB-DIVISION")
REGIONS_PAGES = ("DISTRICT", "SUB-DIVISION", "CONSTITUENCY", "DIVISION")
REGIONS_SMART = ("DISTRICT", "SUB-DIVISION", "CONSTITUENCY", "DIVISION", "TEHSIL", "TALUKA")
#: The line that numbers the columns, before the first row of data.
MARKER = r"(?U)^1\s+2\s+3\s+4"


@dataclass(frozen=True)
class Preset:
    regions: tuple[str, ...] = REGIONS
    fold_region: bool = False
    fold_section: bool = False
    fold_sex: bool = False
    scope: str = "source"
    first_page: bool = False
    skip_to_marker: bool = False
    repair: tuple[str, str] = ("", "")
    dashes: tuple[str, ...] = ("-",)
    #: What becomes of a dash: null, '' or left out.
    dash: str = "null"
    #: What becomes of a token that isn't a number: left out or kept as text.
    other: str = "drop"
    #: long, double (decimals count) or text.
    values: str = "long"
    #: Rows with fewer values go (min), or are filled with nulls (pad).
    arity: str = "min"
    #: Label of a row: verbatim (ALL SEXES), short (ALL), or the first word, if it isn't one of the two long ones.
    label: str = "short"
    names: tuple[str, ...] = FLAT
    sex_name: str = "SEX"
    #: Region and section of rows before any header: '' or null.
    missing: str | None = ""
    page: bool = False
    source_image: bool = False


PRESETS = {
    "hierarchical": Preset(first_page=True, skip_to_marker=True, values="double", arity="pad", label="verbatim", names=HIERARCHY, sex_name="AREA/SEX", missing=None),
    "improved": Preset(first_page=True, skip_to_marker=True, other="keep", values="text", arity="pad", label="verbatim", names=HIERARCHY, sex_name="AREA/SEX", missing=None),
    "smart": Preset(regions=REGIONS_SMART, fold_region=True, fold_section=True, fold_sex=True, repair=N.REPAIR_SMART, dashes=N.DASHES),
    "multipage": Preset(regions=REGIONS_PAGES, fold_region=True, fold_section=True, fold_sex=True, scope="page", repair=N.REPAIR_PAGES, page=True),
    "complete": Preset(repair=N.REPAIR_PLAIN, dash="empty", values="text", label="word"),
    "r_complete": Preset(fold_region=True, repair=N.REPAIR_R, dashes=N.DASHES, dash="drop", missing=None, source_image=True),
}


def _values(tokens: Column, p: Preset) -> Column:
    """The row's values, one a token that counts."""
    letters, digits = p.repair
    clean = F.transform(tokens, lambda t: F.translate(F.translate(t, ",", ""), letters, digits))
    if p.dash == "drop":
        clean = F.filter(clean, lambda t: ~N.is_dash(t, p.dashes) & (t != ""))

    def value(t: Column) -> Column:
        void = N.is_dash(t, p.dashes) | (t == "")
        if p.values == "double":
            return F.struct((void | N.decimal(t).isNotNull()).alias("kept"), F.when(~void, N.decimal(t)).alias("value"))
        if p.values == "long":
            return F.struct(((void & (t != "")) | N.is_digits(t)).alias("kept"), F.when(~void & N.is_digits(t), t.try_cast("bigint")).alias("value"))
        if p.other == "keep":
            return F.struct(F.lit(True).alias("kept"), F.when(~void, F.coalesce(N.whole(t).cast("string"), t)).alias("value"))
        return F.struct(((void & (t != "")) | N.is_digits(t)).alias("kept"), F.when(void, F.lit("")).otherwise(t).alias("value"))

    return F.transform(F.filter(F.transform(clean, value), lambda v: v["kept"]), lambda v: v["value"])


def parse_census(lines: DataFrame, preset: str | Preset = "smart", long: bool = False) -> DataFrame:
    """lines to one row a sex line: region, section, label and seven values, with source (and page), in any order; sort by line_no.

    One exchange by source serves all windows; long sources go by blocks. Context is carried before lines are filtered.
    """
    p = PRESETS[preset] if isinstance(preset, str) else preset
    rows = stripped(lines)
    if p.first_page:
        rows = rows.where(F.col("page") == 1)
    if p.skip_to_marker:
        rows = after_marker(rows, MARKER, long=long)
    line = F.col("line")
    is_region = contains_any(line, p.regions, upper=p.fold_region)
    is_section = ~is_region & one_of(line, SECTIONS, upper=p.fold_section)
    kind = F.when(is_region, "region").when(is_section, "section")
    rows = rows.withColumn("_kind", kind)
    section = F.when(F.col("_kind") == "section", F.upper(line) if p.fold_section else line)
    rows = carried_all(rows, {"REGION": F.when(F.col("_kind") == "region", line), "SECTION": section}, p.scope, long)
    sex = ("(?i)" if p.fold_sex else "") + "^(" + "|".join(SEXES) + ")"
    rows = rows.where(F.col("_kind").isNull()).withColumn("_label", F.upper(F.regexp_extract("line", sex, 1))).where(F.col("_label") != "")
    tokens = split_words(line)
    if p.label == "word":  # the label is a word or two, whatever it goes on with
        rest = F.when(F.col("_label") == "ALL SEXES", F.slice(tokens, 3, F.size(tokens))).otherwise(F.slice(tokens, 2, F.size(tokens)))
        label = F.when(F.col("_label") == "ALL SEXES", "ALL").when(F.col("_label") == "TRANSGENDER", F.col("_label")).otherwise(F.get(tokens, F.lit(0)))
        rows = rows.where(F.size(tokens) > 1)
    else:
        # a label that goes on (MALES) isn't cut off, except where the rest of the line is taken by its length
        cut = F.substring(line, F.length("_label") + 1, F.length(line)) if p.label == "verbatim" else F.regexp_replace(line, f"(?U){sex}\\s+" if not p.fold_sex else f"(?iU)^({'|'.join(SEXES)})\\s+", "")
        rest = split_words(cut)
        label = F.col("_label") if p.label == "verbatim" else F.when(F.col("_label") == "ALL SEXES", "ALL").otherwise(F.col("_label"))
    rows = rows.withColumn("_values", _values(rest, p))
    if p.arity == "min":
        rows = rows.where(F.size("_values") >= len(p.names))
    context = [F.col(c) if p.missing is None else F.coalesce(F.col(c), F.lit(p.missing)) for c in ("REGION", "SECTION")]
    out = [context[0].alias("REGION"), context[1].alias("SECTION"), label.alias(p.sex_name)]
    out += [F.get("_values", F.lit(i)).alias(name) for i, name in enumerate(p.names)]
    out += [F.col("source").alias("SOURCE_IMAGE")] * p.source_image
    return rows.select("source", *[F.col("page").alias("PAGE")] * p.page, "line_no", *out)
