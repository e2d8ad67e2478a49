"""Tables to files: csv, JSON (an array of records) and workbooks, as one file each, of pieces that tasks write (``single``), or a
directory of part files (``write_parts``). Only downloads (``to_bytes``) are made in the driver.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable
from pathlib import Path
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from lectern.config import Config
from lectern.sinks.single import INDENT, json_record, to_file
from lectern.sources.workbook import write_workbook

SUFFIXES = {"excel": ".xlsx", "csv": ".csv", "json": ".json"}


def _rows(df: DataFrame):
    return (tuple(r) for r in df.toLocalIterator(prefetchPartitions=True))  # a partition at a time


def _csv(df: DataFrame, out: TextIO) -> None:
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(_rows(df))


def _json(df: DataFrame, out: TextIO, indent: int = INDENT) -> None:
    out.write("[")
    for k, row in enumerate(_rows(df)):
        out.write(("," if k else "") + json_record(df.columns, row, indent))
    out.write("\n]\n")


def _path(path: str | Path, kind: str) -> str:
    """The path, or URI, with the format's suffix; tasks have other working folders, so that it is absolute."""
    if ":/" not in str(path):
        return str(Path(path).absolute().with_suffix(SUFFIXES[kind]))
    head, _, name = str(path).rpartition("/")
    return f"{head}/{Path(name).with_suffix(SUFFIXES[kind])}"


def to_csv(df: DataFrame, path: str | Path) -> str:
    """'' and no file if df has no rows; so in the other formats."""
    return out if to_file(df, out := _path(path, "csv"), "csv") else ""


def to_json(df: DataFrame, path: str | Path, indent: int = INDENT) -> str:
    return out if to_file(df, out := _path(path, "json"), "json", indent=indent) else ""


def to_excel(df: DataFrame, path: str | Path) -> str:
    return out if to_file(df, out := _path(path, "excel"), "excel") else ""


def to_bytes(df: DataFrame, kind: str = "excel") -> bytes:
    """The file that the sink of this kind writes, as bytes to hand out; for results that fit in the driver's memory."""
    if kind not in WRITERS:
        raise ValueError(f"format must be one of {', '.join(WRITERS)}")
    if kind == "excel":
        write_workbook(buffer := io.BytesIO(), df.columns, _rows(df))
        return buffer.getvalue()
    (_csv if kind == "csv" else _json)(df, text := io.StringIO(newline=""))
    return text.getvalue().encode()


WRITERS: dict[str, Callable[[DataFrame, str | Path], str]] = {"excel": to_excel, "csv": to_csv, "json": to_json}


def output_path(config: Config, kind: str | None = None) -> str:
    kind = kind or config.get("export", "format")
    return f"{config.get('export', 'output_dir').rstrip('/')}/{config.get('export', 'output_filename')}{SUFFIXES.get(kind, '.txt')}"


def export(df: DataFrame, config: Config | None = None, path: str | Path | None = None, kind: str | None = None) -> str:
    """Writes df in the format set (whatever the path's suffix) and returns the path; '' and no file if it has no rows."""
    config = config or Config()
    kind = kind or config.get("export", "format")
    if kind not in WRITERS:
        raise ValueError(f"format must be one of {', '.join(WRITERS)}")
    return WRITERS[kind](df, path or output_path(config, kind))


def export_all(df: DataFrame, config: Config | None = None) -> dict[str, str | None]:
    """A file in each format; None for one that failed. The plan runs once for all."""
    df = df.persist()
    out: dict[str, str | None] = {}
    try:
        for kind in WRITERS:
            try:
                out[kind] = export(df, config, kind=kind) or None
            except (OSError, ValueError, PySparkException):
                out[kind] = None
    finally:
        df.unpersist()
    return out


def write_parts(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A directory of part files: csv with header, or JSON lines with nulls."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)
