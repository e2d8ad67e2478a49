"""Workbooks (xlsx), with the standard library alone: a Spark data source that reads the first sheet, and the writer behind the sink.

Cells are written as numbers or inline texts and read back as such; the first row names the columns.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice, takewhile
from typing import IO, Any
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MOST_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_WORKBOOK = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
_WORKBOOK_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
PARTS = (("[Content_Types].xml", _CONTENT_TYPES), ("_rels/.rels", _RELATIONS), ("xl/workbook.xml", _WORKBOOK), ("xl/_rels/workbook.xml.rels", _WORKBOOK_RELATIONS))
SHEET = "xl/worksheets/sheet1.xml"


def sheet_name(number: int) -> str:
    return f"xl/worksheets/sheet{number}.xml"


def parts(sheets: int) -> list[tuple[str, str]]:
    """The parts of a workbook of so many sheets, but for these."""

    def repeated(part: str, pattern: str) -> str:
        one = re.search(pattern, part).group()
        number = lambda i: one.replace("sheet1.xml", f"sheet{i}.xml").replace("Sheet1", f"Sheet{i}").replace('"rId1"', f'"rId{i}"').replace('sheetId="1"', f'sheetId="{i}"')
        return part.replace(one, "".join(number(i) for i in range(1, sheets + 1)))

    patterns = {"[Content_Types].xml": r'<Override PartName="/xl/worksheets[^>]*/>', "xl/workbook.xml": r"<sheet [^>]*/>", "xl/_rels/workbook.xml.rels": r"<Relationship [^>]*/>"}
    return [(name, repeated(part, patterns[name]) if name in patterns else part) for name, part in PARTS]


SHEET_START = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN}"><sheetData>'
SHEET_END = "</sheetData></worksheet>"
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def letters(column: int) -> str:
    out = ""
    while column >= 0:
        out = chr(65 + column % 26) + out
        column = column // 26 - 1
    return out


def _cell(value: Any) -> str:
    if value is None or isinstance(value, float) and value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) < 1e15:
        return f'<c><v>{value!r}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", str(value)))}</t></is></c>'


def write_workbook(file: IO[bytes] | str, names: Sequence[str], rows: Iterable[Sequence[Any]]) -> int:
    """Writes rows as they come, so that only one is held; returns how many."""
    count = 0
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in PARTS:
            z.writestr(name, part)
        with z.open(SHEET, "w") as sheet:
            sheet.write((SHEET_START + sheet_row(names)).encode())
            for count, row in enumerate(rows, 1):
                if count >= MOST_ROWS:
                    raise ValueError(f"a sheet holds {MOST_ROWS} rows at most, its header among them")
                sheet.write(sheet_row(row).encode())
            sheet.write(SHEET_END.encode())
    return count


def sheet_row(row: Sequence[Any]) -> str:
    """A row of a sheet; it and its cells, gaps among them, go without references, so that it may stand anywhere."""
    return f"<row>{''.join(map(_cell, row))}</row>"


def _sheets(z: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def read_workbook(file: IO[bytes] | str, number: int = 0) -> Iterator[list[Any]]:
    """Rows of a sheet, the first by default: numbers, booleans, texts, null for gaps."""
    tag = f"{{{MAIN}}}"
    with zipfile.ZipFile(file) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{tag}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{tag}t")))
        sheet = _sheets(z)[number]
        with z.open(sheet) as f:
            rows = None
            for event, element in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    rows = element if element.tag == f"{tag}sheetData" else rows
                    continue
                if element.tag != f"{tag}row":
                    continue
                row: list[Any] = []
                for cell in element.iter(f"{tag}c"):
                    column = 0
                    for c in re.match("[A-Z]+", cell.get("r") or letters(len(row))).group():
                        column = column * 26 + ord(c) - 64
                    row += [None] * (column - 1 - len(row))
                    kind, value = cell.get("t"), cell.find(f"{tag}v")
                    if kind == "inlineStr":
                        row.append("".join(t.text or "" for t in cell.iter(f"{tag}t")))
                    elif value is None or value.text is None:
                        row.append(None)
                    elif kind == "s":
                        row.append(shared[int(value.text)])
                    elif kind == "b":
                        row.append(value.text == "1")
                    elif kind in ("str", "e"):
                        row.append(value.text)
                    else:
                        row.append(float(value.text) if re.search("[.eE]", value.text) else int(value.text))
                yield row
                rows.clear()  # else a row that was read stays, if empty


def _rows_of(path: str, number: int = 0) -> Iterator[list[Any]]:
    from lectern.sources.files import filesystem

    fs, path = filesystem(path)
    with fs.open_input_file(path) as file:
        yield from read_workbook(file, number)


def _continued(path: str) -> list[int]:
    """The first sheet, and those after it as long as they begin with its header, as the sink goes on where a sheet is full."""
    from lectern.sources.files import filesystem

    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as file, zipfile.ZipFile(file) as z:
        n = len(_sheets(z))
    head = next(_rows_of(path), None)
    return [0, *takewhile(lambda i: head and next(_rows_of(path, i), None) == head, range(1, n))]


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(path): a file's first sheet and those that go on from it, a task each; columns are doubles if all their values are numbers, else strings. With a schema given, the file is parsed once."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

        from lectern.operators.schema import unique_names

        rows = _rows_of(self.options["path"])
        names = unique_names([str(x) if x is not None else f"Column_{i + 1}" for i, x in enumerate(next(rows, []))])
        kinds: list[set[type]] = [set() for _ in names]
        for row in chain(rows, *(islice(_rows_of(self.options["path"], i), 1, None) for i in _continued(self.options["path"])[1:])):
            for i, value in enumerate(row[: len(names)]):
                if value is not None:
                    kinds[i].add(type(value))
        out = StructType()
        for name, kind in zip(names, kinds, strict=True):
            out.add(name, BooleanType() if kind == {bool} else LongType() if kind == {int} else DoubleType() if kind and kind <= {int, float} else StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.types = path, [f.dataType.typeName() for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in _continued(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = _rows_of(self.path, partition.value)
        next(rows, None)
        for row in rows:
            row = [*row, *[None] * (len(self.types) - len(row))][: len(self.types)]
            yield tuple(None if v is None else float(v) if t == "double" else str(v) if t == "string" else v for v, t in zip(row, self.types, strict=True))
