"""One file of any size, written by many tasks: a Spark data source whose tasks write pieces, in the order of the rows, and whose commit joins them.

Pieces are bytes that can stand one after the other: csv rows, JSON records, or rows of a sheet as a deflate stream that ends at a byte without ending the
stream, with their CRC and length, so that a workbook's zip entry is made without inflating anything. The commit copies bytes; no row
passes the driver. A piece's name is its attempt's own, so that lost and repeated tasks don't meet; the commit, or the abort, deletes all of them.
"""

from __future__ import annotations

import contextlib
import csv
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, islice
from typing import Any

from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.sources.files import filesystem
from lectern.sources.workbook import MOST_ROWS, SHEET_END, SHEET_START, parts, sheet_name, sheet_row

KINDS = ("csv", "json", "excel")
#: About so many characters are rendered before they are written.
CHUNK = 1 << 20
INDENT = 2
#: A task's piece of a sheet holds so many rows at most; what is more is its next piece.
SHEET_PIECE = 1 << 16
#: The last block of a deflate stream, empty.
LAST_BLOCK = b"\x03\x00"


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two runs of bytes one after the other, from theirs and the second one's size: the first one's state is taken on by as many
    zero bytes, which is a linear map of its bits, raised to that power by squaring."""

    def applied(rows: list[int], bits: int) -> int:
        out = 0
        for i in range(32):
            if bits >> i & 1:
                out ^= rows[i]
        return out

    step = [0xEDB88320] + [1 << i for i in range(31)]  # a zero bit
    for _ in range(3):
        step = [applied(step, x) for x in step]
    while size:
        if size & 1:
            first = applied(step, first)
        step = [applied(step, x) for x in step]
        size >>= 1
    return first ^ second


def json_record(names: Sequence[str], row: Sequence[Any], indent: int = INDENT) -> str:
    text = json.dumps(dict(zip(names, row, strict=True)), ensure_ascii=False, indent=indent, default=str)
    return "\n" + "\n".join(" " * indent + x for x in text.split("\n"))


def csv_row(row: Sequence[Any]) -> str:
    csv.writer(out := io.StringIO(newline="")).writerow(row)
    return out.getvalue()


@dataclass
class Piece(WriterCommitMessage):
    partition: int
    path: str
    rows: int
    size: int  # bytes in the file
    raw: int  # bytes before deflate
    crc: int


@dataclass
class Pieces(WriterCommitMessage):
    pieces: list[Piece]


class PiecesWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path, self.kind, self.job = list(schema.names), options["path"], options["kind"], options["job"]
        self.indent = int(options.get("indent", INDENT))
        self.most = int(options.get("sheet_rows", MOST_ROWS))

    def _rendered(self, rows: Iterator) -> Iterator[tuple[int, bytes]]:
        """Rows as bytes, many at a time, with their number."""
        held, size, n = [], 0, 0
        for row in rows:
            text = csv_row(row) if self.kind == "csv" else json_record(self.names, row, self.indent) if self.kind == "json" else sheet_row(row)
            if self.kind == "json" and n:
                text = "," + text
            held.append(text)
            size += len(text)
            n += 1
            if size > CHUNK:
                yield len(held), "".join(held).encode()
                held, size = [], 0
        if held:
            yield len(held), "".join(held).encode()

    def write(self, iterator: Iterator) -> Pieces:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = filesystem(self.path)
        partition = context.partitionId() if context else 0
        pieces: list[Piece] = []
        if self.kind == "excel":
            for row in iterator:  # each piece takes the rows up to its bound
                pieces.append(self._piece(fs, f"{base}.{self.job}", partition, chain([row], islice(iterator, min(SHEET_PIECE, self.most - 1) - 1))))
        else:
            pieces.append(self._piece(fs, f"{base}.{self.job}", partition, iterator))
        return Pieces(pieces)

    def _piece(self, fs, folder: str, partition: int, rows: Iterator) -> Piece:
        piece = Piece(partition, f"{folder}/{uuid.uuid4().hex}", 0, 0, 0, 0)
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15) if self.kind == "excel" else None
        try:
            with fs.open_output_stream(piece.path) as out:
                for n, data in self._rendered(rows):
                    piece.rows += n
                    piece.raw += len(data)
                    piece.crc = zlib.crc32(data, piece.crc)
                    data = deflate.compress(data) if deflate else data
                    piece.size += out.write(data)
                if deflate:
                    piece.size += out.write(deflate.flush(zlib.Z_FULL_FLUSH))
        except BaseException:
            with contextlib.suppress(OSError):  # it may have gone with the folder
                fs.delete_file(piece.path)
            raise
        return piece

    def commit(self, messages: list[Pieces | Piece | None]) -> None:
        pieces = [p for m in messages if m is not None for p in (m.pieces if isinstance(m, Pieces) else [m]) if p.rows]
        pieces.sort(key=lambda p: p.partition)  # those of a task keep their order
        fs, base = filesystem(self.path)
        try:
            if self.kind == "excel" and any(p.rows >= self.most for p in pieces):
                raise ValueError(f"a sheet holds {MOST_ROWS} rows at most, its header among them")
            if pieces:
                with fs.open_output_stream(f"{base}.{self.job}.whole") as out:
                    (self._workbook if self.kind == "excel" else self._text)(fs, out, pieces)
        finally:
            self._forget()

    def abort(self, messages: list[Piece | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        """Deletes the folder of the pieces. Tasks don't make it, so that those that are still ending can't bring it back."""
        fs, base = filesystem(self.path)
        folder = f"{base}.{self.job}"
        for _ in range(10):  # a task may open its piece in between
            with contextlib.suppress(OSError):
                fs.delete_dir(folder)
            if fs.get_file_info(folder).type == FileType.NotFound:
                break

    @staticmethod
    def _copied(fs, piece: Piece, out) -> None:
        with fs.open_input_stream(piece.path) as source:
            while data := source.read(1 << 20):
                out.write(data)

    def _text(self, fs, out, pieces: list[Piece]) -> None:
        out.write((csv_row(self.names) if self.kind == "csv" else "[").encode())
        for i, piece in enumerate(pieces):
            if i and self.kind == "json":
                out.write(b",")
            self._copied(fs, piece, out)
        if self.kind == "json":
            out.write(b"\n]\n")

    def _workbook(self, fs, out, pieces: list[Piece]) -> None:
        def deflated(data: bytes) -> bytes:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            return packer.compress(data) + packer.flush(zlib.Z_FULL_FLUSH)

        sheets: list[list[Piece]] = [[]]
        for piece in pieces:  # a sheet takes pieces while they fit, and each has the header
            if sum(p.rows for p in sheets[-1]) + piece.rows >= self.most:
                sheets.append([])
            sheets[-1].append(piece)
        head, tail = (SHEET_START + sheet_row(self.names)).encode(), SHEET_END.encode()
        first, last = deflated(head), deflated(tail) + LAST_BLOCK
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, part in parts(len(sheets)):
                z.writestr(name, part)
            for number, own in enumerate(sheets, 1):
                crc, raw = zlib.crc32(head), len(head)
                for crc_of, size in (*((p.crc, p.raw) for p in own), (zlib.crc32(tail), len(tail))):
                    crc, raw = joined_crc(crc, crc_of, size), raw + size
                entry = zipfile.ZipInfo(sheet_name(number), (1980, 1, 1, 0, 0, 0))
                entry.compress_type = zipfile.ZIP_DEFLATED
                entry.CRC, entry.file_size, entry.compress_size = crc, raw, len(first) + sum(p.size for p in own) + len(last)
                entry.header_offset = z.fp.tell()
                z.fp.write(entry.FileHeader())
                z.fp.write(first)
                for piece in own:
                    self._copied(fs, piece, z.fp)
                z.fp.write(last)
                z.filelist.append(entry)
                z.NameToInfo[entry.filename] = entry
                z.start_dir, z._didModify = z.fp.tell(), True


class SingleFile(DataSource):
    """df.write.format("single_file").option("path", ...).option("kind", "csv" | "json" | "excel")."""

    @classmethod
    def name(cls) -> str:
        return "single_file"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        fs, base = filesystem(self.options["path"])
        fs.create_dir(f"{base}.{self.options['job']}")
        return PiecesWriter(schema, self.options)


def to_file(df: DataFrame, path: str, kind: str, **options: object) -> bool:
    """Writes df's rows, in their order, as one file, in a folder (or URI) that driver and executors share; False and no file if there are none."""
    spark, job = df.sparkSession, f"pieces-{uuid.uuid4().hex}"
    spark.dataSource.register(SingleFile)
    writer = df.write.format("single_file").mode("append").option("path", path).option("kind", kind).option("job", job)
    for name, value in options.items():
        writer = writer.option(name, str(value))
    try:
        writer.save()
    except Exception as error:
        if "a sheet holds" in str(error):
            raise ValueError(f"a sheet holds {MOST_ROWS} rows at most, its header among them") from error
        raise
    fs, base = filesystem(path)
    whole = f"{base}.{job}.whole"
    if fs.get_file_info(whole).type == FileType.NotFound:
        return False
    fs.move(whole, base)
    return True
