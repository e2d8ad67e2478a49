"""Text of PDF files and images, by libraries that may be absent; then each file gets an error instead of failing the job.

A decoder maps a file's bytes to pages, each a list of rows of cells. Several are tried in order, and the first that finds anything wins.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decoder = Callable[[bytes], list[list[list[str]]]]
SCHEMA = "source string, page int, row_no int, cells array<string>, method string, error string"
#: Settings that keep only ruled tables.
STRICT = {"vertical_strategy": "lines_strict", "horizontal_strategy": "lines_strict", "snap_tolerance": 3, "join_tolerance": 3}


def _cells(row: Sequence[str | None]) -> list[str]:
    return [(c or "").strip() for c in row]


def text_layer(content: bytes, tables: str = "fallback", settings: dict | None = None, shortest: int = 0) -> list[list[list[str]]]:
    """Text lines of each page; tables: 'fallback' where a page has no text, 'first' where it has tables."""
    import pdfplumber

    pages = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            lines = [[x.strip()] for x in (page.extract_text() or "").split("\n") if len(x.strip()) > shortest]
            if tables == "first" or not lines:
                rows = [_cells(r) for t in page.extract_tables(settings or {}) for r in t if any(c and c.strip() for c in r)]
                lines = rows or lines
            pages.append(lines)
    return pages


def tables_first(content: bytes) -> list[list[list[str]]]:
    """Tables of a page that has any, else its text lines."""
    return text_layer(content, "first")


def is_scanned(content: bytes, most: int = 100) -> bool:
    """Whether a PDF's first page has too little text for a text layer; true for one that can't be read."""
    import pdfplumber

    try:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return not pdf.pages or len((pdf.pages[0].extract_text() or "").strip()) <= most
    except Exception:  # noqa: BLE001  whatever a library makes of a broken file
        return True


def ruled_tables(content: bytes) -> list[list[list[str]]]:
    return text_layer(content, "first", STRICT)


def rasterised(content: bytes, dpi: int = 300, last: int | None = None) -> list:
    from pdf2image import convert_from_bytes

    return convert_from_bytes(content, dpi=dpi, last_page=last)


def page_images(content: bytes, dpi: int = 300, kind: str = "JPEG") -> list[bytes]:
    """Each page of a PDF as an encoded image."""
    out = []
    for image in rasterised(content, dpi):
        image.save(buffer := io.BytesIO(), kind)
        out.append(buffer.getvalue())
    return out


#: Ways to enlarge; another name counts as cubic.
INTERPOLATIONS = {"nearest": "NEAREST", "linear": "BILINEAR", "cubic": "BICUBIC", "area": "BOX", "lanczos4": "LANCZOS"}


def prepared(image, grey: bool = True, factor: float = 1.2, interpolation: str = "cubic"):
    """An image ready for OCR: in grey, enlarged unless the factor is 1."""
    image = image.convert("L") if grey else image
    if factor == 1.0:
        return image
    from PIL import Image

    return image.resize((round(image.width * factor), round(image.height * factor)), getattr(Image.Resampling, INTERPOLATIONS.get(interpolation, "BICUBIC")))


def recognised(image, config: str = "--psm 6 --oem 1", factor: float = 1.2, wide: bool = False, interpolation: str = "cubic", grey_scale: bool = True) -> list[list[str]]:
    """Rows of an image by OCR, cells between wide gaps if asked for."""
    import re

    import pytesseract

    grey = prepared(image, grey_scale, factor, interpolation)
    lines = [x.strip() for x in pytesseract.image_to_string(grey, config=config).split("\n") if x.strip()]
    return [re.split(r"\s{2,}", x) if wide else [x] for x in lines]


def ocr_pdf(content: bytes) -> list[list[list[str]]]:
    return [recognised(image, wide=True) for image in rasterised(content)]


def ocr_lines(content: bytes) -> list[list[list[str]]]:
    """OCR of a PDF with one cell a line."""
    return [recognised(image) for image in rasterised(content)]


def ocr_first_page(content: bytes) -> list[list[list[str]]]:
    return [recognised(image, wide=True) for image in rasterised(content, last=1)]


#: A layout model: a file's bytes to items of each page (text, bbox as corners [x, y], confidence).
Layout = Callable[[bytes], list[list[dict]]]


def by_layout(model: Layout, least: float = 0.0) -> Decoder:
    """A decoder of a layout model's items: a row an item, by the height of its first corner; items of less confidence go."""

    def decode(content: bytes) -> list[list[list[str]]]:
        pages = []
        for items in model(content):
            good = [x for x in items if x.get("text") and (x.get("confidence") or 0.0) >= least]
            pages.append([[x["text"].strip()] for x in sorted(good, key=lambda x: (x["bbox"][0][1] if x.get("bbox") else float("inf"), x["text"]))])
        return pages

    return decode


def layout_items(files: DataFrame, model: Layout) -> DataFrame:
    """files (path, content) to (source, page, text, bbox, confidence), pages from 1; none for a file that the model can't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("source", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("bbox", pa.list_(pa.list_(pa.float64()))), ("confidence", pa.float64())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    pages = model(content.as_py())
                except Exception:  # noqa: BLE001  a file that can't be read has no items
                    pages = []
                rows = [{"source": path, "page": p, "text": x.get("text"), "bbox": x.get("bbox"), "confidence": x.get("confidence")} for p, items in enumerate(pages, 1) for x in items]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, "source string, page int, text string, bbox array<array<double>>, confidence double")


def ocr_image(content: bytes) -> list[list[list[str]]]:
    from PIL import Image

    return [recognised(Image.open(io.BytesIO(content)))]


def plain_text(content: bytes) -> list[list[list[str]]]:
    """UTF-8 text with form feeds between pages."""
    return [[[x.strip()] for x in page.split("\n") if x.strip()] for page in content.decode().split("\f")]


DECODERS: dict[str, Decoder] = {
    "text": text_layer, "tables": ruled_tables, "tables_first": tables_first, "ocr": ocr_pdf, "ocr_lines": ocr_lines, "ocr_first_page": ocr_first_page, "image": ocr_image, "plain": plain_text,
}


def decoded(files: DataFrame, methods: Sequence[str] = ("text", "ocr"), decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """files (path, content) to rows of cells with their order and the method that found them; a row with an error for a file that none could read.

    Pages count from 1. A method that finds nothing hands over to the next; what it raised is kept if all fail.
    """
    chosen = [(m, (decoders or DECODERS)[m]) for m in methods]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("source", pa.string()), ("page", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("method", pa.string()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, errors = [], []
                for method, decode in chosen:
                    try:
                        pages = decode(content.as_py())
                    except Exception as e:  # noqa: BLE001  whatever a library makes of a broken file is that file's error
                        errors.append(f"{method}: {type(e).__name__}: {e}")
                        continue
                    rows = [{"source": path, "page": p, "row_no": i, "cells": cells, "method": method, "error": None} for p, page in enumerate(pages, 1) for i, cells in enumerate(page)]
                    if rows:
                        break
                yield pa.RecordBatch.from_pylist(rows or [{"source": path, "page": None, "row_no": None, "cells": None, "method": None, "error": "; ".join(errors) or "no text"}], schema=kinds)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def confidences(files: DataFrame, scores: Callable[[bytes], list[float]] | None = None) -> DataFrame:
    """(image_path, conf): the confidence of each word of an image, -1 for what isn't one; none for an image that can't be read."""

    def by_ocr(content: bytes) -> list[float]:
        import pytesseract
        from PIL import Image

        return [float(c) for c in pytesseract.image_to_data(Image.open(io.BytesIO(content)), output_type=pytesseract.Output.DICT)["conf"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    found = (scores or by_ocr)(content.as_py())
                except Exception:  # noqa: BLE001  an image that can't be read has no words
                    found = []
                rows += [(path, float(c)) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["image_path", "conf"])

    return files.select("path", "content").mapInArrow(run, "image_path string, conf double")


def pages_of(files: DataFrame, render: Callable[[bytes], list[bytes]] = page_images) -> DataFrame:
    """(path, page, image, error): a row a page, pages from 0; one row with the error for a file that can't be rendered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("page", pa.int32()), ("image", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [{"path": path, "page": i, "image": x, "error": None} for i, x in enumerate(render(content.as_py()))]
                except Exception as e:  # noqa: BLE001  a broken file is a row
                    rows = [{"path": path, "page": None, "image": None, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, "path string, page int, image binary, error string")


def lines_of(rows: DataFrame) -> DataFrame:
    """Decoded rows as lines."""
    good = rows.where("error IS NULL")
    return good.select("source", "page", F.col("row_no").alias("line_no"), F.array_join(F.filter("cells", lambda c: c.isNotNull() & (c != "")), " ").alias("line"))
