"""The parts of an extraction as objects that share settings: fetch, convert, recognise, parse, export."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lectern.config import Config
from lectern.operators.profile import confidence, summary
from lectern.plans.extract import extract
from lectern.sinks.files import export, export_all
from lectern.sources.decode import confidences, decoded, lines_of, page_images, pages_of
from lectern.sources.fetch import fetched
from lectern.sources.files import IMAGES, listed, url_table


class _Part:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()


class Downloader(_Part):
    def urls(self) -> DataFrame:
        d = self.config.get("download")
        return url_table(self.spark, d["base_url"], d["file_pattern"], *d["district_range"], d["data_type"])

    def download(self, urls: DataFrame | None = None) -> DataFrame:
        """(url, status, attempts, content, error)."""
        d = self.config.get("download")
        return fetched(urls if urls is not None else self.urls(), timeout=d["timeout"], delay=d["delay_seconds"])

    def local(self, paths: str | Sequence[str]) -> DataFrame:
        """PDF files of these folders, paths or patterns."""
        return listed(self.spark, paths, content=True)


class Converter(_Part):
    def convert(self, files: DataFrame) -> DataFrame:
        """(path, page, image, error) of PDF files (path, content)."""
        c = self.config.get("conversion")
        dpi, kind = c["dpi"], c["image_format"]
        return pages_of(files, lambda content: page_images(content, dpi, kind))

    def images(self) -> DataFrame:
        return listed(self.spark, self.config.get("conversion", "output_dir"), IMAGES, content=True)


class Recogniser(_Part):
    """OCR of images (path, content); only the engine tesseract is there."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        super().__init__(spark, config)
        if self.config.get("ocr", "engine") != "tesseract":
            raise ValueError("ocr.engine must be tesseract")

    def read(self, images: DataFrame) -> DataFrame:
        """Rows of cells with their order, or an error."""
        import io

        o = self.config.get("ocr")
        pre, options = o["preprocessing"], o["tesseract_config"]

        def by_settings(content: bytes) -> list[list[list[str]]]:
            from PIL import Image

            from lectern.sources.decode import recognised

            return [recognised(Image.open(io.BytesIO(content)), options, pre["resize_factor"], False, pre["interpolation"], pre["grayscale"])]

        return decoded(images, ("ocr",), {"ocr": by_settings})

    def confidence(self, images: DataFrame) -> DataFrame:
        return confidence(confidences(images))


class Parser(_Part):
    def parse(self, rows: DataFrame) -> DataFrame:
        """A table of recognised rows, or of lines."""
        return extract(rows if "line" in rows.columns else lines_of(rows), self.config)


class Exporter(_Part):
    def export(self, table: DataFrame, path: str | Path | None = None) -> str:
        return export(table, self.config, path)

    def export_all(self, table: DataFrame) -> dict[str, str | None]:
        return export_all(table, self.config)

    def summary(self, table: DataFrame) -> dict:
        return summary(table).first().asDict()

    def print_summary(self, table: DataFrame) -> None:
        for key, value in self.summary(table).items():
            if isinstance(value, dict):
                print(f"{key}:", *(f"  {k}: {v}" for k, v in value.items()), sep="\n")
            else:
                print(f"{key}: {value}")
