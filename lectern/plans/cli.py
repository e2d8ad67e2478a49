"""python -m lectern.plans.cli: documents to a table in a file."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from lectern.config import DATA_FORMATS, EXPORT_FORMATS, Config

log = logging.getLogger("lectern")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern", description="Tables from the lines of documents.")
    p.add_argument("-c", "--config", help="settings, a YAML file")
    p.add_argument("--init-config", metavar="FILE", help="write the default settings and end")
    source = p.add_mutually_exclusive_group()
    source.add_argument("--download", action="store_true", help="fetch the files that the settings name")
    source.add_argument("-i", "--input", nargs="+", help="PDF or text files, or patterns of them")
    source.add_argument("--images", nargs="+", help="images, or patterns of them")
    p.add_argument("-o", "--output", help="the file to write")
    p.add_argument("-f", "--format", choices=EXPORT_FORMATS)
    p.add_argument("--data-format", choices=DATA_FORMATS)
    p.add_argument("--skip-conversion", action="store_true", help="read images as they are listed; without --images, those in the settings' folder")
    p.add_argument("--clean", action="store_true", help="remove fetched files when done")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--version", action="version", version="lectern 0.1")
    return p


def settings(args: argparse.Namespace) -> Config:
    """Defaults, then the file, then the flags."""
    config = Config(args.config)
    if args.format:
        config.set("export", "format", args.format)
    if args.data_format:
        config.set("parsing", "data_format", args.data_format)
    if args.verbose or args.quiet:
        config.set("logging", "level", "DEBUG" if args.verbose else "ERROR")
    return config


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.init_config:
        Config().save(args.init_config)
        return 0
    config = settings(args)
    handlers: list[logging.Handler] = [logging.StreamHandler()] if config.get("logging", "console") else []
    if config.get("logging", "file"):
        handlers.append(logging.FileHandler(config.get("logging", "file"), encoding="utf-8", delay=True))
    for handler in log.handlers:
        handler.close()
    log.handlers[:] = handlers or [logging.NullHandler()]
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.setLevel(getattr(logging, str(config.get("logging", "level")).upper(), logging.INFO))
    if problems := config.problems():
        log.error("; ".join(problems))
        return 1
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lectern.operators.profile import summary
    from lectern.plans.extract import extract, extract_files
    from lectern.plans.storage import removed, stored
    from lectern.sinks.files import export
    from lectern.sources.decode import decoded, lines_of
    from lectern.sources.fetch import fetched
    from lectern.sources.files import IMAGES, listed, url_table

    spark = SparkSession.builder.getOrCreate()
    kept = []  # stored tables, each file read or fetched once

    def held(df, name):
        kept.append(stored(df, name))
        return kept[-1]

    try:
        if args.download:
            d = config.get("download")
            urls = url_table(spark, d["base_url"], d["file_pattern"], *d["district_range"], d["data_type"])
            got = held(fetched(urls, timeout=d["timeout"], delay=d["delay_seconds"]), "fetched")
            for row in got.where("error IS NOT NULL").select("url", "error").toLocalIterator():
                log.warning("%s: %s", row["url"], row["error"])
            table = extract(lines_of(held(decoded(got.where("error IS NULL").withColumnRenamed("url", "path")), "decoded")), config)
        elif args.images or args.skip_conversion:
            images = args.images or [config.get("conversion", "output_dir")]
            table = extract(lines_of(held(decoded(listed(spark, images, IMAGES, content=True), ("image",)), "decoded")), config)
        elif args.input:
            text = all(x.lower().endswith(".txt") for x in args.input)
            if text:
                table = extract(lines_of(held(decoded(listed(spark, args.input, ("txt",), content=True), ("plain",)), "decoded")), config)
            else:
                table, failed = extract_files(spark, args.input, config)
                for row in failed.toLocalIterator():
                    log.warning("%s: %s", row["source"], row["error"])
        else:
            log.error("nothing to read: give --download, --input or --images")
            return 1
        table = held(table.withColumn("_order", F.monotonically_increasing_id()), "table").orderBy("_order").drop("_order")
        out = export(table, config, args.output)
        if not out:
            log.error("no rows found")
            return 1
        log.info("%s: %s", out, summary(table).first().asDict())
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  the command line's last resort
        log.error("%s", e)
        return 1
    finally:
        if args.clean:
            for df in kept:  # fetched files and what was read from them
                removed(spark, df)


if __name__ == "__main__":
    sys.exit(main())
