"""lectern: tables from the lines of document text, on Spark.

Lines carry their order (source, page, line_no) from the scan to the parser; each operator maps a DataFrame to a DataFrame.
"""

from lectern.config import Config

__all__ = ["Config"]
