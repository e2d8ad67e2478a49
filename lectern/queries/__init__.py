"""Queries over the driver's tables, and the DuckDB SQL that gives the same rows without the operators."""

from lectern.queries.files import ORACLE_SQL as _FILES_SQL
from lectern.queries.files import QUERIES as _FILES
from lectern.queries.keywords import ORACLE_SQL as _KEYWORDS_SQL
from lectern.queries.keywords import QUERIES as _KEYWORDS
from lectern.queries.parsing import ORACLE_SQL as _PARSING_SQL
from lectern.queries.parsing import QUERIES as _PARSING
from lectern.queries.scans import ORACLE_SQL as _SCANS_SQL
from lectern.queries.scans import QUERIES as _SCANS
from lectern.queries.tables import ORACLE_SQL as _TABLES_SQL
from lectern.queries.tables import QUERIES as _TABLES

QUERIES = {**_PARSING, **_SCANS, **_KEYWORDS, **_TABLES, **_FILES}
ORACLE_SQL = {**_PARSING_SQL, **_SCANS_SQL, **_KEYWORDS_SQL, **_TABLES_SQL, **_FILES_SQL}
