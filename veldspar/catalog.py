"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from .plans import along_time, details, measures, reports

QUERIES = {**along_time.QUERIES, **measures.QUERIES, **reports.QUERIES, **details.QUERIES}
ORACLE_SQL = {**along_time.ORACLE_SQL, **measures.ORACLE_SQL, **reports.ORACLE_SQL, **details.ORACLE_SQL}
FLAGSHIP = along_time.asof_nearest
