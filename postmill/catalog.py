"""All queries of the library, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from .functions import dates, detect, identifiers, json_text, money, text
from .operators import grids, lines, page_tables, records, relational, spam, suffixes, text_tables

FLAGSHIP = "message_detections"
_MODULES: tuple = (relational, records, lines, grids, text, dates, money, identifiers, json_text, detect, spam, suffixes, text_tables, page_tables)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
