"""Operators of a training-data pipeline, each in a module with its queries and SQL."""

from . import conversation_trie, decontamination, filter_audit, html_text, licenses, minhash, mixing, quality, secrets, simhash, toxicity, url_filters, warc

_MODULES = (licenses, decontamination, toxicity, mixing, url_filters, html_text, quality, warc, simhash, secrets, filter_audit, conversation_trie, minhash)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
