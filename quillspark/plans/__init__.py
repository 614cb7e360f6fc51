"""Registered queries: operators bound to tables, each with its SQL twin."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, prelude: bool = True):
    """Register a function of Tables under a name, with the SQL that must give the same rows."""

    def register(f):
        from quillspark.sources.bindings import PRELUDE, Tables

        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"{PRELUDE}{sql.strip()}" if prelude else sql.strip()
        return f

    return register
