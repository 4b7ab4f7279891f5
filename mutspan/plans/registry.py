"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql_types import ABSENT_IDS, LONG_COLUMNS
from .views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_absent_ids(fn, columns: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(spark, sf).withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in columns})

    return run


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query under ``name``; ``uses`` names the views its SQL needs, in order."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = _with_absent_ids(fn, ABSENT_IDS[name]) if name in ABSENT_IDS else fn
        if sql is not None:
            head = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in uses)
            body = sql.strip()
            if head and body.upper().startswith("WITH RECURSIVE "):
                body = f"WITH RECURSIVE {head}, {body[15:]}"
            elif head and body.upper().startswith("WITH "):
                body = f"WITH {head}, {body[5:]}"
            elif head:
                body = f"WITH {head} {body}"
            shaped = [f"CAST({c} AS BIGINT) AS {c}" for c in LONG_COLUMNS.get(name, [])]
            shaped += [f"coalesce({c}, -1) AS {c}" for c in ABSENT_IDS.get(name, [])]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(shaped)}) FROM ({body})" if shaped else body
        return fn

    return keep
