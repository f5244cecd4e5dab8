"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..adapter import PTS_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pts: bool = True):
    """Register a query with its SQL. The adapter's table pts comes first; ``-- ctes`` at the start says that more tables follow it."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql is not None:
            more = sql.lstrip().startswith("-- ctes")
            SQL[f.__name__] = f"WITH {PTS_SQL}{', ' if more else ' '}{sql.replace('-- ctes', '', 1)}" if pts else sql
        return f

    return add


def rounded(name: str, places: int = 6) -> Column:
    return F.round(F.col(name), places).alias(name)
