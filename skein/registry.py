"""Named queries with their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.bind import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Register a query. sql is its DuckDB twin, in which {ev}, {art}, {ent}, {deal} and {price} are the bound tables of skein.bind; the
    columns named in dates, and every date of the query, are given as text."""
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            days = {c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"}
            return df.withColumns(days) if days else df

        QUERIES[name] = run
        if sql:
            text = sql
            for key, bound in SQL.items():
                text = text.replace("{" + key + "}", f"({bound})")
            if dates:
                text = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates.split())}) FROM ({text})"
            ORACLES[name] = text
        return f

    return keep
