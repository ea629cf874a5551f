"""Collects named queries and their SQL."""

import functools

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, dates: tuple = ()):
    """Registers a function of (spark, sf_dir) and the SQL for its rows; `dates` come out as text in both."""

    def add(function):
        @functools.wraps(function)
        def run(spark, sf_dir):
            df = function(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

        QUERIES[name] = run
        if sql is not None:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return function

    return add
