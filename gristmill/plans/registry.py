"""Where queries over the test tables are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: str = ""):
    """Registers a query under its function's name, with its SQL. Columns named in dates are given as text by both."""

    def add(f):
        names = dates.split()
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in names})) if names else f
        if sql is not None:
            texts = ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in names)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if names else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
