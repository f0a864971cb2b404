"""Named queries over the given tables, each with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that both engines agree on types."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("long").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f"`{f.name}`")
        for f in df.schema])


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, optionally with its SQL."""
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return fn
    return add
