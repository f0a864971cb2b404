"""The given tables seen as article, ledger and request tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES = 64 << 20  # a larger file has splits enough


def scanned_bytes(df: DataFrame) -> int:
    """Size of the files under a table, as the optimizer knows it; no job, and no row is made."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows of a table that comes in fewer splits than there are cores.

    Meant for heavy work on each row of a small file. A large table has splits enough and is
    left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if scanned_bytes(df) >= SMALL_BYTES else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` announces much work per row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df


def articles(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Documents as articles: the first line is the highlight, ``doc_id`` the row order."""
    docs = table(spark, sf_dir, "documents", heavy)
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("article"),
        F.substring_index("text", "\n", 1).alias("highlights"), F.col("lang").alias("split"))
