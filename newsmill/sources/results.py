"""Check results on shared storage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(results: DataFrame, path: str, run: str) -> None:
    """Store one run's results under its own partition; a repeated run replaces itself."""
    (results.withColumn("run", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
