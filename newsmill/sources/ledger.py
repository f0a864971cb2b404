"""The emissions ledger on shared storage: append-only records, read back with a schema."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.schemas import LEDGER, REPORT


def append(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add records. Nothing already written is read or rewritten."""
    (records.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER])
     .write.mode("append").format(fmt).save(path))


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The ledger so far; empty when nothing has been appended yet."""
    try:
        return spark.read.schema(LEDGER).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Records of a nested single-file report, as ledger rows."""
    report = spark.read.schema(REPORT).option("multiLine", True).json(path)
    return report.select(F.explode("records").alias("r")).select(
        F.to_timestamp("r.timestamp").alias("ts"), "r.stage", "r.emissions_kg", "r.emissions_g")
