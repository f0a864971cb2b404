"""Sums and row numbers over a global order, without sorting the table in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.session import stored

ROWS_PER_BLOCK = 500_000


def with_prefix(df: DataFrame, order: list[str], value: str, within: str | None = None) -> DataFrame:
    """Add ``_before`` (sum of ``value`` over earlier rows), ``_row`` (earlier rows) and ``_total``.

    Rows are cut into blocks by range partitioning on ``within`` and ``order`` and stored, since
    two passes have to see the same blocks. A block contributes one row of totals; only those few
    rows are scanned in order. With ``within`` the sums start anew for each of its values, nulls
    being a value of their own; a value may span any number of blocks, so a hot one is split.
    Rows that tie in ``order`` are told apart by the place they were read from, so equal rows
    spread over blocks like others. ``df`` should be narrow; an empty table stays empty.
    """
    keys = ([within] if within else []) + order
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(conf, -(-df.count() // ROWS_PER_BLOCK))
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(blocks, *keys, "_tie")
    rows = stored(placed.withColumn("_block", F.spark_partition_id()), "blocks")
    by = [F.col("_block")] + ([F.col(within)] if within else [])
    totals = rows.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    # one row for each block, and one more wherever a value of within starts inside a block
    scope = Window.partitionBy(*([within] if within else [F.lit(0)]))
    earlier = scope.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[c.alias(f"_b{i}") for i, c in enumerate(by)],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        F.sum("_sum").over(scope).alias("_total"))
    here = Window.partitionBy(*by).orderBy(*order, "_tie")
    own = rows.withColumns({
        "_own": F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, -1)),
        "_nth": F.row_number().over(here) - 1})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & c.eqNullSafe(F.col(f"_b{i}"))
    return own.join(totals, same).select(
        *df.columns,
        (F.col("_sum_before") + F.coalesce("_own", F.lit(0))).alias("_before"),
        (F.col("_n_before") + F.col("_nth")).alias("_row"), "_total")
