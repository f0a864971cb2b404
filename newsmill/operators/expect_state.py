"""Checks over tables that grow: what a part adds is kept, and results are merged from it.

A part leaves one row of counts for each data set and, for every uniqueness check, the digests of
its keys with their counts. Both merge by addition, so a new part costs its own rows, and the
results after any number of parts are those of ``expect.evaluate`` over all rows. Texts are read
once, when their part comes. A part that is appended again under its name replaces itself.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.operators import expect
from newsmill.operators.expect import ARTICLE_SUITE, COMPOUND_UNIQUE, GROUP, UNIQUE
from newsmill.session import stored

DIGEST = ["check_no", "skip", "fp_lo", "fp_hi"]


def _write(df: DataFrame, path: str, kind: str, part: str) -> None:
    (df.withColumn("part", F.lit(part)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{kind}"))


def append(datasets: dict[str, DataFrame], path: str, part: str, suite=ARTICLE_SUITE,
           by: str | None = None) -> None:
    """Keep the state of one part of the named datasets; ``by`` as in ``expect.evaluate``."""
    some = next(iter(datasets.values())).sparkSession
    columns = sorted({c for check in suite for c in check.columns})
    table = expect._stack(datasets, columns, by)
    unique = [(i, c) for i, c in enumerate(suite) if c.kind in (UNIQUE, COMPOUND_UNIQUE)]
    sums = {}
    for i, check in enumerate(suite):
        if (i, check) not in unique:
            sums[f"m{i}"] = expect.ignored(check).cast("long")
            sums[f"u{i}"] = expect.unexpected(check).cast("long")
    # the counts ride on the digests of the check over most columns, so that texts are read once
    carrier = max(unique, key=lambda x: len(x[1].columns), default=None)
    digests = []
    for i, check in unique:
        own = (i, check) == carrier
        groups = expect._per_group(table, check, sums if own else {})
        groups = stored(groups, "groups") if own else groups
        if own:
            carried = groups
        digests.append(groups.select(*GROUP, F.lit(i).alias("check_no"), "skip", "fp_lo", "fp_hi", "n"))
    if carrier:
        counts = carried.groupBy(*GROUP).agg(F.sum("n").alias("elements"), *[F.sum(n).alias(n) for n in sums])
    else:
        counts = table.select(*GROUP, *[c.alias(n) for n, c in sums.items()]).groupBy(*GROUP).agg(
            F.count(F.lit(1)).alias("elements"), *[F.sum(n).alias(n) for n in sums])
    _write(counts, path, "counts", part)
    if digests:
        _write(reduce(DataFrame.unionByName, digests), path, "digests", part)
    shapes = [(name, by is not None, [expect.schema_allows(c, df) for c in suite]) for name, df in datasets.items()]
    _write(some.createDataFrame(shapes, "source string, split boolean, allows array<boolean>"), path, "schema", part)


def results(spark: SparkSession, path: str, suite=ARTICLE_SUITE) -> DataFrame:
    """One row per (dataset, expectation) over all parts so far.

    A data set that any part names is there, with every value of the split column that any has; a
    schema check passes if it does for all parts.
    """
    shapes = spark.read.parquet(f"{path}/schema")
    counts = spark.read.parquet(f"{path}/counts").drop("part")
    value = F.expr("substring(dataset, length(source) + 2)")
    values = counts.select(value.alias("v")).distinct()
    named = shapes.groupBy("source").agg(
        F.max("split").alias("split"), *[F.min(F.col("allows")[i]).alias(f"ok{i}") for i in range(len(suite))])
    whole = named.filter("not split").withColumn("dataset", F.col("source"))
    parts = named.filter("split").join(values, F.lit(True)).withColumn(  # a row for each split and name
        "dataset", F.concat_ws("_", "source", "v")).drop("v")
    every = whole.unionByName(parts).drop("split")
    sums = [c for c in counts.columns if c not in GROUP]
    base = counts.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in sums])
    unique = [(i, c) for i, c in enumerate(suite) if c.kind in (UNIQUE, COMPOUND_UNIQUE)]
    verdicts = [F.col(f"ok{i}") for i in range(len(suite))]
    row_level = [(i, c) for i, c in enumerate(suite) if (i, c) not in unique]
    found = [expect._unpivot(expect._with_empty(base, every), row_level, None, verdicts)]
    if unique:
        digests = spark.read.parquet(f"{path}/digests").groupBy(*GROUP, *DIGEST).agg(F.sum("n").alias("n"))
        keys = digests.groupBy(*GROUP, "check_no").agg(F.sum("n").alias("elements"), *expect._unique_counts())
        for i, check in unique:
            own = expect._with_empty(keys.filter(F.col("check_no") == i).drop("check_no"), every)
            found.append(expect._unpivot(own, [(i, check)], (i, check), verdicts))
    return reduce(DataFrame.unionByName, found)
