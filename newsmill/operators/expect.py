"""Declarative data checks evaluated as a few aggregates over many datasets at once."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.operators.clean import fingerprint

EXISTS = "column_exists"
IS_STRING = "type_is_string"
NOT_NULL = "not_null"
UNIQUE = "unique"
MIN_LENGTH = "min_length"
COMPOUND_UNIQUE = "compound_unique"
PAIR = "pair"

GROUP = ("dataset", "source")
NO_VALUE = "null"

# user-defined pair conditions by name
PAIR_CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {}


def pair_condition(name: str):
    """Register a row condition over two columns under ``name``."""
    def add(fn):
        PAIR_CONDITIONS[name] = fn
        return fn
    return add


@pair_condition("shorter_than")
def shorter_than(a: Column, b: Column) -> Column:
    return F.length(a) < F.length(b)


@dataclass(frozen=True)
class Check:
    kind: str
    columns: tuple[str, ...]
    min_value: int | None = None
    mostly: float = 1.0
    condition: str | None = None
    severity: str = "critical"

    @property
    def name(self) -> str:
        return self.condition or self.kind

    @property
    def target(self) -> str:
        return ",".join(self.columns)


# The checks every article table has to pass.
ARTICLE_SUITE = (
    Check(EXISTS, ("id",)),
    Check(IS_STRING, ("id",)),
    Check(UNIQUE, ("id",)),
    Check(NOT_NULL, ("id",)),
    Check(EXISTS, ("article",)),
    Check(IS_STRING, ("article",)),
    Check(NOT_NULL, ("article",)),
    Check(MIN_LENGTH, ("article",), min_value=50),
    Check(EXISTS, ("highlights",)),
    Check(IS_STRING, ("highlights",)),
    Check(NOT_NULL, ("highlights",)),
    Check(MIN_LENGTH, ("highlights",), min_value=10),
    Check(COMPOUND_UNIQUE, ("article", "highlights")),
    Check(PAIR, ("highlights", "article"), condition="shorter_than"),
)


def _all_null(columns) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNull() for c in columns])


def ignored(check: Check) -> Column:
    """Rows the check does not look at."""
    if check.kind in (MIN_LENGTH, UNIQUE, COMPOUND_UNIQUE, PAIR):
        return _all_null(check.columns)
    return F.lit(False)


def unexpected(check: Check) -> Column:
    """True on rows that fail a row-level check."""
    cols = [F.col(c) for c in check.columns]
    if check.kind == NOT_NULL:
        return cols[0].isNull()
    if check.kind == MIN_LENGTH:
        return F.coalesce(F.length(cols[0]) < check.min_value, F.lit(False))
    if check.kind == PAIR:
        met = F.coalesce(PAIR_CONDITIONS[check.condition](*cols), F.lit(False))
        return ~met & ~_all_null(check.columns)
    return F.lit(False)  # metadata checks


def _label(name: str, by: str | None) -> Column:
    """Name of the data set a row belongs to; rows without a value of ``by`` are one of their own."""
    return F.concat(F.lit(f"{name}_"), F.coalesce(F.col(by).cast("string"), F.lit(NO_VALUE))) \
        if by else F.lit(name)


def _stack(datasets: dict[str, DataFrame], columns, by: str | None) -> DataFrame:
    """All datasets as one table; a missing column reads as null."""
    parts = []
    for name, df in datasets.items():
        label = _label(name, by)
        present = [F.col(c).cast("string").alias(c) if c in df.columns
                   else F.lit(None).cast("string").alias(c) for c in columns]
        parts.append(df.select(label.alias("dataset"), F.lit(name).alias("source"), *present))
    return reduce(DataFrame.unionByName, parts)


def schema_allows(check: Check, df: DataFrame) -> bool:
    """Whether the schema alone does not fail the check."""
    present = all(c in df.columns for c in check.columns)
    return present and (check.kind != IS_STRING or all(
        isinstance(df.schema[c].dataType, T.StringType) for c in check.columns))


def _schema_result(check: Check, datasets) -> Column | None:
    """Per dataset: False where the schema alone fails the check."""
    failing = [name for name, df in datasets.items() if not schema_allows(check, df)]
    return ~F.col("source").isin(failing) if failing else F.lit(True)


def _per_group(table: DataFrame, check: Check, sums: dict[str, Column]) -> DataFrame:
    """Group sizes of a uniqueness check, carrying row-level sums along."""
    keyed = table.select(
        *GROUP, _all_null(check.columns).alias("skip"), *fingerprint(*check.columns),
        *[c.alias(n) for n, c in sums.items()])
    return keyed.groupBy(*GROUP, "skip", "fp_lo", "fp_hi").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in sums])


def _unique_counts() -> list[Column]:
    n, skip = F.col("n"), F.col("skip")
    return [F.sum(F.when(skip, n).otherwise(0)).alias("missing"),
            F.sum(F.when(~skip & (n > 1), n).otherwise(0)).alias("bad")]


def evaluate(datasets: dict[str, DataFrame], suite=ARTICLE_SUITE,
             by: str | None = None) -> DataFrame:
    """Run a suite over named datasets: one row per (dataset, expectation).

    ``by`` names a column, such as the split, whose values are datasets of their own; a value
    that one of the inputs lacks is a dataset without rows there, and null is a value.

    All datasets are checked together. Row-level checks ride on the shuffle of the compound
    uniqueness check, so the texts are read once; every other uniqueness check reads its own
    column only.
    """
    columns = sorted({c for check in suite for c in check.columns})
    table = _stack(datasets, columns, by)
    every = _every_dataset(datasets, by)
    numbered = list(enumerate(suite))
    unique = [(i, c) for i, c in numbered if c.kind in (UNIQUE, COMPOUND_UNIQUE)]
    row_level = [(i, c) for i, c in numbered if (i, c) not in unique]
    carrier = next(((i, c) for i, c in unique if c.kind == COMPOUND_UNIQUE), None)

    sums = {}
    for i, check in row_level:
        sums[f"m{i}"] = ignored(check).cast("long")
        sums[f"u{i}"] = unexpected(check).cast("long")
    outputs = [F.sum(n).alias(n) for n in sums]
    results = []
    if carrier:
        groups = _per_group(table, carrier[1], sums)
        base = groups.groupBy(*GROUP).agg(
            F.sum("n").alias("elements"), *_unique_counts(), *outputs)
    else:
        base = (table.select(*GROUP, *[c.alias(n) for n, c in sums.items()])
                .groupBy(*GROUP).agg(F.count(F.lit(1)).alias("elements"), *outputs))
    wanted = row_level + ([carrier] if carrier else [])
    shapes = [_schema_result(check, datasets) for check in suite]
    results.append(_unpivot(_with_empty(base, every), wanted, carrier, shapes))
    for item in unique:
        if item != carrier:
            groups = _per_group(table, item[1], {})
            base = groups.groupBy(*GROUP).agg(F.sum("n").alias("elements"), *_unique_counts())
            results.append(_unpivot(_with_empty(base, every), [item], item, shapes))
    return reduce(DataFrame.unionByName, results)


def _every_dataset(datasets: dict[str, DataFrame], by: str | None) -> DataFrame:
    """Rows (dataset, source) that a result must have, whether a data set has rows or not.

    Every value of ``by`` in any of the inputs is expected in all of them.
    """
    names = F.array(*[F.lit(n) for n in datasets])
    if not by:
        some = next(iter(datasets.values()))
        return some.sparkSession.range(1).select(F.explode(names).alias("source")).select(
            F.col("source").alias("dataset"), "source")
    values = reduce(DataFrame.union, [df.select(F.col(by).cast("string").alias("v"))
                                      for df in datasets.values()]).distinct()
    return values.select("v", F.explode(names).alias("source")).select(
        F.concat_ws("_", "source", F.coalesce("v", F.lit(NO_VALUE))).alias("dataset"), "source")


def _with_empty(base: DataFrame, every: DataFrame) -> DataFrame:
    """Datasets without rows have no aggregate; count them as zero."""
    return every.join(base, list(GROUP), "left").na.fill(0)


def _unpivot(base, wanted, carrier, shapes) -> DataFrame:
    """One row per dataset and wanted check; ``shapes`` has the schema's verdict on every check."""
    rows = []
    for i, check in wanted:
        own = carrier and i == carrier[0]
        missing, bad = (F.col("missing"), F.col("bad")) if own else (F.col(f"m{i}"), F.col(f"u{i}"))
        rows.append(F.struct(
            F.lit(i).alias("check_no"), F.lit(check.name).alias("expectation"),
            F.lit(check.target).alias("column"), F.lit(check.severity).alias("severity"),
            F.col("elements").alias("element_count"), missing.alias("missing_count"),
            bad.alias("unexpected_count"), F.lit(check.mostly).alias("mostly"),
            shapes[i].alias("schema_ok")))
    flat = base.select(*GROUP, F.explode(F.array(*rows)).alias("r")).select("dataset", "r.*")
    looked_at = F.col("element_count") - F.col("missing_count")
    share = F.when(looked_at > 0, F.col("unexpected_count") / looked_at).otherwise(F.lit(0.0))
    # one division, so that a share which is met exactly is not lost to rounding
    met = F.when(looked_at > 0, (looked_at - F.col("unexpected_count")) / looked_at).otherwise(1.0)
    return flat.select(
        "dataset", "check_no", "expectation", "column", "severity", "element_count",
        "missing_count", "unexpected_count", (share * 100).alias("unexpected_percent"),
        (F.col("schema_ok") & (met >= F.col("mostly"))).alias("success"))


def tally(results: DataFrame, first_only: str | None = None) -> DataFrame:
    """Evaluated and unsuccessful expectations per dataset, or of one dataset only."""
    if first_only is not None:
        results = results.filter(F.col("dataset") == first_only)
    return results.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("unsuccessful"))


def unexpected_rows(df: DataFrame, check: Check, order_by: str) -> DataFrame:
    """Every row that fails a check, for inspection."""
    if check.kind in (UNIQUE, COMPOUND_UNIQUE):
        keyed = df.filter(~_all_null(check.columns)).withColumns(
            dict(zip(("fp_lo", "fp_hi"), fingerprint(*check.columns))))
        # keys of duplicate groups; a hot group is one row here and its members stay spread
        # over the join by row key
        marks = keyed.select(order_by, "fp_lo", "fp_hi")
        spread = (marks.groupBy("fp_lo", "fp_hi")
                  .agg(F.count(F.lit(1)).alias("_size"), F.min(order_by).alias(order_by)))
        once = spread.filter("_size = 1").select(order_by)
        return keyed.join(once, order_by, "left_anti").drop("fp_lo", "fp_hi")
    return df.filter(unexpected(check))


def unexpected_sample(df: DataFrame, check: Check, order_by: str, n: int = 20) -> DataFrame:
    """The first ``n`` unexpected rows, the sample a summary report shows."""
    return unexpected_rows(df, check, order_by).orderBy(order_by).limit(n)
