"""Article tables on Parquet: splits, assets, first rows in file order."""

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmill.schemas import ARTICLE

# File name of a raw split -> split name.
SPLITS = {"train": "train", "validation": "val", "test": "test"}


def load_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The raw splits, each in a file of its own name."""
    return load_splits(spark, {split: f"{folder}/{file}.parquet" for file, split in SPLITS.items()})


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLE).parquet(path)


def load_splits(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Named split files as one table with a ``split`` column."""
    parts = [read_articles(spark, path).withColumn("split", F.lit(name))
             for name, path in files.items()]
    return reduce(DataFrame.unionByName, parts)


def write_splits(df: DataFrame, path: str, salts: int = 16) -> None:
    """One folder per split; readers prune the others away. At most ``salts`` files in each."""
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    df.repartition("split", salt).write.mode("overwrite").partitionBy("split").parquet(path)


def register_assets(assets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Name tables so that SQL and the checks can address them."""
    for name, df in assets.items():
        df.createOrReplaceTempView(name)
    return assets


def with_row_order(df: DataFrame) -> DataFrame:
    """Add ``row_order``: the row's place in file order, unique and stable across re-reads."""
    return df.withColumn("row_order", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def _spellings(file: str) -> set[str]:
    """Ways to write a file's address: escaped or not, with one slash after the scheme or three."""
    short = re.sub(r"^([a-z0-9]+):/+(?=[^/])", r"\1:/", file) if file.startswith("file:") else file
    return {y for x in (file, short, short.replace("file:/", "file:///")) for y in (x, unquote(x))}


def _walk(df: DataFrame, enough) -> list:
    """Row counts (file, split value, rows) of the first files in order, until they are enough.

    Files are looked at in groups that grow, so how many are opened follows the rows that are
    wanted and not the table. Counting reads no text column.
    """
    path, files, found, size = F.col("_metadata.file_path"), sorted(df.inputFiles()), [], 1
    for_split = [F.col(enough.split)] if enough.split else [F.lit(None)]
    at = 0
    while at < len(files) and not enough(found):
        group = files[at:at + size]
        names = sorted({x for f in group for x in _spellings(f)})
        found += df.filter(path.isin(names)).groupBy(
            path.alias("file"), *[c.alias("value") for c in for_split]).agg(
                F.count(F.lit(1)).alias("rows")).orderBy("file").collect()
        at, size = at + size, size * 2
    return found


class _Enough:
    """Whether counted files hold ``n`` rows, of every one of ``values`` when given."""

    def __init__(self, n: int, split: str | None, values):
        self.n, self.split, self.values = n, split, values

    def __call__(self, found) -> bool:
        if not self.split:
            return sum(f["rows"] for f in found) >= self.n
        if self.values is None:  # any file may hold one more value
            return False
        sums = dict.fromkeys(self.values, 0)
        for f in found:
            if f["value"] in sums:
                sums[f["value"]] += f["rows"]
        return all(rows >= self.n for rows in sums.values())


def first_rows(df: DataFrame, n: int, split: str | None = None, values=None) -> DataFrame:
    """The first ``n`` rows in file order, per value of ``split`` when given.

    Files are walked in order until they hold the rows, so the list of files that are kept is never
    longer than ``n`` per split. With a split, ``values`` names those that are wanted; without it
    every file has to be counted, since any may hold one more. No row is shuffled or sorted without
    a split.
    """
    if n <= 0:
        return df.limit(0)
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    found = _walk(df, _Enough(n, split, values))
    if not split:
        before, whole, cut = 0, [], None
        for f in found:
            if before + f["rows"] >= n:
                cut = (path == f["file"]) & (row < n - before)
                break
            before, whole = before + f["rows"], [*whole, f["file"]]
        chosen = cut if cut is not None else F.lit(False)
        return df.filter(chosen | path.isin(whole) if whole else chosen)
    # rows of several splits may share a file: the cut row index differs for each split
    files, sums = set(), {}
    for f in found:
        if sums.get(f["value"], 0) < n and (values is None or f["value"] in values):
            files.add(f["file"])
            sums[f["value"]] = sums.get(f["value"], 0) + f["rows"]
    if not files:
        return df.limit(0)
    ranked = df.filter(path.isin(sorted(files))).withColumns({"_f": path, "_r": row})
    if values is not None:
        ranked = ranked.filter(F.col(split).isin(list(values)))
    place = F.row_number().over(Window.partitionBy(split).orderBy("_f", "_r"))
    return ranked.withColumn("_n", place).filter(F.col("_n") <= n).drop("_f", "_r", "_n")


def first_row_of_each(df: DataFrame, split: str) -> DataFrame:
    """The first row in file order of every value of ``split``.

    One aggregation over the split column alone finds where these rows are, one row for each
    value; they are then read at their places, from their own files.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    firsts = df.groupBy(split).agg(F.min(F.struct(path.alias("file"), row.alias("row"))).alias("at")).collect()
    if not firsts:
        return df.limit(0)
    return df.filter(reduce(lambda a, b: a | b, [
        (path == f["at"]["file"]) & (row == f["at"]["row"]) for f in firsts]))


def first_row_complete(df: DataFrame, columns, split: str, values=None) -> DataFrame:
    """Per split: does the first row hold a value in every expected column?"""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    rows = first_row_of_each(df, split) if values is None else first_rows(df, 1, split, values)
    return rows.select(split, full.alias("complete"))
