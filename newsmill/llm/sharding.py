"""Contiguous shards of nearly equal bytes, cut from global prefix sums of document sizes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.prefix import with_prefix

ROW_OVERHEAD = 8


def text_bytes(text: str = "text") -> Column:
    """Bytes a document takes: its UTF-8 text, none for null, and a fixed part for each row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def shard_by_bytes(rows: DataFrame, shards: int, order: list[str], size: str) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (place in the shard, from 0).

    Rows are taken in the global order of ``order`` (nulls first, ties in any order). The running
    sum of ``size`` is cut at equal targets; a row belongs to the target its middle lies in, so a
    shard is off its target by at most half of the row on either edge. Sizes have to be positive.
    A row larger than a target leaves neighbouring shards empty. An empty table has no shards.
    """
    placed = with_prefix(rows, order, size).withColumn("shard", F.expr(
        f"cast((2 * _before + `{size}`) * {int(shards)} div (2 * _total) as int)"))
    firsts = placed.groupBy(F.col("shard").alias("_s")).agg(F.min("_row").alias("_first"))
    # at most one row for each shard
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("_s")).select(
        *rows.columns, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """One narrow row per document: id, size, checksum of the text, shard and slot.

    Repeated rows each get a slot of their own; a null text has no bytes and checksum 0.
    """
    narrow = docs.select(
        "doc_id", text_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_by_bytes(narrow, shards, ["doc_id", "text_crc32"], "size")


def write_shards(docs: DataFrame, shards: int, path: str) -> str:
    """Write documents into one folder per shard, in the order of ids; returns the folders' column.

    That is ``shard``, with lines under it where the documents have a column of that name. Rows
    find their shard by id, checksum and size; rows equal in all three take the lowest one.
    """
    tail = "_" * max(map(len, docs.columns))
    at = shard_documents(docs, shards).groupBy("doc_id", "text_crc32", "size").agg(
        F.min("shard").alias("shard")).select(*[
            F.col(c).alias(c + tail) for c in ("doc_id", "text_crc32", "size", "shard")])
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    full = docs.join(at, F.col("doc_id").eqNullSafe(F.col("doc_id" + tail)) & (
        F.crc32(text) == F.col("text_crc32" + tail)) & (text_bytes() == F.col("size" + tail)))
    column = "shard"
    while column in docs.columns:
        column += "_"
    full = full.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("shard" + tail).alias(column))
    full.repartitionByRange(shards, column, "doc_id").sortWithinPartitions(
        column, "doc_id").write.partitionBy(column).parquet(path)
    return column
