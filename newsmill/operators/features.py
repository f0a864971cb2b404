"""Model input rows: truncated ids, masks, labels, padded batches."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions.tokens import (
    MASKED, PAD, SOURCE_LIMIT, TARGET_LIMIT, encode, hashed_ids, pad_to)


def model_inputs(df: DataFrame, keep=(), to_ids=hashed_ids) -> DataFrame:
    """``input_ids, attention_mask, labels``; every other column is dropped but ``keep``."""
    ids = encode(F.col("article"), SOURCE_LIMIT, to_ids)
    labels = encode(F.col("highlights"), TARGET_LIMIT, to_ids)
    return df.select(*keep, ids.alias("input_ids"), labels.alias("labels")).select(
        *keep, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
        "labels")


def collate(df: DataFrame, batch: str) -> DataFrame:
    """Pad every row to the longest of its batch; labels are padded with the loss mask.

    ``batch`` numbers batches of bounded size, for example a unique row number divided by the
    batch size, so that no window partition can grow with the table.
    """
    mates = Window.partitionBy(batch)
    longest = df.withColumns({
        "_n": F.max(F.size("input_ids")).over(mates), "_m": F.max(F.size("labels")).over(mates)})
    return longest.withColumns({
        "input_ids": pad_to(F.col("input_ids"), F.col("_n"), PAD),
        "attention_mask": pad_to(F.col("attention_mask"), F.col("_n"), 0),
        "labels": pad_to(F.col("labels"), F.col("_m"), MASKED),
    }).drop("_n", "_m")
