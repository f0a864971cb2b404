"""Greedy packing of sentences into token-budgeted chunks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.functions.text import (
    CHUNK_LIMIT, bind, count_tokens, count_words, sentences, summary_budget)


def pack(parts: Column, sizes: Column, text: Column, max_tokens: int) -> Column:
    """Join consecutive ``parts`` with spaces while their ``sizes`` stay within the budget.

    A part above the budget is a chunk of its own and is never cut. Without parts the text
    itself is the only chunk. The fold keeps chunk start positions, not text.
    """
    def step(acc, n):
        opens = (acc["i"] == 0) | (acc["used"] + n > max_tokens)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(opens, n).otherwise(acc["used"] + n).alias("used"),
            F.when(opens, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"])
            .alias("starts"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"),
                    F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(sizes, zero, step, lambda acc: acc["starts"])

    def cut(begins):
        return F.transform(begins, lambda b, k: F.array_join(F.slice(
            parts, b + 1, F.coalesce(F.get(begins, k + 1), F.size(parts)) - b), " "))

    return F.when(F.size(parts) == 0, F.array(text)).otherwise(bind(starts, cut))


def chunks(text: Column, max_tokens: int = CHUNK_LIMIT, count=count_words) -> Column:
    """ARRAY<STRING> of chunks; ``count`` (Column -> Column) sizes a sentence."""
    return bind(sentences(text), lambda s: pack(
        s, F.transform(s, lambda x: count(x).cast("int")), text, max_tokens))


def chunk_table(df: DataFrame, key: str, text: str, max_tokens: int = CHUNK_LIMIT,
                count=count_words) -> DataFrame:
    """One row per chunk with its own token count and summary budget."""
    rows = df.select(key, F.posexplode(chunks(F.col(text), max_tokens, count)).alias(
        "chunk_no", "chunk"))
    sized = rows.withColumn("n_tokens", count_tokens(F.col("chunk"), count=count).cast("int"))
    return sized.withColumn("budget", summary_budget(F.col("n_tokens"))).select(
        key, "chunk_no", "chunk", "n_tokens", "budget.min_len", "budget.max_len")
