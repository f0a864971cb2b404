"""Intervals of means by resampling, in one aggregation over all resampled corpora.

Drawing as many rows as there are, with replacement, takes a row about Poisson(1) times, so a
resampled corpus gives every row a Poisson weight and moves nothing. Weights come from a hash of
the row key and the number of the corpus: the same key and seed weigh the same in any order, on
any partition, and after a lost task. A row meets all corpora where it is read; what is shuffled
is one row of sums for each corpus and task.
"""

from hashlib import md5
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
MOST = 9  # a weight above it has a chance below one in a million


def steps() -> list[int]:
    """Values of a hash below ``PRIME`` from which on a weight is 1, 2, ... at least."""
    total, out = 0.0, []
    for n in range(MOST):
        total += exp(-1) / factorial(n)
        out.append(int(total * PRIME))
    return out


def factors(replicates: int, seed: int) -> list[int]:
    """For each resampled corpus a factor from 1 on and a shift, as one number each pair."""
    def number(name):
        return int(md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)
    return [(1 + number(f"factor {b}") % (PRIME - 1)) * PRIME + number(f"shift {b}") % PRIME
            for b in range(replicates)]


def key_hash(key: list[str]) -> Column:
    """A whole number below ``PRIME`` from the text of the key; a null counts as a letter of its own."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(PRIME)


def weight(hashed: Column, factor: Column) -> Column:
    """Poisson(1) weight of a row in a corpus. Two rows are weighed independently of each other,
    since a random line through a prime field takes any two values at two places."""
    drawn = (hashed * F.call_function("div", factor, F.lit(PRIME)) + factor % F.lit(PRIME)) % F.lit(PRIME)
    return sum((F.when(drawn >= s, F.lit(1)).otherwise(F.lit(0)) for s in steps()[1:]),
               F.when(drawn >= steps()[0], F.lit(1)).otherwise(F.lit(0)))


def intervals(rows: DataFrame, key: list[str], values: list[str], replicates: int = 1000,
              seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Rows (metric, low, mid, high): quantiles of the mean of each column of ``values`` over
    ``replicates`` resampled corpora, interpolated; mid is the median.

    ``key`` names a row; rows of one key are drawn together. Null values are left out of a mean.
    Without rows, or where no corpus has one, the quantiles are null.
    """
    numbers = ", ".join(f"{f}L" for f in factors(replicates, seed))
    drawn = rows.select(key_hash(key).alias("_h"), *values).select(
        "_h", *values, F.posexplode(F.expr(f"array({numbers})")).alias("_b", "_f")).select(
        "_b", weight(F.col("_h"), F.col("_f")).alias("_w"), *values).filter("_w > 0")
    sums = drawn.groupBy("_b").agg(*[
        agg for i, v in enumerate(values) for agg in (
            F.sum(F.col("_w") * F.col(v)).alias(f"_s{i}"),
            F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).alias(f"_n{i}"))])
    ends = [(1 - confidence) / 2, 0.5, (1 + confidence) / 2]
    found = sums.agg(*[
        F.percentile(F.try_divide(F.col(f"_s{i}"), F.col(f"_n{i}")), ends).alias(f"_q{i}")
        for i in range(len(values))])
    return found.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("metric"), *[F.get(f"_q{i}", k).alias(c) for k, c in enumerate(
            ("low", "mid", "high"))]) for i, v in enumerate(values)])).alias("x")).select("x.*")
