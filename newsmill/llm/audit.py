"""What each of several filters removes, in every order, and its fair share of all removals.

A document fails a set of filters, written as a mask. Counts per (part, mask) are all that is
needed: the documents that a coalition of filters removes are those whose mask meets it, so one
aggregation tabulates the removals of all coalitions. A step of an order takes the difference of
two coalitions. A filter's share is its Shapley value, found as the least-squares fit of a sum of
shares to the removals of all coalitions, weighted by the Shapley kernel and held to the removals
of all filters together; in rationals, so it is exact.
"""

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
GAP = "[\\x20\\x09-\\x0D]+"
COPY = 1 << LETTERS.index("E")
ROWS = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_mask(text: Column) -> Column:
    """Which of the filters A to D a text fails, as bits; it may not be null."""
    words = F.array_remove(F.split(text, GAP), "")
    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        upper.cast("long") * 100 > F.char_length(text).cast("long") * 3,
        text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def tally(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents, and how many are labelled so.

    E fails for a text that a row with a smaller id has too. Equal texts fail the same other
    filters, so they are counted by text, part and labels, and only those whose id is the least
    of all rows with the text are set apart. A null id is not larger than any; a null text is an
    empty one. An id with several label rows has a label if one of them says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"), text_mask(text).alias("mask"))
    ids = rows.groupBy("sha", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = ids.filter("doc_id is not null").join(marks, "doc_id", "left")
    known = known.unionByName(ids.filter("doc_id is null"), allowMissingColumns=True).na.fill(
        False, ["good", "toxic"])
    same = known.groupBy("sha", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    # a few rows a text: one for each part and label
    everywhere = F.min("least").over(Window.partitionBy("sha"))
    first = F.when(F.col("least") == everywhere, F.col("at_least")).otherwise(0) + F.col("unnamed")
    split = same.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("x"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    return split.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), count("good"), count("toxic"))


def coalitions(tallied: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """Rows (part, total, n, good, toxic); the last three hold for every coalition, by its mask,
    the documents it removes."""
    def removals(c):
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0))
                         for s in range(1 << filters)]).alias(c)
    return tallied.groupBy("part").agg(F.sum("n").alias("total"), *map(removals, ("n", "good", "toxic")))


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of a regular system, given as rows with the right side last."""
    rows = [list(r) for r in rows]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i] != 0)
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(len(rows)):
            if k != i and rows[k][i] != 0:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    return [r[-1] for r in rows]


def shapley(removed: list[int]) -> list[Fraction]:
    """Shares of the filters, from the removals of every coalition, by mask.

    Least squares over all coalitions but none and all, each weighted by the Shapley kernel;
    a Lagrange multiplier holds the sum of shares to the removals of all filters.
    """
    m = (len(removed) - 1).bit_length()
    if m == 1:
        return [Fraction(removed[1])]
    full = len(removed) - 1
    normal = [[Fraction(0)] * (m + 2) for _ in range(m)]
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(m - 1, comb(m, size) * size * (m - size))
        members = [i for i in range(m) if s >> i & 1]
        for i in members:
            for j in members:
                normal[i][j] += weight
            normal[i][-1] += weight * removed[s]
    for row in normal:
        row[m] = Fraction(1)
    return solve(normal + [[Fraction(1)] * m + [Fraction(0), Fraction(removed[full])]])[:m]


def steps(part: str, total: int, n: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """The rows of one part: every step of every order."""
    m, full = (len(n) - 1).bit_length(), len(n) - 1
    shares = [int(x * factorial(m)) for x in shapley(n)]
    out = []
    for order in permutations(range(m)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = n[after] - n[before]
            out.append((
                part, "".join(LETTERS[i] for i in order), step, total - n[after], removed,
                n[1 << f] - removed, n[full] - n[full & ~(1 << f)], good[after] - good[before],
                toxic[after] - toxic[before], shares[f]))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with counts within the part.

    Parts are the values of ``lang``, null being the empty string; an empty table has none.
    ``shapley`` is a filter's share times the number of orders, which is whole.
    """
    names = [c.split()[0] for c in ROWS.split(", ")]

    def rows(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame(steps(
                    row.part, int(row.total), *[[int(x) for x in c] for c in (row.n, row.good, row.toxic)]),
                    columns=names)

    return coalitions(tally(docs, labels)).select("part", "total", "n", "good", "toxic").mapInPandas(rows, ROWS)
