"""ROUGE-1, -2, -L and -Lsum over tables of (key, prediction, reference)."""

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.functions import lcs
from newsmill.functions.stem import remembering, stem
from newsmill.functions.text import as_score, bind
from newsmill.operators import bootstrap
from newsmill.operators.pin import pin
from newsmill.session import stored

STEM_ABOVE = 3  # fixed value: shorter tokens are not stemmed
VOCABULARY_BYTES = 64 << 20  # largest stem table that is broadcast
OFTEN = 1_000_000  # rows of a token that one task takes


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    clean = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    return F.filter(F.split(clean, " "), lambda t: t != "")


def _stemmer():
    look_up = remembering()
    return lambda ts: [look_up(t) if len(t) > STEM_ABOVE else t for t in ts]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    stems = _stemmer()
    for rows in batches:
        yield rows.map(stems)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stem_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    stems = _stemmer()
    for rows in batches:
        yield rows.map(lambda lines: [stems(line) for line in lines])


@F.pandas_udf(T.StringType())
def stem_one(words: pd.Series) -> pd.Series:
    return words.map(lambda t: stem(t) if len(t) > STEM_ABOVE else t)


def pair_up(predictions: DataFrame, references: DataFrame, key) -> DataFrame:
    """References with their prediction; one that has none gets status ``missing``."""
    return references.join(predictions, key, "left").withColumn(
        "status", F.when(F.col("prediction").isNull(), "missing").otherwise("ok"))


def tokenised(pairs: DataFrame, stemmed: bool = False) -> DataFrame:
    """Add token arrays ``p`` and ``r``; a null side has no tokens."""
    out = pairs.withColumns({
        side: F.coalesce(tokens(F.col(name)), F.array().cast("array<string>"))
        for side, name in (("p", "prediction"), ("r", "reference"))})
    return out.withColumns({s: stem_all(s) for s in ("p", "r")}) if stemmed else out


def ngrams(ts: Column, n: int) -> Column:
    if n == 1:
        return ts
    return F.when(F.size(ts) >= n, F.transform(
        F.sequence(F.lit(1), F.size(ts) - (n - 1)), lambda i: F.array_join(F.slice(ts, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def scores(overlap: Column, n_prediction: Column, n_reference: Column, name: str) -> list[Column]:
    """Precision, recall and F1, zero where a side is empty."""
    zero = F.lit(0.0)
    p = F.when(n_prediction > 0, overlap / n_prediction).otherwise(zero)
    r = F.when(n_reference > 0, overlap / n_reference).otherwise(zero)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(zero)
    return [p.alias(f"{name}_p"), r.alias(f"{name}_r"), f.alias(f"{name}_f")]


def rouge_n(pairs: DataFrame, key: list[str], n: int, stemmed: bool = False) -> DataFrame:
    """Clipped n-gram overlap per pair; ``key`` must identify a pair.

    Rows are placed by ``key`` once, which spreads the pairs of a small file; Spark leaves that out
    where a join on it has just done so. A pair's n-grams are counted in its own row: a task holds
    those of one pair at a time, however many pairs it has.
    """
    rows = pairs.select(*key, "prediction", "reference")
    if stemmed:
        # Spark forgets how rows are placed at a Python step, so that comes first; the stems
        # travel as text, which is smaller than arrays
        rows = tokenised(rows, stemmed).select(*key, *[
            F.array_join(s, " ").alias(name) for s, name in (("p", "prediction"), ("r", "reference"))])
    rows = tokenised(rows.repartition(*key))
    counted = pin(rows.select(
        *key, clipped_overlap(ngrams(F.col("p"), n), ngrams(F.col("r"), n)).alias("overlap"),
        *[F.greatest(F.size(side) - (n - 1), F.lit(0)).alias(f"n_{side}") for side in ("p", "r")]),
        "overlap", "n_p", "n_r")
    return counted.select(*key, *scores(F.col("overlap"), F.col("n_p"), F.col("n_r"), f"rouge{n}"))


def clipped_overlap(p: Column, r: Column) -> Column:
    """How many entries two arrays share, each counted as often as both have it.

    Sorting the entries of both with their side puts equal ones next to each other, those of ``p``
    first; the starts of the runs give the counts.
    """
    def side(entries, of):
        return F.transform(entries, lambda g: F.struct(g.alias("g"), F.lit(of).alias("of")))

    def runs(s):
        def shared(starts):
            def length(k):
                return F.coalesce(F.get(starts, k + 1), F.size(s)) - F.get(starts, k)

            def both(k):
                return F.when(F.get(s, F.get(starts, k))["g"] == F.get(s, F.get(starts, k + 1))["g"],
                              F.least(length(k), length(k + 1))).otherwise(0)
            return F.when(F.size(starts) > 1, F.aggregate(
                F.sequence(F.lit(0), F.size(starts) - 2), F.lit(0), lambda n, k: n + both(k))).otherwise(0)

        at = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(F.size(s) > 0, bind(starts, shared)).otherwise(0)

    return bind(F.sort_array(F.concat(side(p, 0), side(r, 1))), runs)


def overlap_by_join(predicted: DataFrame, reference: DataFrame, key: list[str]) -> DataFrame:
    """Clipped overlap of two (key, gram, n) count tables that were counted apart."""
    both = predicted.withColumnRenamed("n", "n_p").join(
        reference.withColumnRenamed("n", "n_r"), [*key, "gram"])
    return both.groupBy(*key).agg(F.sum(F.least("n_p", "n_r")).alias("overlap"))


def gram_counts(df: DataFrame, key: list[str], text: str, n: int = 1) -> DataFrame:
    grams = ngrams(tokens(F.col(text)), n)
    return (df.select(*key, F.explode(grams).alias("gram"))
            .groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("n")))


@F.pandas_udf(T.IntegerType())
def _lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for p, r in batches:
        yield pd.Series([lcs.length(list(a), list(b)) for a, b in zip(p, r)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def _union_hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for p, r in batches:
        yield pd.Series([lcs.union_hits([list(x) for x in b], [list(x) for x in a])
                         for a, b in zip(p, r)], dtype="int32")


def rouge_l(pairs: DataFrame, key: list[str], stemmed: bool = False) -> DataFrame:
    rows = tokenised(pairs.select(*key, "prediction", "reference"), stemmed)
    return rows.withColumn("_n", _lcs("p", "r")).select(
        *key, *scores(F.col("_n"), F.size("p"), F.size("r"), "rougeL"))


def _lines(name: str) -> Column:
    """Tokens of each line that has any."""
    whole = F.transform(F.split(F.coalesce(F.col(name), F.lit("")), "\n"), tokens)
    return F.filter(whole, lambda ts: F.size(ts) > 0)


def rouge_lsum(pairs: DataFrame, key: list[str], stemmed: bool = False) -> DataFrame:
    """Union LCS over lines."""
    rows = pairs.select(*key, _lines("prediction").alias("p"), _lines("reference").alias("r"))
    if stemmed:
        rows = rows.withColumns({s: stem_lines(s) for s in ("p", "r")})
    return rows.withColumn("_n", _union_hits("p", "r")).select(
        *key, *scores(F.col("_n"), F.size(F.flatten("p")), F.size(F.flatten("r")), "rougeLsum"))


def mean_scores(parts: dict[str, DataFrame]) -> DataFrame:
    """Mean F1 per metric over all given pairs, times 100, four decimals: one row.

    A pair whose prediction is missing scores 0 here; leave such pairs out before scoring to have
    the mean of the others. Each metric is averaged on its own, so pairs are never joined with themselves.
    """
    rows = [df.select(F.lit(name).alias("metric"), F.col(f"{name}_f").alias("f"))
            for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).agg(*[
        as_score(F.avg(F.when(F.col("metric") == name, F.col("f")))).alias(name) for name in parts])


def _f1(hits: int, n_p: int, n_r: int) -> float:
    p, r = hits / n_p if n_p else 0.0, hits / n_r if n_r else 0.0
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def _overlap(p: list, r: list) -> int:
    return (Counter(p) & Counter(r)).total()


METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def pair_scores(stemmed: bool = True):
    """UDF over token arrays per line of prediction and reference: F1 of all four metrics."""
    @F.pandas_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS]))
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        stems = _stemmer() if stemmed else list
        for predictions, references in batches:
            rows = []
            for p_lines, r_lines in zip(predictions, references):
                p_lines, r_lines = [stems(x) for x in p_lines], [stems(x) for x in r_lines]
                p, r = [t for x in p_lines for t in x], [t for x in r_lines for t in x]
                pairs = list(zip(p, p[1:])), list(zip(r, r[1:]))
                rows.append((
                    _f1(_overlap(p, r), len(p), len(r)),
                    _f1(_overlap(*pairs), len(pairs[0]), len(pairs[1])),
                    _f1(lcs.length(p, r), len(p), len(r)),
                    _f1(lcs.union_hits(r_lines, p_lines), len(p), len(r))))
            yield pd.DataFrame(rows, columns=list(METRICS))
    return score


def scored_pairs(pairs: DataFrame, key: list[str], stemmed: bool = True) -> DataFrame:
    """Rows (key, ``present``, ``s``): whether a pair has a prediction, and its F1 of all metrics.

    A pair is tokenised, stemmed and scored once, in its own row; without a prediction ``s`` is null.
    """
    sides = [_lines(c).alias(c[0]) for c in ("prediction", "reference")]
    present = F.col("prediction").isNotNull()
    rows = pairs.select(*key, present.alias("present"), *sides)
    return rows.select(*key, "present", F.when(
        F.col("present"), pair_scores(stemmed)("p", "r")).alias("s"))


def corpus_scores(pairs: DataFrame, key: list[str], stemmed: bool = True) -> DataFrame:
    """Means of all four metrics, times 100, over pairs with a prediction, and how many pairs and
    missing predictions there are: one row."""
    return scored_pairs(pairs, key, stemmed).agg(
        *[as_score(F.avg(f"s.{m}")).alias(m) for m in METRICS],
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.sum((~F.col("present")).cast("long")), F.lit(0)).alias("missing"))


def interval_scores(pairs: DataFrame, key: list[str], stemmed: bool = True,
                    metrics=METRICS, **options) -> DataFrame:
    """Low, middle and high corpus score of each metric over resampled corpora, times 100, four
    decimals: rows (metric, low, mid, high). ``options`` are those of ``bootstrap.intervals``."""
    scored = scored_pairs(pairs, key, stemmed).filter("present").select(*key, "s.*")
    found = bootstrap.intervals(scored, key, list(metrics), **options)
    return found.select("metric", *[as_score(F.col(c)).alias(c) for c in ("low", "mid", "high")])


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Every distinct token with its stem; each is stemmed once."""
    words = df.select(F.explode(tokens(F.col(text))).alias("token")).distinct()
    return words.withColumn("stem", stem_one("token"))


def attach_stems(rows: DataFrame, stems: DataFrame, max_bytes: int = VOCABULARY_BYTES,
                 salts: int = 64, often: int = OFTEN) -> DataFrame:
    """Join stems to a (…, token) table.

    The stem table is stored once and measured: below ``max_bytes`` it is broadcast. Above, both sides are
    shuffled, and since a few words make up much of any text, tokens with over ``often`` rows are
    spread over ``salts`` copies of their stem. All others have one.
    """
    stems = stored(stems, "stems")
    size = stems.agg(F.coalesce(
        F.sum(F.octet_length("token") + F.octet_length("stem") + 64), F.lit(0))).first()[0]
    if size <= max_bytes:
        return rows.join(F.broadcast(stems), "token", "left")
    salted, copies = _salted(stored(rows, "tokens"), stems, salts, often)
    return salted.join(copies, ["token", "_salt"], "left").drop("_salt")


def _salted(rows: DataFrame, stems: DataFrame, salts: int, often: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_salt``, which is 0 for tokens of at most ``often`` rows."""
    hot = F.broadcast(rows.groupBy("token").count().filter(F.col("count") > often).select(
        F.col("token").alias("_hot")))  # at most one for each ``often`` rows
    is_hot, every = F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    salted = rows.join(hot, F.col("token") == F.col("_hot"), "left").withColumn(
        "_salt", F.when(is_hot, salt).otherwise(0)).drop("_hot")
    copies = stems.join(hot, F.col("token") == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted, copies
