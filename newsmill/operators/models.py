"""Pluggable text models: summarise whole documents, score emotions, map over batches.

Real models are any callables; the defaults are stand-ins in plain Spark expressions (leading
sentences for a summary, a word list for emotions) and make no claim to equal a trained model.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.functions.emotions import from_label_scores, lexicon_scores
from newsmill.functions.guards import is_blank, scoring_guard, summary_guard
from newsmill.functions.text import (
    CHUNK_LIMIT, DIRECT_LIMIT, bind, count_tokens, count_words, sentences, summary_budget, words)
from newsmill.operators.chunk import chunks
from newsmill.operators.pin import pin

# texts, shortest lengths, longest lengths -> summaries
Summariser = Callable[[list[str], list[int], list[int]], list[str]]
# texts -> for each text its {label, score} items
Scorer = Callable[[list[str]], list[list[dict]]]
BATCH_SIZE = 32  # texts in one call of a model


def lead_summary(text: Column, max_len: Column) -> Column:
    """Leading sentences of up to ``max_len`` words; a longer first sentence is cut there."""
    def choose(s):
        def step(acc, n):
            total = acc["total"] + n
            return F.struct(total.alias("total"),
                            (acc["k"] + (total <= max_len).cast("int")).alias("k"))
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("k"))
        fitting = F.aggregate(F.transform(s, count_words), zero, step, lambda acc: acc["k"])
        return bind(fitting, lambda k: F.when(k > 0, F.array_join(F.slice(s, 1, k), " ")).otherwise(
            F.array_join(F.slice(words(F.coalesce(F.get(s, F.lit(0)), F.lit(""))), 1, max_len), " ")))
    return bind(sentences(text), choose)


def _lead_all(texts: Column, count) -> Column:
    def lead(t):
        return bind(summary_budget(count_tokens(t, count=count))["max_len"],
                    lambda top: lead_summary(t, top))
    return F.transform(texts, lead)


def in_batches(model: Callable, size: int, *columns: list) -> list:
    """Results of a model, called with at most ``size`` rows of about the same length.

    What a call gives is paired with its rows only if it gives one result for each; otherwise
    these rows have none.
    """
    made = [None] * len(columns[0])
    order = sorted(range(len(made)), key=lambda i: len(columns[0][i]))
    for start in range(0, len(order), size):
        rows = order[start:start + size]
        out = model(*[[c[i] for i in rows] for c in columns])
        if isinstance(out, (list, tuple)) and len(out) == len(rows):
            for i, x in zip(rows, out):
                made[i] = x
    return made


def model_udf(load: Callable[[], Summariser], batch_size: int = BATCH_SIZE):
    """A UDF over ARRAY<STRING> that loads the model once per task.

    A text whose call went wrong is null in the result.
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for texts, lows, highs in batches:
            flat = [[x for row in part if row is not None for x in row]
                    for part in (texts, lows, highs)]
            made = iter([x if isinstance(x, str) else None
                         for x in in_batches(model, batch_size, *flat)])
            yield pd.Series([None if row is None else [next(made) for _ in row] for row in texts])
    return apply


def _apply(texts: Column, udf, count) -> Column:
    """Summaries of an array of texts, each with the budget of its own token count."""
    if udf is None:
        return _lead_all(texts, count)
    budgets = F.transform(texts, lambda t: summary_budget(count_tokens(t, count=count)))
    return udf(texts, F.transform(budgets, lambda b: b["min_len"]),
               F.transform(budgets, lambda b: b["max_len"]))


def summarise(df: DataFrame, text: str, load: Callable[[], Summariser] | None = None,
              max_tokens: int = CHUNK_LIMIT, direct_limit: int = DIRECT_LIMIT,
              count=count_words, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add ``n_tokens, route, n_chunks, combined_tokens, summary``.

    Chunks stay an array inside their document's row, in order, so mapping and combining need no
    shuffle. Blank texts and single-pass documents hand the model an empty array at the steps
    that do not concern them. ``count`` (Column -> Column) counts tokens without markers. The
    summary is null where the model gave none for a part of the text.
    """
    udf = model_udf(load, batch_size) if load else None
    t = F.col(text)

    def whole(c):
        return count_tokens(c, count=count).cast("int")

    def complete(parts):
        return ~F.exists(parts, lambda x: x.isNull())

    blank, none = is_blank(t), F.array().cast("array<string>")
    sized = df.withColumn("n_tokens", F.coalesce(whole(t), F.lit(0)))
    sized = sized.withColumn("route", F.when(blank, "blank").otherwise(
        F.when(F.col("n_tokens") <= direct_limit, "direct").otherwise("chunked")))
    parts = (F.when(F.col("route") == "chunked", chunks(t, max_tokens, count))
             .when(F.col("route") == "direct", F.array(t)).otherwise(none))
    made = (sized.withColumn("_parts", parts).withColumn("n_chunks", F.size("_parts"))
            .withColumn("_made", _apply(F.col("_parts"), udf, count))
            .withColumn("_joined", F.when(complete("_made"), F.array_join("_made", " ")))
            .withColumn("combined_tokens", whole(F.col("_joined"))))
    again = (F.col("route") == "chunked") & (F.col("combined_tokens") > direct_limit)
    final = (made.withColumn("_again", F.when(again, F.array("_joined")).otherwise(none))
             .withColumn("_final", _apply(F.col("_again"), udf, count)))
    summary = F.when(again, F.get("_final", F.lit(0))).otherwise(F.col("_joined"))
    out = (final.withColumn("summary", summary)
           .drop("_parts", "_made", "_joined", "_again", "_final"))
    return pin(out, "n_tokens", "route", "n_chunks", "combined_tokens", "summary")


def respond(df: DataFrame, title: str, text: str) -> DataFrame:
    """The response record: ``status, title, summary, full_article``."""
    status = F.when(F.col(title).isNull() | F.col(text).isNull(), "missing").otherwise(
        summary_guard(F.col("summary")))
    return df.withColumn("status", status).withColumn("full_article", F.col(text))


def scorer_udf(load: Callable[[], Scorer], batch_size: int = BATCH_SIZE):
    """Scores of each text, null where the model's output has the wrong shape, and for all texts
    of a call that gives more or fewer results than it had texts."""
    kind = T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))

    def well_formed(items):
        return isinstance(items, list) and all(
            isinstance(i, dict) and "label" in i and "score" in i for i in items)

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            made = iter(in_batches(model, batch_size, [t for t in texts if t is not None]))
            rows = [None if t is None else next(made) for t in texts]
            yield pd.Series([r if well_formed(r) else None for r in rows])
    return apply


def score_emotions(df: DataFrame, text: str, load: Callable[[], Scorer] | None = None,
                   lexicon=None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add ``status, detail, probabilities``. Rejected texts keep their row and never reach
    the model."""
    guarded = df.withColumn("_g", scoring_guard(F.col(text)))
    offered = F.when(F.col("_g.status") == "ok", F.col(text))
    if load:
        scores = from_label_scores(scorer_udf(load, batch_size)(offered))
    else:
        scores = F.when(offered.isNotNull(), lexicon_scores(offered, lexicon) if lexicon
                        else lexicon_scores(offered))
    out = guarded.withColumn("probabilities", scores)
    broken = (F.col("_g.status") == "ok") & F.col("probabilities").isNull()
    out = out.withColumns({
        "status": F.when(broken, "error").otherwise(F.col("_g.status")),
        "detail": F.when(broken, "analyzer output is invalid").otherwise(F.col("_g.detail")),
    }).drop("_g")
    return pin(out, "status", "detail", "probabilities")


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply ``fn`` to Arrow batches; only the columns of ``schema`` remain."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)
    return df.mapInPandas(run, schema)
