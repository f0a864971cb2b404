"""Corpus cleaning: emoji removal, row filters, deterministic dedup.

Rows need an ``order_by`` column that is unique and fixed by the data (a number, or a path and
row index), so that the same row survives whatever the partitioning or the retries.
"""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.functions.text import keeps_corpus_text, strip_emoji
from newsmill.session import scratch, stored

MIN_ARTICLE = 50
DROPPED_BYTES = 32 << 20  # most row keys that are broadcast


def fingerprint(*columns: str) -> list[Column]:
    """120 bits of a cryptographic digest that stand for a tuple of texts, as two longs.

    Texts are crawled and may have been chosen to collide, which a fast hash does not withstand.
    Each is preceded by its length, nulls by none. Two fixed-width keys let Spark use hash
    aggregation and shuffle 16 bytes instead of whole articles.
    """
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c).cast("string")),
                        F.lit("-")) for c in columns]
    digest = F.sha2(F.concat(*parts), 256)
    return [F.conv(F.substring(digest, begin, 15), 16, 10).cast("long").alias(name)
            for begin, name in ((1, "fp_lo"), (16, "fp_hi"))]


def remove_emoji(df: DataFrame, emoji: str = "corpus") -> DataFrame:
    """``emoji`` names the class of deleted characters; that of the corpus holds CJK too."""
    return df.withColumns({c: strip_emoji(F.col(c), emoji) for c in ("article", "highlights")})


def drop_missing(df: DataFrame) -> DataFrame:
    a, h = F.col("article"), F.col("highlights")
    return df.filter(a.isNotNull() & h.isNotNull()).filter((a != "") & (h != ""))


def drop_short(df: DataFrame, min_chars: int = MIN_ARTICLE) -> DataFrame:
    return df.filter(F.length("article") > min_chars)


def drop_long_highlights(df: DataFrame) -> DataFrame:
    return df.filter(F.length("highlights") < F.length("article"))


def keep_rows(df: DataFrame, survivors: DataFrame, order_by: str) -> DataFrame:
    """Fetch full rows back by row key.

    The key is unique, so a hot id or a large group of copies is spread evenly here.
    """
    return df.join(survivors.select(order_by), order_by, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """One row per key, the first by ``order_by``.

    Only keys and row keys are aggregated, with partial aggregation before the shuffle: a key
    held by a third of the table arrives as one row per map task.
    """
    winners = df.groupBy(*keys).agg(F.min(order_by).alias(order_by))
    return keep_rows(df, winners, order_by)


def dedup_ids(df: DataFrame, order_by: str, within=()) -> DataFrame:
    return first_per_key(df, [*within, "id"], order_by)


def dedup_pairs(df: DataFrame, order_by: str, within=()) -> DataFrame:
    marks = fingerprint("article", "highlights")
    winners = (df.select(*within, order_by, *marks)
               .groupBy(*within, "fp_lo", "fp_hi").agg(F.min(order_by).alias(order_by)))
    return keep_rows(df, winners, order_by)


def _with_text(df: DataFrame, emoji: str) -> DataFrame:
    return df.filter(keeps_corpus_text(F.col("article"), emoji)
                     & keeps_corpus_text(F.col("highlights"), emoji))


def clean_keys(df: DataFrame, order_by: str, within=(), emoji: str = "corpus") -> DataFrame:
    """Narrow rows of the table without emoji: keys, fingerprint, and the two length tests."""
    a, h = F.col("article"), F.col("highlights")
    text = remove_emoji(_with_text(df, emoji), emoji)
    fits = (F.length(a) > MIN_ARTICLE) & (F.length(h) < F.length(a))
    return text.select(*within, order_by, "id", *fingerprint("article", "highlights"),
                       fits.alias("fits"))


def survivors(keys: DataFrame, order_by: str, within=()) -> DataFrame:
    """Row keys that pass id dedup, then the length tests, then pair dedup.

    The length tests depend on the pair only, so they may run before pair dedup; they must not
    run before id dedup, where they could change which row of an id survives.
    """
    by_id = keys.groupBy(*within, "id").agg(
        F.min(order_by).alias(order_by),
        *[F.min_by(c, order_by).alias(c) for c in ("fp_lo", "fp_hi", "fits")])
    return (by_id.filter("fits").groupBy(*within, "fp_lo", "fp_hi")
            .agg(F.min(order_by).alias(order_by)).select(order_by))


def clean_articles(df: DataFrame, order_by: str, within=(), emoji: str = "corpus") -> DataFrame:
    """The whole cleaner. ``within`` names split columns that keep their own dedup scope.

    Article text is shuffled once, for the final fetch; both dedups run on narrow rows.
    """
    kept = survivors(clean_keys(df, order_by, within, emoji), order_by, within)
    return remove_emoji(keep_rows(_with_text(df, emoji), kept, order_by), emoji)


def clean_articles_stored(df: DataFrame, order_by: str, within=(),
                          max_broadcast_bytes: int = DROPPED_BYTES,
                          emoji: str = "corpus") -> DataFrame:
    """The same result in stages, for large corpora: the narrow tables are written down, and when
    few rows have to go, those are broadcast and article text is not shuffled at all.

    The keys of the dropped rows are measured first; above ``max_broadcast_bytes`` the survivors
    are fetched back as in ``clean_articles``.
    """
    keys = stored(clean_keys(df, order_by, within, emoji), "keys")
    kept = stored(survivors(keys, order_by, within), "survivors")
    dropped = keys.select(order_by).join(kept, order_by, "left_anti")
    # as text a key is no smaller than as a row of the broadcast, but for its fixed parts
    size = dropped.agg(F.coalesce(F.sum(
        F.octet_length(F.col(order_by).cast("string")) + 64), F.lit(0))).first()[0]
    rows = _with_text(df, emoji)
    if size <= max_broadcast_bytes:
        left = rows.join(F.broadcast(dropped), order_by, "left_anti")
    else:
        left = keep_rows(rows, kept, order_by)
    return remove_emoji(left, emoji)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Store rows in ``buckets`` by ``key`` in the shared folder, and read them back.

    Tables stored so by the same key and number join on it where they are read.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.option("path", scratch(spark, name))
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def clean_articles_bucketed(df: DataFrame, order_by: str, buckets: int, within=(),
                            emoji: str = "corpus") -> DataFrame:
    """The same result over a table that ``bucketed`` has stored by ``order_by`` in ``buckets``.

    The survivors, which are narrow, are stored in the same buckets, so no text is moved. Cleaning
    such a table anew, with other splits or another emoji class, moves none either.
    """
    kept = survivors(clean_keys(df, order_by, within, emoji), order_by, within)
    kept = bucketed(kept, order_by, buckets, "survivors")
    return remove_emoji(keep_rows(_with_text(df, emoji), kept.hint("merge"), order_by), emoji)


def clean_articles_wide(df: DataFrame, order_by: str, within=()) -> DataFrame:
    """The same result as a chain of single steps; kept to measure the narrow form against."""
    steps = df.transform(remove_emoji).transform(drop_missing)
    steps = dedup_pairs(dedup_ids(steps, order_by, within), order_by, within)
    return steps.transform(drop_short).transform(drop_long_highlights)
