"""Exact copies by two passes over a counting Bloom filter, in DataFrame functions only.

Pass one folds the digest of every row into words of the filter: a word has ``COUNTERS`` counters
of four bits, and a row adds one to two of them, so a sum over (word) is the merged filter. Only
words that a row touches exist, a task sends each of its words once, and neither ids nor texts
move. Pass two looks up every row: a row whose two counters are not both above one is the only
one of its text and passes straight through; the others, which may be repeated, are stored and
settled by their whole digest.

The filter has ``WORDS_PER_ROW`` words a row, whatever the number of rows, so it lets about one
single row in a thousand pass for a possible copy at every size. What pass two needs of it, words
with a counter above one, is broadcast below ``BROADCAST_BYTES`` and joined by shuffling beyond.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.session import stored

COUNTERS = 15  # four bits each; the highest four of the word stay free
MOST = 15  # what a counter holds; a word touched more often than that counts as full
ONES = sum(1 << (4 * i) for i in range(COUNTERS))
WORDS_PER_ROW = 8
BROADCAST_BYTES = 16 << 20
HEAVY = 10_000  # keys with more than this share of the rows are broadcast, so at most so many
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text without white space; a null text is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def _hashed(row: Column, text: str, order: str) -> list[Column]:
    return [row.alias("_row"), F.col(order).alias("_id"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_length"),
            F.unhex(F.sha2(normalised(text), 256)).alias("_sha")]


def _placed(rows: DataFrame, words: int) -> DataFrame:
    """Add the word of the filter a row belongs to, and its two counters as a number."""
    first = F.pmod(F.xxhash64("_sha", F.lit(1)), F.lit(COUNTERS))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("_sha", F.lit(2)), F.lit(COUNTERS - 1)), F.lit(COUNTERS))
    one = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), (place * 4).cast("int"))
    return rows.withColumns({"_word": F.pmod(F.xxhash64("_sha"), F.lit(words)),
                             "_mark": one(first) + one(second)})


def repeated_words(rows: DataFrame) -> DataFrame:
    """Pass one, over rows (_word, _mark): words in which a counter is above one.

    ``_twice`` has the lowest bit of each such counter, ``_n`` is how many rows the word has. Up
    to ``MOST`` rows no counter can run over; a word with more counts as repeated throughout.
    """
    words = rows.groupBy("_word").agg(F.try_sum("_mark").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    above = F.shiftright("_sum", 1).bitwiseOR(F.shiftright("_sum", 2)).bitwiseOR(F.shiftright("_sum", 3))
    twice = F.when(F.col("_n") > MOST, F.lit(ONES)).otherwise(above.bitwiseAND(F.lit(ONES)))
    return words.select("_word", twice.alias("_twice"), "_n").filter("_n > 1 and _twice <> 0")


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int, width: int) -> DataFrame:
    """Left join with a stored table of one row a key, of at most ``width`` bytes, and ``_n``, the
    rows it has.

    A table below ``BROADCAST_BYTES`` is broadcast. Beyond, rows of heavy keys meet those keys by a
    broadcast of at most ``HEAVY`` rows, and only the others are shuffled.
    """
    if table.count() * width <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, "left")
    heavy = F.col("_n") > total // HEAVY
    hot = F.broadcast(table.filter(heavy))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.filter(~heavy), key, "left"))


def _settle(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are alone with their text, and the others with ``_n`` and the ``_best`` of them."""
    placed = _placed(rows, max(1, total) * WORDS_PER_ROW)
    words = stored(repeated_words(placed.select("_word", "_mark")), "filter")
    probed = look_up(placed, words, "_word", total, 24).withColumn(
        "_maybe", F.coalesce(F.col("_twice").bitwiseAND(F.col("_mark")) == F.col("_mark"), F.lit(False)))
    own = ["_row", "_id", "_length", "_sha"]
    alone = probed.filter(~F.col("_maybe")).select(*own)
    maybe = stored(probed.filter("_maybe").select(
        *own, F.monotonically_increasing_id().alias("_tie")), "maybe_repeated")
    rank = F.struct((-F.col("_length")).alias("short"), F.col("_id").isNull().alias("none"),
                    F.col("_id").alias("id"), F.col("_tie").alias("tie"))
    groups = stored(maybe.groupBy("_sha").agg(
        F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_best")), "groups")
    return alone, look_up(maybe, groups, "_sha", total, 128)


def copies(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are so without white space; null counts as empty, so null, empty
    and blank texts are one group. Of equal texts the longest original stays, then the smallest
    id, null being the largest; of rows equal in both, exactly one. Other columns don't matter,
    an empty table gives no rows.
    """
    rows = stored(docs.select(*_hashed(F.struct(F.col(order).alias("id")), text, order)), "digests")
    alone, grouped = _settle(rows, rows.count())
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    return alone.select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha,
    ).unionByName(grouped.select(
        F.col("_id").alias("doc_id"), F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_tie") == F.col("_best.tie")).alias("kept"), sha))


def drop_copies(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns, by the rules of ``copies``.

    Documents are read twice. Those that the filter shows to be alone are passed on where they
    are read; only the others are stored.
    """
    rows = docs.select(*_hashed(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text, order))
    alone, grouped = _settle(rows, docs.count())
    return alone.select("_row.*").unionAll(
        grouped.filter(F.col("_tie") == F.col("_best.tie")).select("_row.*"))
