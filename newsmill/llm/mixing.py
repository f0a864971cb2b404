"""Mix sources to target weights along a curriculum.

Every source has a weight that changes over training time; its integral from 0 to 1 is the words
the source owes to the mix. A document copy that starts after c words of its source is due when
the source's cumulative demand reaches c: inverting the integral gives its training position.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm.prefix import with_prefix
from newsmill.session import stored

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 500_000  # of five numbers each


def count_words(text: str = "text") -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_row(docs: DataFrame) -> Column:
    """Hash of all columns."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Words each source owes to the mix, from rows (source, source_size).

    Sources take ``weights`` in turn, ordered by code point with null last. All together owe
    ``share`` of all words; no source owes more than ``cap`` times its own size, and what it can't
    take goes to the others by weight. That is one level: sources are met in the order in which
    they reach their caps, and the level of the first one that stays below its cap holds. Works
    on one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    named = every.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumns({
        "_w": F.element_at(turn, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")),
        "_cap": F.col("source_size") * float(cap),
        "_all": F.sum("source_size").over(every) * float(share)})
    filling = every.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(
            filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("_below", F.col("_w") * (F.col("_all") - F.col("_full")) / F.col("_left")
                           < F.col("_cap"))
    first = F.min(F.when(F.col("_below"), F.struct(F.col("_cap") / F.col("_w"), "_full", "_left"))
                  ).over(every)
    rows = rows.withColumn("_level", first)
    owed = F.col("_w") * (F.col("_all") - F.col("_level._full")) / F.col("_level._left")
    return rows.select("source", "source_size", F.coalesce(
        F.least("_cap", owed), "_cap").alias("target"), "_w")


def curriculum(docs: DataFrame, weights: Sequence[float], share: float, cap: float,
               slopes: Sequence[float] = (0.6, 0.0, -0.6), seed: int = 17) -> DataFrame:
    """One row per document: size, source size, target, copies taken and their positions.

    The weight of the i-th source at time t is proportional to 1 + slope * (2 t - 1), slopes taken
    in turn, each between -1 and 1. Inside a source documents are ordered by a seeded hash of the
    id, and copies follow each other in passes over the whole source. A copy is taken when its
    middle word lies before the target, so a source misses its target by half of a document
    at most. ``positions`` are the times in [0, 1] at which the copies are due, in ascending order,
    ``position`` is the first of them, null if none is taken. Documents without words are never
    taken. Equal rows are mixed as documents of their own; ``turn``, the number of the source, and
    ``nth``, the place in its order, tell them apart. The copies themselves are put into training
    order by ``placed_copies``.
    """
    narrow = stored(docs.select(
        "doc_id", "source", count_words().alias("size"), whole_row(docs).alias("_key"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))),
                           1, 15), 16, 10).cast("long").alias("_mix")), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(s)) for s in slopes])
    owed = targets(sizes, weights, share, cap).withColumn("turn", F.row_number().over(named)).withColumn(
        "_slope", F.element_at(turn, ((F.col("turn") - 1) % len(slopes) + 1).cast("int")))
    owed = owed.withColumnRenamed("source", "_source")
    placed = with_prefix(narrow, ["_mix", "doc_id", "_key"], "size", within="source")
    rows = placed.join(owed, F.col("source").eqNullSafe(F.col("_source")))
    middle = F.col("_before") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.ceil(
        (F.col("target") - middle) / F.col("source_size")))).otherwise(0).cast("long")
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    starts = F.transform(passes, lambda k: F.col("_before") + k * F.col("source_size"))
    due = F.coalesce(F.transform(starts, due_at), F.array().cast("array<double>"))
    return rows.withColumn("copies", copies).withColumn("positions", due).select(
        *narrow.columns, "source_size", "target", "copies", "positions",
        F.get("positions", F.lit(0)).alias("position"), "turn", F.col("_row").alias("nth"))


def demand(time: Column) -> Column:
    """Words a row's source owes up to ``time``: the integral of its weight, all of the target at 1."""
    return F.col("target") * (time + F.col("_slope") * (time * time - time))


def due_at(word: Column) -> Column:
    """Position at which the demand of a row's source reaches ``word``: the inverse of ``demand``,
    a quadratic equation in the time."""
    part, a = word / F.col("target"), F.col("_slope")
    return F.when(a == 0, part).otherwise(
        (a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * part)) / (2 * a))


def placed_copies(docs: DataFrame, plan: DataFrame) -> tuple[DataFrame, list[str]]:
    """The mix itself: every taken copy as a whole row of ``docs``, range-sorted by position, with
    three more columns, whose names are given too: ``turn`` and ``nth`` of its row in the ``plan``
    that ``curriculum`` made, and its position.

    Copies of a document are rows equal to it. Rows equal in all columns are found together and
    come as often as they are taken together. Where the positions can be broadcast, only rows that
    are there more than once are placed by key; other texts move once, to their position.
    """
    tail = "_" * max(map(len, docs.columns))  # names that the documents cannot have
    keys, more = ["id" + tail, "row" + tail], ["turn" + tail, "nth" + tail, "at" + tail]
    known = plan.select(_known(F.col("doc_id")).alias(keys[0]), F.col("_key").alias(keys[1]),
                        F.col("turn").alias(more[0]), F.col("nth").alias(more[1]), "positions", "copies")
    copies = known.select(*keys, *more[:2], F.explode("positions").alias(more[2]))
    # the same keys twice, so that texts are placed once for both steps
    rows = docs.withColumns({keys[0]: _known(F.col("doc_id")), keys[1]: whole_row(docs)})
    if (plan.agg(F.sum("copies")).first()[0] or 0) > BROADCAST_ROWS:
        joined = rows.dropDuplicates(keys).join(copies, keys)
    else:
        equal = stored(known.groupBy(*keys).count().filter("count > 1").select(*keys), "equal")
        alone = copies.join(F.broadcast(equal), keys, "left_anti")
        joined = rows.join(F.broadcast(alone), keys)
        if not equal.isEmpty():
            once = rows.join(F.broadcast(equal), keys, "left_semi").dropDuplicates(keys)
            joined = joined.union(once.join(copies.join(F.broadcast(equal), keys, "left_semi"), keys))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = more[2], keys[0], *more[:2]
    return joined.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        *[F.col(f"`{c}`") for c in docs.columns], *more), more


def in_training_order(docs: DataFrame, weights: Sequence[float], share: float, cap: float,
                      **options) -> DataFrame:
    """The mix as rows of ``docs`` only."""
    plan = stored(curriculum(docs, weights, share, cap, **options), "plan")
    return placed_copies(docs, plan)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, weights: Sequence[float], share: float, cap: float, **options) -> DataFrame:
    """The rows of ``curriculum`` with what the mix holds of each document: ``taken``, the words of
    its copies, and the position of the first of them, both counted on the copies in place."""
    plan = stored(curriculum(docs, weights, share, cap, **options), "plan")
    mix, (turn, nth, at) = placed_copies(docs, plan)
    held = mix.groupBy(F.col(turn).alias("_turn"), F.col(nth).alias("_nth")).agg(
        F.sum(count_words()).alias("taken"), F.min(at).alias("_first"))
    same = (F.col("turn") == F.col("_turn")) & (F.col("nth") == F.col("_nth"))
    return plan.join(held, same, "left").select(
        *[c for c in plan.columns if c != "position"], F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.col("_first").alias("position"))


def _known(doc_id: Column) -> Column:
    """An id to join by; rows without one are told apart by the rest of the row."""
    return F.coalesce(doc_id.cast("long"), F.lit(0))
