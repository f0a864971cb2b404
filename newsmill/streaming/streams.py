"""Streaming forms of cleaning, page enrichment, ledger totals and request pacing.

Sinks that need state across batches write one folder per batch and only ever replace that
folder, so a batch repeated after a failure leaves the same tables. State holds keys, never texts,
and is folded together now and then.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsmill.functions.text import keeps_corpus_text
from newsmill.operators import clean, ledger, models, pages
from newsmill.streaming import keyed

FILE = "_file"  # where an arriving row stands
FOLDED = 16  # batches whose state is folded into one folder


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None,
               **options) -> DataFrame:
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _state(spark: SparkSession, path: str, batch: int, fold=lambda df: df,
           schema: StructType | None = None) -> DataFrame | None:
    """What earlier batches left, as one table; no file is opened for a ``schema`` that is given.

    After every ``FOLDED`` batches all state before is folded into one folder, so a batch reads
    a bounded number of folders. A folder is written from those before it alone: a batch that is
    repeated writes the same again.
    """
    def parts(upto):
        base = (upto - 1) // FOLDED * FOLDED
        found = [f"{path}/base={base}"] if base else []
        return found + [f"{path}/batch={n}" for n in range(base, upto)]

    if not batch:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    if batch % FOLDED == 0:
        fold(reader.parquet(*parts(batch))).write.mode("overwrite").parquet(f"{path}/base={batch}")
        return reader.parquet(f"{path}/base={batch}")
    return fold(reader.parquet(*parts(batch)))


def clean_batches(stream: DataFrame, order_by: str, out: str, state: str):
    """Clean arriving articles with the batch cleaner's rules; the first arrival survives.

    State has one narrow row per id ever kept. Returns a stream writer.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = clean.clean_keys(batch, order_by)
        fresh = keys.groupBy("id").agg(F.min(order_by).alias(order_by), *[
            F.min_by(c, order_by).alias(c) for c in ("fp_lo", "fp_hi", "fits")])
        seen = _state(spark, state, number)
        if seen is not None:
            old = seen.select(F.col("id").alias("old_id"))
            fresh = fresh.join(old, fresh["id"].eqNullSafe(old["old_id"]), "left_anti")
        _write_batch(fresh, f"{state}", number)
        fresh = spark.read.parquet(f"{state}/batch={number}")
        kept = fresh.filter("fits").groupBy("fp_lo", "fp_hi").agg(F.min(order_by).alias(order_by))
        if seen is not None:
            kept = kept.join(seen.select("fp_lo", "fp_hi"), ["fp_lo", "fp_hi"], "left_anti")
        rows = batch.filter(keeps_corpus_text(F.col("article")) & keeps_corpus_text(F.col("highlights")))
        _write_batch(clean.keep_rows(rows, kept, order_by).transform(clean.remove_emoji), out, number)

    return stream.writeStream.foreachBatch(apply)


def clean_files(spark: SparkSession, path: str, schema, order_by: str, out: str,
                files_per_batch: int | None = None, prepare=lambda df: df, **options):
    """Clean the Parquet files that arrive in a folder with the batch cleaner's rules; the first
    arrival survives, whenever a copy comes.

    Only keys pass through the stream's state; of the files of a batch, the rows that survive are
    then read once more. ``prepare`` makes articles of the rows of a file, with the row key
    ``order_by``. Returns a stream writer.
    """
    arriving = read_files(spark, path, schema, files_per_batch, **options)
    keys = keyed.surviving_keys(
        prepare(arriving.withColumn(FILE, F.col("_metadata.file_path"))), order_by, carry=[FILE])

    def apply(batch: DataFrame, number: int) -> None:
        _write_batch(batch, f"{out}-keys", number)
        kept = spark.read.schema(batch.schema).parquet(f"{out}-keys/batch={number}")
        files = [r[0] for r in kept.select(FILE).distinct().collect()]  # those of one batch at most
        rows = prepare(spark.read.schema(schema).parquet(*files)) if files else \
            prepare(spark.createDataFrame([], schema))
        _write_batch(clean.remove_emoji(clean.keep_rows(rows, kept, order_by)), out, number)

    keyed.with_keyed_state(spark)
    return keys.writeStream.foreachBatch(apply)


def clean_within(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Clean arriving articles with bounded state: copies further apart than ``delay`` in ``ts``
    are not recognised. Article rows carry no time of their own, so ``ts`` is when they arrived."""
    text = stream.transform(clean.remove_emoji).transform(clean.drop_missing)
    marked = text.withColumns(dict(zip(("fp_lo", "fp_hi"), clean.fingerprint("article", "highlights"))))
    once = (marked.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])
            .dropDuplicatesWithinWatermark(["fp_lo", "fp_hi"]))
    return once.drop("fp_lo", "fp_hi").transform(clean.drop_short).transform(
        clean.drop_long_highlights)


def enrich(page_rows: DataFrame, keep=("page_id",), summariser=None, scorer=None, **limits) -> DataFrame:
    """Pages -> extracted article, summary, emotion scores, and an ``outcome``.

    Row by row, so the same plan serves tables and streams.
    """
    found = pages.extract_pages(page_rows, keep).withColumnsRenamed(
        {"status": "page_status", "branch": "page_branch"})
    made = models.respond(models.summarise(found, "text", summariser, **limits), "title", "text")
    made = made.withColumnRenamed("status", "summary_status")
    # an invalid summary is not offered to the scorer
    offered = F.when(F.col("summary_status") == "ok", F.col("summary"))
    scored = models.score_emotions(made.withColumn("_offered", offered), "_offered", scorer)
    good = (F.col("page_status") == "ok") & (F.col("summary_status") == "ok") & (F.col("status") == "ok")
    reason = (F.when(F.col("page_status") != "ok", F.col("page_status"))
              .when(F.col("summary_status") != "ok", "summarizer output is invalid")
              .otherwise(F.col("detail")))
    return scored.select(
        *keep, "link", F.when(good, "ok").otherwise("error").alias("outcome"),
        F.when(~good, reason).alias("reason"), "title", "summary", "full_article", "probabilities")


def enrich_pages(stream: DataFrame, out: str, **options):
    """Good and bad rows land in separate folders of one write, so pages are parsed once.

    The rows of a batch need no other, so the plan is made once and serves every batch; the sink's
    log has the files of each batch once, however often it is tried.
    """
    rows = enrich(stream, **options)
    return rows.writeStream.format("parquet").partitionBy("outcome").option("path", out)


def stage_totals(stream: DataFrame) -> DataFrame:
    """Continuous totals per stage, for output mode complete or update."""
    return ledger.totals(stream, by=["stage"])


def windowed_totals(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Totals per stage and time window; a window closes once the watermark passes it."""
    return (stream.withWatermark("ts", delay)
            .transform(lambda s: ledger.totals(s, by=[F.window("ts", width), "stage"])))


def pace_arrivals(stream: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, delay: str,
                  out: str, state: str, **options):
    """Release times of requests that arrive in any order, at most ``delay`` behind later ones.

    Requests are held until the watermark has passed them (``keyed.in_time_order``, which takes
    the ``options``) and then paced as by ``pace_batches``.
    """
    keyed.with_keyed_state(stream.sparkSession)
    held = keyed.in_time_order(stream, ts, delay, **options)
    return pace_batches(held, key, ts, tie, gap_seconds, out, state)


def pace_batches(stream: DataFrame, key: str, ts: str, tie: str, gap_seconds: float,
                 out: str, state: str, unit: str | None = None):
    """Release times of arriving requests, each batch going on from the last release per key.

    A batch is paced by the two-level scan, so a busy key is spread over tasks. Batches must
    arrive in time order, as the requests themselves do; ``pace_arrivals`` puts them in order.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a batch is read several times, and may come out of a stateful step
        batch.write.mode("overwrite").parquet(f"{state}-now")
        batch = spark.read.schema(batch.schema).parquet(f"{state}-now")
        known = StructType([batch.schema[key], StructField("last", LongType())])
        carry = _state(spark, state, number, lambda df: df.groupBy(key).agg(
            F.max("last").alias("last")), known)
        made = ledger.release_times(batch, key, ts, tie, gap_seconds, unit, carry)
        _write_batch(made, out, number)
        last = spark.read.schema(made.schema).parquet(f"{out}/batch={number}").groupBy(key).agg(
            F.max("release").alias("last"))
        _write_batch(last, state, number)  # keys of this batch only

    return stream.writeStream.foreachBatch(apply)
