"""Ledger queries: events as emission records and as requests."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsmill.functions.times import utc_instant
from newsmill.operators import ledger
from newsmill.plans.articles import table
from newsmill.plans.registry import query
from newsmill.session import scratch
from newsmill.sources import ledger as store
from newsmill.sources import reports

# failed runs leave no measurement
MEASURED = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"
RECORDS = f"""records AS (SELECT event_id, ts, event_type AS stage,
  coalesce({MEASURED}, 0) AS emissions_kg, coalesce({MEASURED}, 0) * 1000 AS emissions_g FROM events)"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", utc_instant(F.col("ts")))


def _ledger(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        "event_id", "ts", F.col("event_type").alias("stage"), F.expr(MEASURED).alias("emissions_kg"))
    return rows


@query(f"""WITH {RECORDS} SELECT CAST(epoch_us(ts) AS BIGINT) AS at, stage, emissions_kg, emissions_g
  FROM records""")
def ledger_round_trip(spark, sf_dir):
    """Append the records in two runs, read the ledger back."""
    path, rows = scratch(spark, "ledger"), _ledger(spark, sf_dir)
    for part in (F.col("stage") == "view", F.col("stage") != "view"):
        store.append(ledger.entries(rows.filter(part), "stage", "emissions_kg", F.col("ts")), path)
    return store.read(spark, path).select(
        F.unix_micros("ts").alias("at"), "stage", "emissions_kg", "emissions_g")


@query(f"""WITH {RECORDS} SELECT CAST(epoch_us(ts) AS BIGINT) AS at, stage, emissions_kg,
  round(emissions_g, 6) AS emissions_g FROM records""")
def report_round_trip(spark, sf_dir):
    """Append the records to a report in two runs, read the report back."""
    path, rows = scratch(spark, "report"), _ledger(spark, sf_dir)
    report = reports.register(spark)
    for part in (F.col("stage") == "view", F.col("stage") != "view"):
        made = ledger.entries(rows.filter(part), "stage", "emissions_kg", F.col("ts"))
        made.write.format(report).option("project", "news").mode("append").save(path)
    return spark.read.format(report).load(path).select(
        F.unix_micros("ts").alias("at"), "stage", "emissions_kg", F.round("emissions_g", 6).alias("emissions_g"))


@query(f"WITH {RECORDS} SELECT stage, emissions_kg, true AS stamped FROM records")
def ledger_stamped(spark, sf_dir):
    """Records without a time of their own get the time at which they are written."""
    path, begin = scratch(spark, "ledger"), datetime.now(timezone.utc)
    store.append(ledger.entries(_ledger(spark, sf_dir), "stage", "emissions_kg"), path)
    between = F.col("ts").between(F.lit(begin), F.lit(datetime.now(timezone.utc)))
    return store.read(spark, path).select("stage", "emissions_kg", between.alias("stamped"))


@query(f"""WITH {RECORDS} SELECT round(sum(emissions_kg), 4) AS total_kg,
  round(sum(emissions_g), 4) AS total_g, count(*) AS records FROM records""")
def ledger_totals(spark, sf_dir):
    return _rounded(ledger.totals(_ledger(spark, sf_dir)))


@query(f"""WITH {RECORDS} SELECT stage, round(sum(emissions_kg), 4) AS total_kg,
  round(sum(emissions_g), 4) AS total_g, count(*) AS records FROM records GROUP BY stage""")
def ledger_totals_by_stage(spark, sf_dir):
    return _rounded(ledger.totals(_ledger(spark, sf_dir), by=["stage"]))


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("total_kg", "total_g")})


def _running_sql(by):
    return f"""WITH {RECORDS} SELECT event_id, stage,
  round(sum(emissions_kg) OVER ({by} ORDER BY ts, event_id), 4) AS total_kg,
  round(sum(emissions_g) OVER ({by} ORDER BY ts, event_id), 4) AS total_g FROM records"""


@query(_running_sql(""))
def running_totals(spark, sf_dir):
    """The whole ledger as one history."""
    rows = ledger.running_totals(_ledger(spark, sf_dir), "event_id")
    return _rounded(rows).select("event_id", "stage", "total_kg", "total_g")


@query(_running_sql("PARTITION BY stage"))
def running_totals_by_stage(spark, sf_dir):
    rows = ledger.running_totals(_ledger(spark, sf_dir), "event_id", by=["stage"])
    return _rounded(rows).select("event_id", "stage", "total_kg", "total_g")


def _release_sql(key, gap):
    """The rule itself, request by request: a release waits for the one before it."""
    return f"""WITH RECURSIVE a AS (SELECT event_id, {key}, epoch_us(ts) AS arrival, row_number() OVER (
    PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT event_id, {key}, arrival, i, arrival AS release FROM a WHERE i = 1
  UNION ALL SELECT a.event_id, a.{key}, a.arrival, a.i, greatest(a.arrival, walk.release + {gap})
  FROM walk JOIN a ON a.{key} = walk.{key} AND a.i = walk.i + 1)
SELECT event_id, {key}, arrival, CAST(release AS BIGINT) AS release FROM walk"""


@query(_release_sql("user_id", 21_600_000_000))
def release_times(spark, sf_dir):
    """Requests per user, six hours apart."""
    return ledger.release_times(_events(spark, sf_dir), "user_id", "ts", "event_id", 21_600).select(
        "event_id", "user_id", "arrival", "release")


@query(_release_sql("event_type", 1_300_000_000))
def release_times_hot(spark, sf_dir):
    """Few keys, each with a long queue that runs over many time blocks."""
    return ledger.release_times(_events(spark, sf_dir), "event_type", "ts", "event_id", 1300).select(
        "event_id", "event_type", "arrival", "release")
