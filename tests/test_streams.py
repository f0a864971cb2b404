import datetime as dt
import random

from pyspark.sql import functions as F

from newsmill.operators import clean, ledger
from newsmill.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def arrive(parts, path):
    """Write parts as files with increasing modification times."""
    import os
    import time
    schema = parts[0].schema
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 1e9:
                os.utime(full, (1e6 + i, 1e6 + i)) if os.path.getmtime(full) > 1e8 else None
        time.sleep(0.01)
    return schema


def test_streamed_cleaning_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, str(rng.randint(0, 60)), rng.choice("abcdefgh") * rng.choice((40, 60, 70)) + rng.choice(("", "😀")),
             rng.choice(("h", "hi", "", None))) for i in range(200)]
    schema = "n long, id string, article string, highlights string"
    parts = [spark.createDataFrame(rows[i:i + 50], schema) for i in range(0, 200, 50)]
    arrive(parts, str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), parts[0].schema, 1)
    streams.run_available(streams.clean_batches(stream, "n", str(tmp_path / "out"), str(tmp_path / "state")),
                          str(tmp_path / "check"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() > 1
    want = clean.clean_articles(spark.createDataFrame(rows, schema), "n")
    assert sorted(out.drop("batch").collect()) == sorted(want.collect())


def test_bounded_cleaning(spark, tmp_path):
    rows = [(1, "a", "x" * 60, "h"), (2, "a", "y" * 60, "h"), (3, "b", "x" * 60, "h"), (4, "c", "z" * 60, "h")]
    df = spark.createDataFrame(rows, "n long, id string, article string, highlights string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), df.schema).withColumn("ts", F.current_timestamp())
    out = streams.clean_within(stream, "ts", "1 hour")
    writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    streams.run_available(writer, str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r["id"] for r in got}) == len(got) and len({r["article"] for r in got}) == len(got)
    assert {"c"} <= {r["id"] for r in got} and len(got) in (2, 3)


def test_streamed_totals_equal_batch(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=7 * i), "ab"[i % 2], None if i % 5 == 0 else i / 4) for i in range(60)]
    schema = "ts timestamp, stage string, emissions_kg double"
    parts = [spark.createDataFrame(rows[i:i + 20], schema) for i in range(0, 60, 20)]
    arrive(parts, str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), parts[0].schema, 1)
    out = str(tmp_path / "out")
    writer = streams.stage_totals(stream).writeStream.outputMode("complete").foreachBatch(
        lambda df, n: df.write.mode("overwrite").parquet(out))
    streams.run_available(writer, str(tmp_path / "check"))
    want = ledger.totals(spark.createDataFrame(rows, schema), by=["stage"])
    assert sorted(spark.read.parquet(out).collect()) == sorted(want.collect())

    hourly = streams.windowed_totals(streams.read_files(spark, str(tmp_path / "in"), parts[0].schema, 1))
    writer = hourly.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "hourly"))
    streams.run_available(writer, str(tmp_path / "check2"))
    closed = spark.read.parquet(str(tmp_path / "hourly"))
    got = {(r["window"]["start"], r["stage"]): r["total_kg"] for r in closed.collect()}
    sums = {}
    for ts, stage, kg in rows:
        key = (ts.replace(minute=0), stage)
        sums[key] = sums.get(key, 0) + (kg or 0)
    assert got and all(sums[k] == v for k, v in got.items())


def test_streamed_pacing_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    times = sorted(rng.random() * 20_000 for _ in range(300))
    rows = [(i, rng.choice("aab"), T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)]
    schema = "n long, k string, ts timestamp"
    parts = [spark.createDataFrame(rows[i:i + 100], schema) for i in range(0, 300, 100)]
    arrive(parts, str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), parts[0].schema, 1)
    writer = streams.pace_batches(stream, "k", "ts", "n", 80, str(tmp_path / "out"), str(tmp_path / "state"))
    streams.run_available(writer, str(tmp_path / "check"))
    got = {r["n"]: r["release"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = ledger.release_times(spark.createDataFrame(rows, schema), "k", "ts", "n", 80)
    assert got == {r["n"]: r["release"] for r in batch.collect()}


def test_streamed_pages_split_good_from_bad(spark, tmp_path):
    body = "A sentence that is long enough to be kept here. " * 10
    df = spark.createDataFrame([(1, "u1", f"<h1>A title that is long enough to stay</h1><article>{body}</article>"),
                                (2, "u2", "<p>none</p>")], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), df.schema)
    streams.run_available(streams.enrich_pages(stream, str(tmp_path / "out")), str(tmp_path / "check"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["page_id"], r["outcome"]) for r in out.collect()} == {(1, "ok"), (2, "error")}
