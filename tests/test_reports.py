import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from newsmill.operators import ledger
from newsmill.sources import reports
from newsmill.streaming import streams
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def records(spark, rows):
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=i), s, kg) for i, s, kg in rows],
                               "ts timestamp, stage string, kg double")
    return ledger.entries(df.repartition(3), "stage", "kg", F.col("ts"))


@pytest.fixture(autouse=True, scope="module")
def known(spark):
    reports.register(spark)


def append(df, path, project="news"):
    df.write.format(reports.NAME).option("project", project).mode("append").save(path)


def test_round_trip_and_head(spark, tmp_path):
    path = str(tmp_path / "report")
    assert reports.head(path) == {"project": None, "total_kg": 0.0, "total_g": 0.0, "records": 0}
    rows = [(0, "train", 1.5), (1, "predict", None), (2, None, 0.25)]
    append(records(spark, rows), path)
    append(records(spark, [(3, "train", 2.0)]), "file://" + path, "other")
    append(records(spark, []), path)
    got = sorted(map(tuple, spark.read.format(reports.NAME).load(path).collect()), key=repr)
    want = records(spark, rows).union(records(spark, [(3, "train", 2.0)]))
    assert got == sorted(map(tuple, want.collect()), key=repr)
    assert reports.head(path) == {"project": "news", "total_kg": 3.75, "total_g": 3750.0, "records": 4}


def test_no_report_yet(spark, tmp_path):
    assert spark.read.format(reports.NAME).load(str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception):
        spark.read.format(reports.NAME).load().collect()


def test_appends_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "report")
    frames = [records(spark, [(100 * i + k, f"s{i}", 1.0) for k in range(5)]) for i in range(8)]
    active = spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession

    def write(df):
        active(spark._jsparkSession)  # a thread looks sources up in the session it has
        append(df, path)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, frames))
    assert spark.read.format(reports.NAME).load(path).count() == 40
    assert reports.head(path)["records"] == 40 and reports.head(path)["total_kg"] == 40.0
    assert len(os.listdir(os.path.join(path, reports.COMMITS))) == 8


def test_records_of_a_failed_write_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "report")
    append(records(spark, [(0, "a", 1.0)]), path)
    bad = records(spark, [(i, "b", 1.0) for i in range(50)]).withColumn(
        "stage", F.when(F.col("emissions_kg") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("stage")))
    with pytest.raises(Exception):
        append(bad, path)
    assert [r["stage"] for r in spark.read.format(reports.NAME).load(path).collect()] == ["a"]
    assert reports.head(path)["records"] == 1


def test_a_stream_reads_every_commit_once(spark, tmp_path):
    path, home = str(tmp_path / "report"), str(tmp_path)

    def run():
        rows = spark.readStream.format(reports.NAME).load(path)
        query = rows.writeStream.format("parquet").option("path", f"{home}/out").option(
            "checkpointLocation", f"{home}/check").start()
        query.processAllAvailable()
        query.stop()

    append(records(spark, [(0, "a", 1.0), (1, "b", 2.0)]), path)
    run()
    append(records(spark, [(2, "c", 3.0)]), path)
    append(records(spark, [(3, "d", 4.0)]), path)
    run()
    assert sorted(r["stage"] for r in spark.read.parquet(f"{home}/out").collect()) == ["a", "b", "c", "d"]
