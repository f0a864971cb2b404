import datetime as dt
import json
import random

from newsmill.operators import ledger
from newsmill.sources import ledger as store

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def micros(t):
    return int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def test_entries_append_and_totals(spark, tmp_path):
    runs = spark.createDataFrame([("training", None), ("inference", 0.002)], "stage string, kg double")
    path = str(tmp_path / "ledger")
    assert store.read(spark, path).count() == 0
    store.append(ledger.entries(runs, "stage", "kg"), path)
    first = store.read(spark, path)
    assert sorted((r["stage"], r["emissions_kg"], r["emissions_g"]) for r in first.collect()) == [
        ("inference", 0.002, 2.0), ("training", 0.0, 0.0)]
    store.append(ledger.entries(runs, "stage", "kg"), path)
    total = ledger.totals(store.read(spark, path)).first()
    assert (total["total_kg"], total["total_g"], total["records"]) == (0.004, 4.0, 4)


def test_empty_ledger_totals(spark):
    empty = spark.createDataFrame([], "stage string, emissions_kg double")
    row = ledger.report(empty, "news").first()
    assert (row["project"], row["total_kg"], row["records"]) == ("news", 0.0, 0)


def test_nested_report(spark, tmp_path):
    path = tmp_path / "report.json"
    path.write_text(json.dumps({"project": "p", "total_kg": 0.002, "total_g": 2.0, "records": [
        {"timestamp": "2024-01-01T00:00:01.5", "stage": "training", "emissions_kg": 0.002, "emissions_g": 2.0}]}, indent=2))
    row = store.read_report(spark, str(path)).first()
    assert (row["stage"], row["emissions_g"], row["ts"]) == ("training", 2.0, at(1.5))


def test_running_totals_cross_blocks(spark):
    rng = random.Random(5)
    rows = [(i, at(rng.randint(0, 20_000)), rng.choice("ab"), None if rng.random() < .1 else rng.randint(0, 9) / 1)
            for i in range(400)]
    df = spark.createDataFrame(rows, "n long, ts timestamp, stage string, emissions_kg double")
    for by, unit in (([], None), (["stage"], None), ([], "hour"), (["stage"], "hour")):
        got = {r["n"]: r["total_kg"] for r in ledger.running_totals(df, "n", by, unit).collect()}
        sums, want = {}, {}
        for n, _, stage, kg in sorted(rows, key=lambda r: (r[1], r[0])):
            key = stage if by else None
            sums[key] = sums.get(key, 0) + (kg or 0)
            want[n] = sums[key]
        assert got == want


def test_release_example(spark):
    rows = [(i, "k", at(s)) for i, s in enumerate((0, 0.1, 0.2, 2.0, 2.1, 2.2))]
    df = spark.createDataFrame(rows, "n long, k string, ts timestamp")
    got = ledger.release_times(df, "k", "ts", "n", ledger.SESSION_GAP).orderBy("n").collect()
    assert [(r["release"] - micros(T0)) / 1e6 for r in got] == [0, 0.8, 1.6, 2.4, 3.2, 4.0]


def sequential(rows, gap, last=None):
    last, want = dict(last or {}), {}
    for n, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        here = micros(ts)
        if key in last:
            here = max(here, last[key] + gap)
        want[n] = last[key] = here
    return want, last


def test_releases_equal_the_sequential_rule(spark):
    rng = random.Random(7)
    # one key holds most rows, and queues run over many blocks
    rows = [(i, rng.choice("aaab"), at(rng.random() * 40_000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "n long, k string, ts timestamp")
    want, _ = sequential(rows, 35_000_000)
    for unit in (None, "minute", "hour", "year"):
        got = {r["n"]: r["release"] for r in ledger.release_times(df, "k", "ts", "n", 35, unit).collect()}
        assert got == want
    early = [r for r in rows if r[2] < at(20_000)]
    late = [r for r in rows if r[2] >= at(20_000)]
    _, last = sequential(early, 35_000_000)
    carry = spark.createDataFrame(list(last.items()), "k string, last long")
    part = spark.createDataFrame(late, "n long, k string, ts timestamp")
    got = {r["n"]: r["release"] for r in ledger.release_times(part, "k", "ts", "n", 35, carry=carry).collect()}
    assert got == {n: want[n] for n, _, _ in late}


def test_null_keys_and_times(spark):
    rows = [(1, None, None, 1.0), (2, None, at(5), 2.0), (3, "a", None, 4.0), (4, None, at(4000), 8.0)]
    df = spark.createDataFrame(rows, "n long, stage string, ts timestamp, emissions_kg double")
    for unit in (None, "hour"):
        got = {r["n"]: r["total_kg"] for r in ledger.running_totals(df, "n", ["stage"], unit).collect()}
        assert got == {1: 1.0, 2: 3.0, 3: 4.0, 4: 11.0}


def test_one_moment_holds_most_rows(spark):
    # all requests of the busy key arrive at once: blocks still split them
    df = spark.range(5000).selectExpr("id AS n", "IF(id % 10 = 0, 'b', 'a') AS k",
                                      "timestamp'2024-01-01 00:00:00' AS ts")
    made = ledger.release_times(df, "k", "ts", "n", 1)
    got = sorted(r["release"] for r in made.filter("k = 'a'").collect())
    assert got == [micros(T0) + i * 1_000_000 for i in range(4500)]
