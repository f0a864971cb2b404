import datetime as dt
import os
import random
from unittest.mock import Mock

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.operators import clean, ledger, pages
from newsmill.streaming import keyed, streams

T0 = dt.datetime(2024, 1, 1)


def arrive(part, path, at, files=2):
    """Add the rows as files that arrived at second ``at``."""
    old = set(os.listdir(path)) if os.path.isdir(path) else set()
    part.coalesce(files).write.mode("append").parquet(path)
    for name in set(os.listdir(path)) - old:
        os.utime(os.path.join(path, name), (1e6 + at, 1e6 + at))


SCHEMA = "n long, id string, article string, highlights string"


def articles(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice((None, *map(str, range(60)))), rng.choice("abcdefgh") * rng.choice((40, 60, 70)) + rng.choice(("", "😀")),
             rng.choice(("h", "hi", "", None))) for i in range(n)]


def test_cleaning_goes_on_after_a_restart(spark, tmp_path):
    rows = articles(240, 2)
    path, home = str(tmp_path / "in"), str(tmp_path)
    parts = [spark.createDataFrame(rows[i:i + 60], SCHEMA) for i in range(0, 240, 60)]

    def run():
        streams.run_available(
            streams.clean_files(spark, path, parts[0].schema, "n", f"{home}/out", 2), f"{home}/check")

    for at in (0, 1):
        arrive(parts[at], path, at)
    run()
    for at in (2, 3):
        arrive(parts[at], path, at)
    run()
    out = spark.read.parquet(f"{home}/out")
    assert out.select("batch").distinct().count() > 2
    want = clean.clean_articles(spark.createDataFrame(rows, SCHEMA), "n")
    assert sorted(out.drop("batch").collect()) == sorted(want.collect())


def test_a_batch_touches_its_own_keys(spark, tmp_path):
    path, home = str(tmp_path / "in"), str(tmp_path)
    old = spark.range(3000).selectExpr("id as n", "cast(id as string) as id", "repeat('x', 60) || id as article", "'h' as highlights")
    new = spark.createDataFrame([(5000, "7", "y" * 60, "h"), (5001, "new", "x" * 60 + "9", "h"), (5002, "b", "z" * 60, "h")], SCHEMA)
    arrive(old, path, 0)
    arrive(new, path, 1)
    keyed.with_keyed_state(spark)
    query = streams.clean_files(spark, path, old.schema, "n", f"{home}/out", 2).option(
        "checkpointLocation", f"{home}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    updated = [[s["numRowsUpdated"] for s in p["stateOperators"]] for p in query.recentProgress
               if p["numInputRows"]]
    assert sorted(updated[0]) == [3000, 3000] and sum(updated[-1]) <= 4
    # 7 is an old id, 5001 has an old text
    assert {r["n"] for r in spark.read.parquet(f"{home}/out/batch={len(updated) - 1}").collect()} == {5002}


def test_no_survivors_and_no_articles(spark, tmp_path):
    path, home = str(tmp_path / "in"), str(tmp_path)
    df = spark.createDataFrame([(1, "a", None, "h"), (2, "b", "", ""), (3, "c", "short", "h")], SCHEMA)
    arrive(df, path, 0)
    streams.run_available(streams.clean_files(spark, path, df.schema, "n", f"{home}/out"), f"{home}/check")
    out = spark.read.parquet(f"{home}/out")
    assert out.count() == 0 and set(out.columns) >= {"n", "id", "article", "highlights"}


def released(spark, tmp_path, rows, order, delay, **options):
    schema = "n long, k string, ts timestamp"
    path, home = str(tmp_path / "in"), str(tmp_path)
    rows = rows + [(None, "closing", T0 + dt.timedelta(days=90))]
    order = order + [len(rows) - 1]
    for at in range(4):
        mine = [rows[i] for i in order[at * len(order) // 4:(at + 1) * len(order) // 4]]
        arrive(spark.createDataFrame(mine, schema), path, at)
    stream = streams.read_files(spark, path, spark.createDataFrame([], schema).schema, 2)
    writer = streams.pace_arrivals(stream, "k", "ts", "n", 80, delay, f"{home}/out", f"{home}/state", **options)
    streams.run_available(writer, f"{home}/check")
    return {r["n"]: r["release"] for r in spark.read.parquet(f"{home}/out").collect() if r["n"] is not None}


@pytest.mark.parametrize("span", [60, 3600])
def test_requests_out_of_order_are_paced_as_in_order(spark, tmp_path, span):
    rng = random.Random(4)
    times = [dt.timedelta(seconds=round(rng.random() * 20_000, 3)) for _ in range(300)]
    times[10] = times[11] = times[12]  # equal times
    rows = [(i, rng.choice("aab"), T0 + t) for i, t in enumerate(times)]
    late = [t.total_seconds() + rng.random() * 3500 for t in times]
    order = sorted(range(300), key=late.__getitem__)
    got = released(spark, tmp_path, rows, order, "1 hour", span_seconds=span, spread=3)
    batch = ledger.release_times(spark.createDataFrame(rows, "n long, k string, ts timestamp"), "k", "ts", "n", 80)
    assert got == {r["n"]: r["release"] for r in batch.collect()}


def test_requests_beyond_the_delay_are_dropped(spark, tmp_path):
    rows = [(i, "a", T0 + dt.timedelta(hours=i)) for i in range(20)]
    order = [*range(1, 20), 0]  # the first comes last, far behind
    got = released(spark, tmp_path, rows, order, "2 hours")
    assert set(got) == set(range(1, 20))


BODY = "A sentence that is long enough to be kept here. " * 10
GOOD = f"<h1>A title that is long enough to stay in place</h1><article>{BODY}</article>"
BAD = "<p>none</p>"
METHODS = pages.METHODS
ATTEMPTS = "url string, method string, html string, error string, ts timestamp"


def chosen(spark, tmp_path, batches, wait=600):
    """What is given out after each batch, given as (url, method, html, minute)."""
    path, home = str(tmp_path / "in"), str(tmp_path)
    frames = [spark.createDataFrame([
        (u, m, h, None if h else "failed", T0 + dt.timedelta(minutes=t)) for u, m, h, t in b], ATTEMPTS) for b in batches]
    for at, frame in enumerate(frames):
        arrive(frame, path, at, 1)
    keyed.with_keyed_state(spark)
    stream = streams.read_files(spark, path, frames[0].schema, 1)
    seen = []

    def keep(df, number):
        seen.append([tuple(r) for r in df.select("link", "status", "method", "detail").collect()])

    streams.run_available(keyed.cascade_arrivals(stream, "ts", wait, "1 minute").writeStream.foreachBatch(keep),
                          f"{home}/check")
    every = frames[0]
    for frame in frames[1:]:
        every = every.union(frame)
    want = pages.cascade(every.drop("ts")).select("link", "status", "method", "detail").collect()
    return seen, sorted(map(tuple, want), key=repr)


def test_the_best_method_wins_whenever_it_comes(spark, tmp_path):
    first, second, third = METHODS
    batches = [
        [("last", third, GOOD, 0), ("first", first, GOOD, 0), ("none", first, BAD, 0), ("skip", first, None, 0)],
        [("last", second, BAD, 1), ("none", second, None, 1), ("skip", third, GOOD, 1)],
        [("last", first, GOOD, 2), ("none", third, BAD, 2), ("skip", second, BAD, 2), ("first", second, GOOD, 2)],
        [("closing", first, None, 60)]]
    seen, want = chosen(spark, tmp_path, batches)
    got = sorted((r for batch in seen for r in batch), key=repr)
    assert [r for r in got if r[0] != "closing"] == [r for r in want if r[0] != "closing"]
    given = [batch for batch in seen if batch]  # batches without rows move the watermark on
    assert given[0] == [("first", "ok", first, None)]
    assert {r[0] for r in given[1]} == {"last", "none", "skip"}


def test_an_open_choice_ends_with_its_wait(spark, tmp_path):
    first, second, third = METHODS
    batches = [
        [("a", third, GOOD, 0), ("b", second, BAD, 0), ("c", "OTHER", GOOD, 0)],
        [("late", first, GOOD, 30)],
        [("closing", first, None, 60)]]
    seen, want = chosen(spark, tmp_path, batches)
    got = sorted((r for batch in seen for r in batch), key=repr)
    assert [r for r in got if r[0] != "closing"] == [r for r in want if r[0] != "closing"]
    assert not seen[0]


def test_held_rows_are_few_values_of_the_state():
    """Rows of a group that come together go to the store together, and come back as they were."""
    class Store(list):
        exists, appendValue, get = list.__len__, list.append, list.__iter__

    handle, store, timers = Mock(), Store(), []
    handle.getListState.return_value = store
    handle.registerTimer.side_effect = timers.append
    names = T.StructType.fromDDL("event_id long, ts timestamp, kind string")
    rows = [Row(event_id=None if i % 5 == 0 else 2 ** 60 + i, ts=T0 + dt.timedelta(microseconds=i),
                kind=None if i % 3 else "é") for i in range(25_000)]
    hold = keyed._Hold(names)
    hold.init(handle)
    for part in (rows[:24_000], rows[24_000:]):
        assert list(hold.handleInputRows((3_600_000, 1), iter(part), None)) == []
    assert len(store) == 4 and timers == [3_600_000]
    assert [tuple(r) for r in hold.handleExpiredTimer((3_600_000, 1), None, None)] == [tuple(r) for r in rows]
    assert not store


def test_rows_of_a_group_are_one_row_on_their_way_to_the_state(spark):
    """Every row comes back as it was, from few packs; a group's rows are never in another's pack."""
    rows = [(None if i % 7 == 0 else i, "é" * (i % 3) or None, T0 + dt.timedelta(microseconds=i), i % 4 * 1000, i % 3)
            for i in range(20_000)]
    table = spark.createDataFrame(rows, "n long, k string, ts timestamp, _span long, _spread int").toArrow()
    packs = list(keyed._packs(iter(table.to_batches(max_chunksize=1000))))
    assert sum(p.num_rows for p in packs) == 12
    whole = []
    for pack in packs:
        for i in range(pack.num_rows):
            back = list(keyed._unpacked(iter([pack.slice(i, 1).select(["rows"])])))
            span, spread = pack["_span"][i].as_py(), pack["_spread"][i].as_py()
            whole += [(*r.values(), span, spread) for b in back for r in b.to_pylist()]
    assert sorted(map(str, whole)) == sorted(str(tuple(r.values())) for r in table.to_pylist())
    assert list(keyed._packs(iter([]))) == [] and list(keyed._unpacked(iter([]))) == []
    assert max(b.num_rows for b in keyed._packs(iter(table.to_batches()))) == 12


def test_a_busy_group_is_cut_into_packs(spark, monkeypatch):
    monkeypatch.setattr(keyed, "PACK", 100)
    table = spark.range(950).selectExpr("id as n", "1000L as _span", "0 as _spread").toArrow()
    packs = list(keyed._packs(iter(table.to_batches())))
    assert sum(p.num_rows for p in packs) == 10
    back = [r for p in packs for b in keyed._unpacked(iter([p.select(["rows"])])) for r in b.column(0).to_pylist()]
    assert sorted(back) == list(range(950))


def test_few_rows_pass_through_the_state(spark, tmp_path):
    """The state takes what a task has of a span and a group as one row; rows without a time are dropped."""
    rows = [(i, "ab"[i % 2], T0 + dt.timedelta(milliseconds=i)) for i in range(3000)] + [(9000, "a", None)]
    path, home = str(tmp_path / "in"), str(tmp_path)
    schema = "n long, k string, ts timestamp"
    arrive(spark.createDataFrame(rows, schema), path, 0, 1)
    arrive(spark.createDataFrame([(None, "closing", T0 + dt.timedelta(days=9))], schema), path, 1, 1)
    keyed.with_keyed_state(spark)
    stream = streams.read_files(spark, path, spark.createDataFrame([], schema).schema, 1)
    seen = []
    query = keyed.in_time_order(stream, "ts", "1 hour", spread=4).writeStream.foreachBatch(
        lambda df, number: seen.append([r["n"] for r in df.collect()])).option(
        "checkpointLocation", f"{home}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(n for batch in seen for n in batch if n is not None) == list(range(3000))
    first = next(p for p in query.recentProgress if p["numInputRows"] == 3001)
    assert first["stateOperators"][0]["numRowsUpdated"] <= 4
