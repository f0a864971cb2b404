import random

from newsmill.operators import expect, expect_state
from pyspark.sql import functions as F

SCHEMA = "id string, article string, highlights string, split string"


def articles(n, seed):
    rng = random.Random(seed)
    return [(rng.choice((None, *map(str, range(n)))), rng.choice(("a", "b", None)) and "x" * rng.choice((10, 50, 90)),
             rng.choice((None, "h" * 5, "h" * 20, "h" * 95)), rng.choice(("train", "val", None))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_parts_add_up_to_the_whole(spark, tmp_path):
    raw, clean = articles(90, 1), articles(40, 2)
    make = lambda found: spark.createDataFrame(found, SCHEMA).repartition(3)
    for part in range(3):
        expect_state.append({"raw": make(raw[part::3]), "clean": make(clean[part::3])}, str(tmp_path), f"p{part}", by="split")
    want = expect.evaluate({"raw": make(raw), "clean": make(clean)}, by="split")
    assert rows(expect_state.results(spark, str(tmp_path))) == rows(want)


def test_a_part_replaces_itself_and_may_be_empty(spark, tmp_path):
    make = lambda found: spark.createDataFrame(found, SCHEMA)
    found = articles(30, 3)
    for part in (found[:20], found[:10]):
        expect_state.append({"raw": make(part), "other": make([])}, str(tmp_path), "first")
    expect_state.append({"raw": make(found[10:]), "other": make([])}, str(tmp_path), "second")
    want = expect.evaluate({"raw": make(found), "other": make([])})
    assert rows(expect_state.results(spark, str(tmp_path))) == rows(want)


def test_a_part_without_a_column_fails_its_checks(spark, tmp_path):
    whole = spark.createDataFrame([("1", "x" * 60, "h" * 20)], "id string, article string, highlights string")
    number = spark.createDataFrame([(2, "y" * 60)], "id long, article string")
    expect_state.append({"raw": whole}, str(tmp_path), "a")
    expect_state.append({"raw": number}, str(tmp_path), "b")
    got = {(r["expectation"], r["column"]): r["success"] for r in expect_state.results(spark, str(tmp_path)).collect()}
    assert not got["column_exists", "highlights"] and not got["type_is_string", "id"] and got["unique", "id"]
    assert got["column_exists", "article"] and got["type_is_string", "article"]


def test_other_suites(spark, tmp_path):
    suite = (expect.Check(expect.NOT_NULL, ("v",), mostly=0.5),)
    for part, found in (("a", [(1,), (None,)]), ("b", [(None,), (2,)])):
        expect_state.append({"t": spark.createDataFrame(found, "v int")}, str(tmp_path), part, suite)
    (row,) = expect_state.results(spark, str(tmp_path), suite).collect()
    assert row["unexpected_count"] == 2 and row["element_count"] == 4 and row["success"]
