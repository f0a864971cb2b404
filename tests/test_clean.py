import pytest
from pyspark.sql import functions as F

from newsmill.operators import clean

L, L2, L3, L4, L5 = "L" * 60, "P" * 60, "Q" * 60, "R" * 60, "S" * 60
M, N = "M" * 51, "N" * 50
ROWS = [
    ("a", L + "😀", "hi"), ("b", "😀☀", "hi"), ("c", None, "hi"), ("d", L2, ""), ("e", M, "hi"),
    ("f", N, "hi"), ("g", L3, L3), ("a", L4, "x"), ("h", L, "hi"), ("i", "日本" + M, "hi"),
    ("j", L5 + "🤖", "hi"), ("k", " ", "hi"), (None, "T" * 60, "hi"), (None, "U" * 60, "hi"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)],
                                 "n long, id string, article string, highlights string")


def fetched(df, order_by):
    """Stages with more dropped rows than may be broadcast."""
    return clean.clean_articles_stored(df, order_by, max_broadcast_bytes=1)


def in_buckets(df, order_by):
    return clean.clean_articles_bucketed(clean.bucketed(df, order_by, 3, "rows"), order_by, 3)


@pytest.mark.parametrize("cleaner", [
    clean.clean_articles, clean.clean_articles_wide, clean.clean_articles_stored, fetched, in_buckets])
def test_cleaner_keeps_the_expected_rows(rows, cleaner):
    kept = {r["n"]: r["article"] for r in cleaner(rows, "n").collect()}
    assert kept == {0: L, 4: M, 10: L5 + "🤖", 12: "T" * 60}


def test_cleaner_is_idempotent(rows):
    once = clean.clean_articles(rows, "n")
    assert sorted(once.collect()) == sorted(clean.clean_articles(once, "n").collect())


def test_dedup_stays_within_splits(spark):
    rows = spark.createDataFrame(
        [(0, "a", L, "hi", "train"), (1, "a", L, "hi", "val"), (2, "b", L, "hi", "val")],
        "n long, id string, article string, highlights string, split string")
    kept = clean.clean_articles(rows, "n", ["split"]).select("n").collect()
    assert sorted(r["n"] for r in kept) == [0, 1]


def test_single_steps(rows):
    assert {r["n"] for r in clean.drop_missing(rows).collect()} == set(range(len(ROWS))) - {2, 3}
    assert {r["n"] for r in clean.drop_short(rows).collect()}.isdisjoint({1, 2, 5, 11})
    assert 6 not in {r["n"] for r in clean.drop_long_highlights(rows).collect()}
    emoji = {r["n"]: r["article"] for r in clean.remove_emoji(rows).collect()}
    assert emoji[0] == L and emoji[1] == "" and emoji[2] is None and emoji[9] == M


def test_fingerprint_tells_nulls_and_boundaries_apart(spark):
    pairs = [("ab", "c"), ("a", "bc"), (None, "abc"), ("abc", None), ("", "abc"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    marks = df.select(*clean.fingerprint("a", "b")).collect()
    assert len({(m["fp_lo"], m["fp_hi"]) for m in marks}) == len(pairs)


def test_a_third_of_all_rows_on_one_key(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("x" * 60), (F.col("id") / 2).cast("long").cast("string")).alias("article"),
        F.lit("h").alias("highlights"))
    kept = clean.clean_articles(rows, "n")
    ids = [r["n"] for r in kept.select("n").collect()]
    winners = [0] + [n for n in range(30_000) if n % 3]
    seen, want = set(), []
    for n in winners:
        if n // 2 not in seen:
            seen.add(n // 2)
            want.append(n)
    assert sorted(ids) == want


def test_other_emoji_class(spark):
    df = spark.createDataFrame([(1, "1", "日" * 60 + "\U0001F600", "日本")],
                               "n long, id string, article string, highlights string")
    assert clean.clean_articles(df, "n").collect() == []
    for cleaner in (clean.clean_articles, clean.clean_articles_stored):
        kept = cleaner(df, "n", emoji="page").first()
        assert (kept["article"], kept["highlights"]) == ("日" * 60, "日本")


def test_texts_in_buckets_are_not_moved(spark, rows):
    table = clean.bucketed(rows, "n", 3, "rows")
    made = clean.clean_articles_bucketed(table, "n", 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(made.collect()) == sorted(clean.clean_articles(rows, "n").collect())
