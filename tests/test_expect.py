import pytest

from newsmill.operators import clean, expect

ROWS = [("1", "a" * 60, "h" * 12), ("1", "b" * 49, "h" * 12), ("2", None, "h" * 12),
        ("3", "c" * 50, "h" * 9), ("4", "d" * 20, "h" * 30), (None, "e" * 60, None)]
SCHEMA = "id string, article string, highlights string"


def outcome(results):
    return {(r["expectation"], r["column"]): (r["unexpected_count"], r["success"])
            for r in results.collect()}


def test_article_suite(spark):
    results = expect.evaluate({"raw_train": spark.createDataFrame(ROWS, SCHEMA)})
    got = outcome(results)
    assert len(got) == 14
    want = {
        ("unique", "id"): (2, False), ("not_null", "id"): (1, False),
        ("not_null", "article"): (1, False), ("min_length", "article"): (2, False),
        ("not_null", "highlights"): (1, False), ("min_length", "highlights"): (1, False),
        ("compound_unique", "article,highlights"): (0, True),
        ("shorter_than", "highlights,article"): (3, False),
    }
    for kind in ("column_exists", "type_is_string"):
        for column in ("id", "article", "highlights"):
            want[(kind, column)] = (0, True)
    assert got == want
    tally = expect.tally(results).first()
    assert (tally["evaluated"], tally["unsuccessful"]) == (14, 7)


def test_many_datasets_and_first_only(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    sets = {"raw_train": rows, "raw_val": rows.limit(1), "clean_train": rows.filter("id = '3'")}
    results = expect.evaluate(sets)
    assert {r["dataset"]: r["unsuccessful"] for r in expect.tally(results).collect()} == {
        "raw_train": 7, "raw_val": 0, "clean_train": 1}
    assert expect.tally(results, "raw_val").count() == 1


def test_missing_column_and_wrong_type_fail(spark):
    lacking = spark.createDataFrame([("1", "a" * 60)], "id string, article string")
    numbered = spark.createDataFrame([(1, "a" * 60, "h" * 12)], "id long, article string, highlights string")
    got = outcome(expect.evaluate({"lacking": lacking}))
    assert not got[("column_exists", "highlights")][1]
    assert not got[("min_length", "highlights")][1]
    assert got[("column_exists", "id")][1]
    got = outcome(expect.evaluate({"numbered": numbered}))
    assert not got[("type_is_string", "id")][1] and got[("unique", "id")][1]


def test_compound_keys_with_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None), (None, None), ("b", "c")],
                               "article string, highlights string")
    suite = (expect.Check(expect.COMPOUND_UNIQUE, ("article", "highlights")),)
    row = expect.evaluate({"x": df}, suite).first()
    assert (row["element_count"], row["missing_count"], row["unexpected_count"]) == (5, 2, 2)


def test_mostly_and_user_defined_condition(spark):
    @expect.pair_condition("same_first_letter")
    def same(a, b):
        return a.substr(1, 1) == b.substr(1, 1)

    df = spark.createDataFrame([("ab", "ac"), ("ab", "ad"), ("ab", "x")], "p string, q string")
    lenient = expect.Check(expect.PAIR, ("p", "q"), mostly=0.6, condition="same_first_letter")
    strict = expect.Check(expect.PAIR, ("p", "q"), condition="same_first_letter")
    rows = expect.evaluate({"x": df}, (lenient, strict)).orderBy("check_no").collect()
    assert [r["success"] for r in rows] == [True, False]


def test_cleaned_data_passes_what_the_cleaner_ensures(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "n long, " + SCHEMA)
    kept = clean.clean_articles(rows, "n")
    got = outcome(expect.evaluate({"clean": kept}))
    for check in (("unique", "id"), ("not_null", "article"), ("compound_unique", "article,highlights"),
                  ("shorter_than", "highlights,article")):
        assert got[check][1]


def test_unexpected_rows(spark):
    df = spark.createDataFrame([(i, r[0], r[1], r[2]) for i, r in enumerate(ROWS)], "n long, " + SCHEMA)
    unique = expect.Check(expect.UNIQUE, ("id",))
    assert {r["n"] for r in expect.unexpected_rows(df, unique, "n").collect()} == {0, 1}
    short = expect.Check(expect.MIN_LENGTH, ("article",), min_value=50)
    assert [r["n"] for r in expect.unexpected_sample(df, short, "n", 1).collect()] == [1]


def test_dataset_without_rows(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    results = expect.evaluate({"full": rows, "empty": rows.limit(0)})
    tallies = {r["dataset"]: (r["evaluated"], r["unsuccessful"]) for r in expect.tally(results).collect()}
    assert tallies == {"full": (14, 7), "empty": (14, 0)}


def test_data_sets_without_rows_and_without_a_name(spark):
    kind = "id string, article string, highlights string, split string"
    row = ("1", "a" * 60, "b" * 20)
    raw = spark.createDataFrame([(*row, "x"), (*row, None)], kind)
    clean = spark.createDataFrame([(*row, "y")], kind)
    found = expect.evaluate({"raw": raw, "clean": clean}, by="split").collect()
    sizes = {(r["dataset"], r["element_count"]) for r in found}
    assert sizes == {("raw_x", 1), ("raw_y", 0), ("raw_null", 1),
                     ("clean_x", 0), ("clean_y", 1), ("clean_null", 0)}
    assert len(found) == 6 * len(expect.ARTICLE_SUITE)


@pytest.mark.parametrize("mostly, good", [(0.1, True), (0.11, False), (0.07, True)])
def test_a_share_met_exactly_is_met(spark, mostly, good):
    df = spark.createDataFrame([(f"{i}", "long enough" if i == 0 else "s") for i in range(10)],
                               "id string, article string")
    check = expect.Check(expect.MIN_LENGTH, ("article",), min_value=5, mostly=mostly)
    assert expect.evaluate({"d": df}, (check,)).first()["success"] is good
