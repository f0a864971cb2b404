import random
from collections import Counter

import pytest

from newsmill.functions import lcs
from newsmill.functions.stem import stem
from newsmill.operators import rouge

SCHEMA = "id long, prediction string, reference string"


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([
        (1, "the cat sat on the mat", "the cat on a mat"), (2, "", "the cat"), (3, None, "x y"),
        (4, "Running dogs!", "run dog")], SCHEMA)


def scores(df, name):
    return {r["id"]: tuple(round(r[f"{name}_{k}"], 4) for k in "prf") for r in df.collect()}


def test_rouge_1_2_l(pairs):
    one, two = scores(rouge.rouge_n(pairs, ["id"], 1), "rouge1"), scores(rouge.rouge_n(pairs, ["id"], 2), "rouge2")
    longest = scores(rouge.rouge_l(pairs, ["id"]), "rougeL")
    assert one[1] == (0.6667, 0.8, 0.7273) and two[1] == (0.2, 0.25, 0.2222)
    assert longest[1] == (0.6667, 0.8, 0.7273)
    for metric in (one, two, longest, scores(rouge.rouge_lsum(pairs, ["id"]), "rougeLsum")):
        assert metric[2] == metric[3] == (0, 0, 0) and len(metric) == 4


def test_stemming(pairs):
    assert scores(rouge.rouge_n(pairs, ["id"], 1), "rouge1")[4] == (0, 0, 0)
    # "run" is too short to be stemmed and "running" stems to it; "dogs" stems to "dog"
    assert scores(rouge.rouge_n(pairs, ["id"], 1, stemmed=True), "rouge1")[4] == (1, 1, 1)
    assert scores(rouge.rouge_lsum(pairs, ["id"], stemmed=True), "rougeLsum")[4] == (1, 1, 1)


def test_means(pairs):
    row = rouge.corpus_scores(pairs, ["id"], stemmed=False).first()
    # of four pairs one has no prediction, and counts as missing instead of zero
    assert row["rouge1"] == row["rougeL"] == row["rougeLsum"] == round(100 * (8 / 11) / 3, 4)
    assert (row["pairs"], row["missing"]) == (4, 1)
    plan = rouge.corpus_scores(pairs, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") == 1


def test_all_metrics_at_once_equal_each_alone(pairs):
    whole = pairs.filter("prediction is not null")
    for stemmed in (False, True):
        row = rouge.corpus_scores(whole, ["id"], stemmed).first()
        alone = rouge.mean_scores({
            "rouge1": rouge.rouge_n(whole, ["id"], 1, stemmed),
            "rouge2": rouge.rouge_n(whole, ["id"], 2, stemmed),
            "rougeL": rouge.rouge_l(whole, ["id"], stemmed),
            "rougeLsum": rouge.rouge_lsum(whole, ["id"], stemmed)}).first()
        assert {k: row[k] for k in alone.asDict()} == alone.asDict()


def test_pairing_reports_missing(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, reference string")
    preds = spark.createDataFrame([(1, "a")], "id long, prediction string")
    got = {r["id"]: r["status"] for r in rouge.pair_up(preds, refs, "id").collect()}
    assert got == {1: "ok", 2: "missing"}


def test_no_shuffle_of_ngrams(pairs):
    for stemmed in (False, True):
        made = rouge.rouge_n(pairs, ["id"], 2, stemmed)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_ngrams_are_counted_in_their_row(spark):
    """No hash table over the n-grams of a whole task, and the counts of plain Counters."""
    rng = random.Random(5)
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 30)))
    rows = [(i, text(), text()) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 2, 3):
        made = rouge.rouge_n(table, ["id"], n)
        assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r for r in made.collect()}
        assert len(got) == len(rows)
        for i, *sides in rows:
            ts = [(x or "").split() for x in sides]
            p, r = [Counter(tuple(t[k:k + n]) for k in range(len(t) - n + 1)) for t in ts]
            hits = (p & r).total()
            assert got[i][f"rouge{n}_p"] == (hits / p.total() if p else 0)
            assert got[i][f"rouge{n}_r"] == (hits / r.total() if r else 0)


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def walk(a, b):
    t, i, j, found = table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def test_lcs_against_full_table():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert lcs.length(a, b) == table(a, b)[-1][-1]
        assert lcs.positions(a, b) == walk(a, b)


def test_union_hits():
    # two predicted lines cover different parts of one reference line
    ref = ["w1 w2 w3 w4 w5".split()]
    pred = ["w1 w2 w6 w7 w8".split(), "w1 w3 w8 w9 w5".split()]
    assert lcs.union_hits(ref, pred) == 4


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("bled", "bled"),
    ("conflated", "conflat"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"),
    ("happy", "happi"), ("relational", "relat"), ("conformabli", "conform"), ("generalization", "gener"),
    ("electrical", "electr"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"),
    ("dying", "die"), ("spied", "spi"), ("geology", "geolog"), ("news", "news"), ("enjoy", "enjoy")])
def test_stems(word, want):
    assert stem(word) == want


def test_stem_join_by_broadcast_and_by_salt(spark):
    rows = spark.createDataFrame([(i, "running" if i % 3 else "dogs") for i in range(300)], "n long, token string")
    texts = spark.createDataFrame([("running dogs",)], "t string")
    for limit in (1 << 20, 0):
        got = rouge.attach_stems(rows, rouge.vocabulary(texts, "t"), limit, salts=4)
        assert {(r["token"], r["stem"], r["count"]) for r in got.groupBy("token", "stem").count().collect()} == {
            ("running", "run", 200), ("dogs", "dog", 100)}


def test_only_frequent_tokens_are_salted(spark):
    words = ["running"] * 200 + ["dogs"] * 100 + [f"w{i}" for i in range(50)] + [None]
    rows = spark.createDataFrame(list(enumerate(words)), "n long, token string").repartition(5)
    texts = spark.createDataFrame([("running dogs " + " ".join(f"w{i}" for i in range(50)),)], "t string")
    stems = rouge.vocabulary(texts, "t")
    salted, copies = rouge._salted(rows, stems, 64, 150)
    assert copies.count() == 51 + 64 and salted.count() == len(words)
    assert salted.filter("token = 'running'").select("_salt").distinct().count() > 16
    for often in (0, 150, 1000):
        got = rouge.attach_stems(rows, stems, 0, often=often)
        assert got.columns == ["token", "n", "stem"]
        assert sorted((r.n, r.token, r.stem) for r in got.collect()) == [
            (n, t, t and {"running": "run", "dogs": "dog"}.get(t, t)) for n, t in enumerate(words)]
