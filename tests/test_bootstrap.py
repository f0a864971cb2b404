import math
import random
from hashlib import md5

from newsmill.operators import bootstrap, rouge
from pyspark.sql import functions as F


def number(text):
    return int(md5(text.encode()).hexdigest()[:15], 16)


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def expected(rows, replicates, seed, ends):
    p = (1 << 31) - 1
    limits = bootstrap.steps()
    means = []
    for b in range(replicates):
        a, c = 1 + number(f"{seed}:factor {b}") % (p - 1), number(f"{seed}:shift {b}") % p
        weights = [(sum((number(k) % p * a + c) % p >= s for s in limits), v) for k, v in rows if v is not None]
        if sum(w for w, _ in weights):
            means.append(sum(w * v for w, v in weights) / sum(w for w, _ in weights))
    return [quantile(means, q) for q in ends]


def test_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], rng.random() if i % 7 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "n long, k string, v double").repartition(5)
    got = bootstrap.intervals(df, ["n", "k"], ["v"], replicates=60, seed=4, confidence=0.8).first()
    want = expected([(f"{n}:{k}", v) for n, k, v in rows], 60, 4, (0.1, 0.5, 0.9))
    assert all(abs(a - b) < 1e-9 for a, b in zip((got["low"], got["mid"], got["high"]), want))


def test_seed_and_order(spark):
    rows = [(i, i % 10 / 10) for i in range(200)]
    def run(rows, seed, parts):
        df = spark.createDataFrame(rows, "n long, v double").repartition(parts)
        return [round(x, 9) for x in bootstrap.intervals(df, ["n"], ["v"], 100, seed).select("low", "mid", "high").first()]
    assert run(rows, 1, 2) == run(rows[::-1], 1, 7) != run(rows, 2, 2)


def test_weights_are_poisson(spark):
    factors = bootstrap.factors(50, 0)
    df = spark.range(2000).select(bootstrap.key_hash(["id"]).alias("h"), F.explode(F.array(*map(F.lit, factors))).alias("f"))
    counts = {r["w"]: r["count"] / 100_000 for r in df.select(
        bootstrap.weight(F.col("h"), F.col("f")).alias("w")).groupBy("w").count().collect()}
    for w in range(4):
        assert abs(counts[w] - math.exp(-1) / math.factorial(w)) < 0.01


def test_covers_the_normal_interval(spark):
    rng = random.Random(8)
    values = [rng.gauss(0.5, 0.2) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "n long, v double")
    row = bootstrap.intervals(df, ["n"], ["v"], 800).first()
    mean, half = sum(values) / 400, 1.96 * 0.2 / 20
    assert abs(row["mid"] - mean) < 0.2 * half
    assert abs((row["high"] - row["low"]) / (2 * half) - 1) < 0.2


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "n long, v double, w double")
    assert [tuple(r) for r in bootstrap.intervals(empty, ["n"], ["v", "w"], 20).collect()] == [
        ("v", None, None, None), ("w", None, None, None)]
    same = spark.createDataFrame([(None, 0.5, None)] * 9, "n long, v double, w double")
    assert [tuple(r) for r in bootstrap.intervals(same, ["n"], ["v", "w"], 50).collect()] == [
        ("v", 0.5, 0.5, 0.5), ("w", None, None, None)]


def test_scores_of_pairs(spark):
    rows = [(i, "the cats were running" if i % 3 else None, "a cat runs " + "on " * (i % 4)) for i in range(40)]
    pairs = spark.createDataFrame(rows, "id long, prediction string, reference string")
    found = {r["metric"]: r for r in rouge.interval_scores(pairs, ["id"], replicates=200).collect()}
    means = rouge.corpus_scores(pairs, ["id"]).first()
    for m in rouge.METRICS:
        assert found[m]["low"] <= found[m]["mid"] <= found[m]["high"]
        assert found[m]["low"] <= means[m] <= found[m]["high"]
