import random
from hashlib import sha256
from math import floor, isfinite

from newsmill.llm.clusters import cluster, nearest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, numbers string"


def table(spark, found):
    return spark.createDataFrame([(i, v, 0, "c", "d", "n") for i, v in found], SCHEMA).repartition(3)


def expected(found, k=16, rounds=3, size=64, scale=64, seed=1):
    kept = [(i, [floor(scale * x) for x in v]) for i, v in found
            if v is not None and len(v) == size and all(x is not None and isfinite(x) for x in v)]
    mark = lambda i: sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
                for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    inertia = sum(d for d, _ in near)
    return sorted(
        ((i, c, d, sum(x for x, y in near if y == c), inertia,
          sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
         for (i, _), (d, c) in zip(kept, near)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, size=64, seed=3):
    rng = random.Random(seed)  # sixteenths are exact as floats
    return [(i, [rng.randrange(-40, 40) / 16 for _ in range(size)]) for i in range(n)]


def test_like_brute_force(spark):
    found = vectors(300)
    assert got(cluster(table(spark, found))) == expected(found)


def test_odd_vectors_are_left_out(spark):
    good = vectors(40)
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63),
           (105, [float("nan")] + [1.0] * 63), (106, [float("-inf")] + [1.0] * 63)]
    found = good + bad + [(None, [0.5] * 64), (None, [0.25] * 64)]
    assert got(cluster(table(spark, found))) == expected(found)


def test_ties_and_repeated_rows(spark):
    found = [(i % 5, [float(i % 2)] * 64) for i in range(60)]  # many equal distances, empty clusters
    assert got(cluster(table(spark, found))) == expected(found)


def test_few_and_no_vectors(spark):
    found = vectors(3)
    assert got(cluster(table(spark, found))) == expected(found)
    empty = cluster(table(spark, []))
    assert empty.collect() == [] and dict(empty.dtypes)["cluster"] == "int"


def test_other_sizes(spark):
    found = vectors(80, size=6)
    assert got(cluster(table(spark, found), k=4, rounds=2, size=6, scale=10, seed=9)) == expected(
        found, 4, 2, 6, 10, 9)


def test_huge_components_are_held(spark):
    found = vectors(20) + [(900, [3e38] * 64), (901, [-3e38] * 64)]
    made = {r["vec_id"]: r for r in cluster(table(spark, found)).collect()}
    assert len(made) == 22 and all(r["distance"] >= 0 for r in made.values())


def test_lower_number_wins(spark):
    df = spark.createDataFrame([([1, 1],)], "v array<int>")
    assert tuple(df.select(nearest(F.col("v"), [[5, 5], [0, 1], [1, 0]]).alias("n")).first()["n"]) == (1, 1)


def test_no_python_worker(spark):
    plan = cluster(table(spark, vectors(20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
