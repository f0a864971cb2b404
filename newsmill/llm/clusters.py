"""Clusters of vectors around centroids, in whole numbers and column expressions.

Vectors become arrays of whole numbers, so that distances, sums and means are exact and do not
depend on the order of rows. A round is one pass: ``zip_with`` and ``aggregate`` give the distance
to every centroid, which are literals of the plan, ``array_min`` of (distance, number) chooses,
and sums per component, combined in the tasks, come back as one row a cluster.
"""

from hashlib import sha256
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.session import stored


def whole_numbers(vector: Column, size: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null for a vector of another size, or one with a
    null or non-finite component.

    Components are held where a squared distance still fits a long: for 64 of them at 2 ** 27.
    """
    most = float(isqrt((1 << 62) // size) // 2)
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    numbers = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(
        F.lit(most), x.cast("double") * F.lit(float(scale))))).cast("int"))
    return F.when((F.size(vector) == size) & fine, numbers)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct of the squared distance and the number of the nearest centroid; ties: the lower."""
    def distance(centroid):
        there = F.expr(f"array({', '.join(f'{c}L' for c in centroid)})")
        apart = F.zip_with(vector, there, lambda a, b: a - b)
        return F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: total + d * d)

    return F.array_min(F.array(*[
        F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster"))
        for k, c in enumerate(centroids)]))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Components of the ``k`` vectors whose hashed ids come first; equal ids by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("mark"), "numbers").orderBy("mark", "numbers").limit(k)
    return [list(r["numbers"]) for r in rows.collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid at the floor of the mean of its vectors; one without any stays."""
    size = len(centroids[0])
    rows = vectors.select("numbers", nearest(F.col("numbers"), centroids)["cluster"].alias("cluster"))
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col("numbers")[i].cast("long")).alias(f"s{i}") for i in range(size)])
    out = list(centroids)
    for row in sums.collect():  # a row for each centroid at most
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _fits(total: int) -> int | None:
    return total if total < 1 << 63 else None


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64,
            seed: int = 1) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each
    vector of ``size`` finite components.

    Vectors of another size, null, or with a null or non-finite component are left out. With fewer
    vectors than ``k`` there are fewer clusters, without any no rows. Null ids are hashed as empty,
    repeated rows count each, other columns don't matter. An inertia beyond a long is null.
    """
    numbers = whole_numbers(F.col("embedding"), size, scale)
    kept = stored(vectors.select("vec_id", numbers.alias("numbers")).filter("numbers is not null"), "vectors")
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids)
    if not centroids:
        centroids = [[0] * size]
    chosen = kept.select("vec_id", nearest(F.col("numbers"), centroids).alias("near"))
    placed = stored(chosen.select("vec_id", "near.cluster", "near.distance"), "placed")
    sums = dict.fromkeys(range(len(centroids)), 0)
    sums |= {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    marks = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = lambda values, kind: F.get(_literal(values, kind), F.col("cluster"))
    return placed.select(
        "vec_id", "cluster", "distance",
        at([_fits(sums[i]) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(_fits(sum(sums.values()))).cast("long").alias("inertia"),
        at(marks, "string").alias("centroid_sha256"))
