from pyspark.sql import functions as F

from newsmill.operators import clean, expect
from newsmill.sources import corpus, results


def test_first_rows_follow_files(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") < 70, "a").otherwise("b").alias("split"))
    path = str(tmp_path / "many")
    rows.repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    table = spark.read.parquet(path)
    for n in (0, 1, 20, 99, 500):
        assert sorted(r["id"] for r in corpus.first_rows(table, n).collect()) == list(range(min(n, 100)))
    got = {r["split"]: r["count"] for r in corpus.first_rows(table, 40, "split").groupBy("split").count().collect()}
    assert got == {"a": 40, "b": 30}
    firsts = corpus.first_rows(table, 1, "split").collect()
    assert sorted(r["id"] for r in firsts) == [0, 70]


def test_first_rows_open_few_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias(
        "split")).repartitionByRange(40, "id").sortWithinPartitions("id").write.parquet(path)
    table = spark.read.parquet(path)
    assert len(corpus._walk(table, corpus._Enough(15, None, None))) <= 3
    assert len({f["file"] for f in corpus._walk(table, corpus._Enough(9, "split", ("a", "b")))}) <= 7
    got = corpus.first_rows(table, 9, "split", ("a", "b")).collect()
    assert sorted(r["id"] for r in got) == list(range(18))


def test_splits_round_trip(spark, tmp_path):
    rows = [("1", "a", "h", "train"), ("2", "b", "h", "train"), ("3", "c", "h", "val")]
    df = spark.createDataFrame(rows, "id string, article string, highlights string, split string")
    path = str(tmp_path / "splits")
    corpus.write_splits(df, path)
    corpus.write_splits(df, path)
    back = corpus.load_splits(spark, {n: f"{path}/split={n}" for n in ("train", "val")})
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_assets_and_results(spark, tmp_path):
    raw = spark.createDataFrame([(1, "1", "x" * 60, "h" * 12)], "n long, id string, article string, highlights string")
    assets = corpus.register_assets({"raw_train": raw, "clean_train": clean.clean_articles(raw, "n")})
    assert spark.sql("SELECT count(*) FROM clean_train").first()[0] == 1
    path = str(tmp_path / "results")
    for run in ("r1", "r2", "r2"):
        results.save(expect.evaluate(assets), path, run)
    saved = results.load(spark, path)
    assert {r["run"]: r["count"] for r in saved.groupBy("run").count().collect()} == {"r1": 28, "r2": 28}


def test_row_order_is_usable_for_cleaning(spark, tmp_path):
    df = spark.createDataFrame([("1", "x" * 60, "h"), ("1", "y" * 60, "h")], "id string, article string, highlights string")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    ordered = corpus.with_row_order(spark.read.parquet(str(tmp_path / "t")))
    kept = clean.clean_articles(ordered, "row_order").collect()
    assert [r["article"][0] for r in kept] == ["x"]
