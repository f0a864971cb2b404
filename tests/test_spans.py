import random

import pytest
from newsmill.operators import chunk, spans
from pyspark.sql import functions as F


def parts_of(rng, text):
    if text is None:
        return [None]
    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.choice((0, 1, 3, 9))))
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def tables(spark, texts, seed=0):
    rng = random.Random(seed)
    whole = spark.createDataFrame(list(texts), "k string, text string")
    parts = [(k, i, p, "x", 1) for k, t in texts for i, p in enumerate(parts_of(rng, t))]
    rng.shuffle(parts)
    return whole, spark.createDataFrame(parts, "k string, no long, piece string, key string, i int").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def random_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(("word", "a.b", "x|y", "é")) for _ in range(rng.choice((1, 1, 2, 3, 5, 40))))
                     + rng.choice((". ", "! ", "? ", "|", " . ", ".. ")) for _ in range(rng.choice((0, 1, 5, 60)))]
        out.append((f"t{i}", "".join(sentences)))
    return out


@pytest.mark.parametrize("budget,span", [(7, 1), (7, 3), (12, 2), (900, 64)])
def test_like_packing_in_one_row(spark, budget, span):
    texts = random_texts(30, budget + span)
    whole, parts = tables(spark, texts, span)
    got = spans.chunk_parts(parts, "k", "no", "piece", budget, span=span)
    assert rows(got) == rows(chunk.chunk_table(whole, "k", "text", budget))


def test_odd_texts(spark):
    texts = [("empty", ""), ("null", None), ("blank", " \n "), ("bars", "||"), ("one", "x"), ("stop", ". "),
             (None, "No key here. None at all."), ("ends", "One. Two. "), ("tight", "a. b. c. d.")]
    whole, parts = tables(spark, texts)
    assert rows(spans.chunk_parts(parts, "k", "no", "piece", 2, span=1)) == rows(
        chunk.chunk_table(whole, "k", "text", 2))


def test_a_stop_at_the_end_of_a_part(spark):
    parts = spark.createDataFrame([
        ("a", 0, "One."), ("a", 1, ""), ("a", 2, " Two."), ("a", 3, "Three! "), ("a", 4, " Four"), ("a", 5, "|"),
        ("a", 6, "Five")], "k string, no int, piece string")
    got = spans.sentence_rows(parts, "k", "no", "piece").orderBy("at").collect()
    assert [r["sentence"] for r in got] == ["One.", "Two.Three!", "Four", "Five"]


def test_no_texts(spark):
    empty = spark.createDataFrame([], "k string, no int, piece string")
    assert spans.chunk_parts(empty, "k", "no", "piece", 5).collect() == []


def test_one_text_over_many_blocks(spark):
    n = 40_000
    parts = spark.range(n).select(F.lit("big").alias("k"), "id", F.concat(
        F.lit("Sentence "), F.col("id"), F.expr("repeat(' more', cast(id % 13 as int))"), F.lit(". ")).alias("piece"))
    got = spans.chunk_parts(parts, "k", "id", "piece", 50, span=8)
    sizes = [2 + i % 13 for i in range(n)]
    starts, used = [], 0
    for i, size in enumerate(sizes):
        if not starts or used + size > 50:
            starts.append(i)
            used = 0
        used += size
    made = got.select("chunk_no", F.substring_index("chunk", " ", 2).alias("head"), "n_tokens").orderBy("chunk_no").collect()
    assert [int(r["head"].split()[1].rstrip(".")) for r in made] == starts
    assert [r["chunk_no"] for r in made] == list(range(len(starts)))
    assert max(r["n_tokens"] for r in made) <= 52


def test_texts_move_as_rows_of_parts(spark, monkeypatch):
    kept, real = {}, spans.stored
    monkeypatch.setattr(spans, "stored", lambda df, name, **how: kept.setdefault(name, real(df, name, **how))
                        if name == "sentences" else real(df, name, **how))
    texts = [(f"t{i}", "".join(f"Sentence {k} of {i}. " for k in range(100))) for i in range(6)]
    whole, parts = tables(spark, texts, 5)
    got = spans.chunk_parts(parts, "k", "no", "piece", 30, span=2)
    assert rows(got) == rows(chunk.chunk_table(whole, "k", "text", 30))
    assert kept["sentences"].count() <= parts.count()
