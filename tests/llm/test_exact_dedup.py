import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

from cases import odd, rows, table
from newsmill.llm import exact_dedup
from newsmill.llm.exact_dedup import copies, drop_copies, repeated_words

from pyspark.sql import functions as F


def expected(found):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(found):
        text = text or ""
        groups[re.sub("[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id or 0, i))
    out = Counter()
    for text, members in groups.items():
        best = min(members)
        for m in members:
            keep = found[best[3]][0]
            out[found[m[3]][0], keep, len(members), m == best, sha256(text.encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_odd_rows(spark):
    found = odd() + rows([None, "a b", " a\tb", "ab", "a b", "a b"], 50)
    assert got(copies(table(spark, found))) == expected(found)


def test_no_rows(spark):
    assert copies(table(spark, [])).collect() == []
    assert drop_copies(table(spark, [])).collect() == []


def test_copies_of_every_group_size(spark):
    rng = random.Random(5)
    texts = [f"{rng.choice(('', ' '))}text {n}" for n in range(60) for _ in range(n)] + ["hot text"] * 900
    texts += [f"single {i}" for i in range(800)]
    rng.shuffle(texts)
    found = rows(texts)
    assert got(copies(table(spark, found))) == expected(found)


def test_same_rows_without_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    found = rows([f"text {rng.randrange(300)}" for _ in range(900)] + ["hot text"] * 700)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "HEAVY", 20)
    made = copies(table(spark, found))
    assert got(made) == expected(found)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rng = random.Random(7)
    found = rows([f"text {rng.randrange(900)}" for _ in range(1500)])
    placed = exact_dedup._placed
    monkeypatch.setattr(exact_dedup, "_placed", lambda df, words: placed(df, 7))  # seven words for all
    assert got(copies(table(spark, found))) == expected(found)


def test_the_filter_holds_back_single_rows(spark):
    total = 20_000
    single = spark.range(total).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("_sha"))
    placed = exact_dedup._placed(single, total * exact_dedup.WORDS_PER_ROW)
    words = repeated_words(placed)
    passed = placed.join(words, "_word").filter(F.col("_twice").bitwiseAND(F.col("_mark")) == F.col("_mark"))
    assert passed.count() < 0.005 * total


def test_counters_up_to_their_end(spark):
    for n in (2, 14, 15, 16, 17, 300):
        placed = exact_dedup._placed(spark.range(n).select(F.unhex(F.sha2(F.lit("x"), 256)).alias("_sha")), 5)
        row = repeated_words(placed).first()
        mark = placed.first()["_mark"]
        assert row["_n"] == n and row["_twice"] & mark == mark


def test_only_possible_copies_are_stored(spark):
    found = rows([f"single {i}" for i in range(500)] + ["twice", "twice"])
    docs = table(spark, found)
    plan = copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "hashpartitioning" not in plan.lower() and "SortMergeJoin" not in plan  # single rows stay where they are


def test_documents_that_stay_keep_all_columns(spark):
    found = odd() + rows(["same", "sa me", "sam e"], 70)
    docs = table(spark, found)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    want = Counter(k[0] for k, n in expected(found).items() if k[3])
    kept = left.collect()
    assert Counter(r["doc_id"] for r in kept) == want
    assert {r["text"] for r in kept if r["doc_id"] in (70, 71, 72)} == {"sa me"}
