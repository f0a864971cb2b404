import random
import re
from collections import Counter

import numpy as np
from cases import SCHEMA, odd, rows, table, words
from newsmill.llm.quality import EVERYTHING, Hasher, judge, keep_good, score


def counted(text):
    own = words(text)
    windows = Counter(tuple(own[i:i + 5]) for i in range(len(own) - 4))
    covered = {j for i in range(len(own) - 4) if windows[tuple(own[i:i + 5])] > 1
               for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["a", "b", "é", "\U0001F600", " ", " ", "\n", "#", "\x00", "\x1c", "\xa0", "a b c d e f\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(800)]
    found = rows(texts + ["x" * 1500000, "ab " * 500000]) + odd()
    got = score(table(spark, found), EVERYTHING).collect()
    want = sorted([(i, *counted(t)) for i, t, *_ in found], key=repr)
    assert sorted([tuple(r)[:6] for r in got], key=repr) == want


def test_equal_stretches_hash_alike_wherever_they_are():
    data = np.frombuffer(b"abcab" * 300000, dtype=np.uint8)
    first = np.array([0, 5, 10, 700000, 1499995, 1500000])
    got = Hasher()(data, first, np.array([5, 10, 13, 700005, 1500000, 1500000]))
    assert got[0] == got[1] == got[3] == got[4] and len(set(got.tolist())) == 3


def sample(n, seed):
    """Good and bad texts, and their labels."""
    rng = random.Random(seed)
    found, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        own = [rng.choice(["river", "stone", "walks", "light", "under", "seven", "paper"]) + rng.choice(
            ["", "s", "er"]) for _ in range(rng.randrange(12, 60))]
        text = " ".join(own) if good else "!! ".join(own).upper()
        found.append((seed * 10000 + i, text, "en", "s", len(text)))
        labels.append((seed * 10000 + i, int(good), 0))
    return found, labels


def test_held_out_accuracy(spark):
    found, labels = sample(600, 1)
    unseen, truth = sample(300, 2)
    docs = table(spark, found + unseen)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    verdict = {r.doc_id: r for r in judge(docs, known).collect()}
    right = [verdict[i].kept == (q == 1 and not verdict[i].base_failed) for i, q, _ in truth]
    assert sum(right) / len(right) > 0.97
    kept = {r.doc_id for r in keep_good(docs, known).collect()}
    assert kept == {i for i, r in verdict.items() if r.kept}


def test_without_labels_only_the_limits_hold(spark):
    docs = table(spark, odd())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = judge(docs, none).collect()
    assert all(r.kept == (not r.base_failed) for r in got) and len(got) == len(odd())
    kept = keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert judge(spark.createDataFrame([], SCHEMA), none).collect() == []
