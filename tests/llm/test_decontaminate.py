import random

import numpy as np
from cases import SCHEMA, odd, rows, table
from newsmill.llm.decontaminate import (
    Index, contamination, phrases, remove_passages, shard_hits, suffix_array)

WORDS = [b"a", b"b", b"c", b"d\xc3\xa9", b"e"]


def brute(doc, items):
    hit, own = set(), set()
    for item, phrase in items:
        size = min(10, len(phrase))
        windows = {tuple(phrase[k:k + size]) for k in range(len(phrase) - size + 1)} if size else ()
        for at in range(len(doc) - size + 1):
            if size and tuple(doc[at:at + size]) in windows:
                hit.update(range(at, at + size))
                own.add(str(item))
    return hit, sorted(own)


def test_hits_against_brute_force():
    rng = random.Random(2)
    for trial in range(200):
        some = WORDS[:rng.randrange(1, 6)]
        docs = [[rng.choice(some + [b"z"]) for _ in range(rng.randrange(60))]
                for _ in range(rng.randrange(1, 8))]
        items = []
        for i in range(rng.randrange(1, 5)):
            doc = rng.choice(docs)
            at = rng.randrange(len(doc) + 1)
            items.append((i, doc[at:at + rng.randrange(30)] if rng.random() < .5 else
                          [rng.choice(some) for _ in range(rng.randrange(14))]))
        blocks = [phrases([x]) for x in items] if trial % 2 else [phrases(items)]
        got = shard_hits([b" ".join(d).decode() for d in docs], blocks)
        for doc, (n, spans, own) in zip(docs, got):
            assert n == len(doc)
            assert ({x for a, b in spans for x in range(a, b)}, own) == brute(doc, items)


def test_index_finds_every_place():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = rng.integers(1, 4, n)
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        windows = np.array([[1, 2], [3, 3], [2, 2]])
        at, row = Index(text, 4).search(windows)
        want = {(i, r) for r, w in enumerate(windows) for i in range(n - 1)
                if (text[i:i + 2] == w).all()}
        assert set(zip(at.tolist(), row.tolist())) == want


def test_passages_go_and_the_rest_stays(spark):
    passage = "Alpha beta gamma; delta epsilon zeta eta theta iota kappa lambda."
    clean = "nothing to see in this text at all, it is about rivers"
    found = rows([f"Before it. {passage} After it.", clean, passage, "short one here"], 100) + odd()
    marks = spark.createDataFrame([(1, passage), (2, "Short ONE"), (3, ""), (4, None), (None, "x")],
                                  "item_id long, text string")
    docs = table(spark, found)
    got = {r.doc_id: r for r in contamination(docs, marks).collect() if r.doc_id is not None}
    assert len(contamination(docs, marks).collect()) == len(found)
    cut = remove_passages(docs, marks)
    texts = {r.doc_id: r for r in cut.collect() if r.source is not None}
    assert texts[100].text == "Before it. . After it." and texts[100].n_chars == len(texts[100].text)
    assert texts[101].text == clean and 102 not in texts and texts[103].text == " here"
    assert cut.columns == docs.columns


def test_empty_tables(spark):
    marks = spark.createDataFrame([], "item_id long, text string")
    assert contamination(spark.createDataFrame([], SCHEMA), marks).collect() == []
    got = contamination(table(spark, odd()), marks).collect()
    assert len(got) == len(odd()) and not any(r.contaminated for r in got)
