import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

from cases import odd, rows, table, words
from newsmill.llm.audit import audit, shapley, text_mask
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int, text string, mask string"


def labelled(spark, found):
    return spark.createDataFrame([(*r, "t", "m") for r in found], LABELS)


def mask(text):
    ws = words(text)
    fails = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws),
             100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text))]
    return {"ABCD"[i] for i, f in enumerate(fails) if f}


def expected(found, labels):
    """Every order walked through on its own."""
    docs = []
    for doc_id, text, lang, *_ in found:
        fails = mask(text or "")
        others = [i for i, t, *_ in found if (t or "") == (text or "") and i is not None]
        if doc_id is not None and any(i < doc_id for i in others):
            fails.add("E")
        mine = [r for r in labels if r[0] is not None and r[0] == doc_id]
        docs.append((lang or "", fails, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out = set()
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        lines, total = [], Counter()
        for order in permutations("ABCDE"):
            left, gone = here, []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                lines.append(("".join(order), step, len(left), len(removed),
                              sum(f in d[1] for d in gone), sum(d[1] == {f} for d in here),
                              sum(d[2] for d in removed), sum(d[3] for d in removed), f))
                gone += removed
                total[f] += len(removed)
        out |= {(part, *line[:-1], total[line[-1]]) for line in lines}
    return out


def got(df):
    made = [tuple(r) for r in df.collect()]
    assert len(made) == len(set(made))
    return set(made)


def texts(n, seed):
    rng = random.Random(seed)
    small = ["a b", "# x", "AAA", "", None, "Ab cd " * 150, "w " * 300]
    return [rng.choice((
        rng.choice(small), " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice((150, 250, 600)))),
        " ".join(f"W{i}" for i in range(rng.choice((199, 200, 201)))) + rng.choice(("", " $5")))) for _ in range(n)]


def test_like_walking_every_order(spark):
    rng = random.Random(2)
    found = [(i, t, rng.choice(("en", "fr", None, "")), s, n) for i, t, _, s, n in rows(texts(120, 2))]
    labels = [(rng.randrange(140), rng.randrange(2), rng.randrange(2)) for _ in range(60)]
    assert got(audit(table(spark, found), labelled(spark, labels))) == expected(found, labels)


def test_odd_rows_and_labels(spark):
    found = odd() + [(3, "x", "en", "s", 1), (None, "x", "en", "s", 1), (4, None, "de", "s", 0)]
    labels = [(0, 1, None), (0, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1), (5, 1, 0), (5, 1, 0)]
    assert got(audit(table(spark, found), labelled(spark, labels))) == expected(found, labels)


def test_no_rows(spark):
    assert audit(table(spark, []), labelled(spark, [])).collect() == []
    found = rows(["a"])
    assert got(audit(table(spark, found), labelled(spark, []))) == expected(found, [])


def test_limits_of_the_filters(spark):
    found = [" ".join(f"w{i}" for i in range(199)), " ".join(f"w{i}" for i in range(200)),
             "a b " * 100, "a a a b b", "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "Ä" * 50, "|", "@", "",
             "\x0ba\x0c", "a a a", "x\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "i long, text string")
    made = {r["i"]: r["m"] for r in df.select("i", text_mask(F.col("text")).alias("m")).collect()}
    for i, t in enumerate(found):
        assert made[i] == sum(1 << "ABCD".index(f) for f in mask(t)), t


def test_shares_are_the_mean_over_orders(spark):
    rng = random.Random(1)
    for m in (1, 2, 3, 5):
        removed = [0] + [rng.randrange(1000) for _ in range((1 << m) - 1)]
        total, orders = [Fraction(0)] * m, list(permutations(range(m)))
        for order in orders:
            s = 0
            for f in order:
                total[f] += removed[s | 1 << f] - removed[s]
                s |= 1 << f
        assert shapley(removed) == [t / len(orders) for t in total]
