import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, odd, rows, table
from newsmill.llm.suffix_dedup import remove_repeats, suffix_array


def test_suffix_array_against_sorting():
    rng = random.Random(9)
    for n in [*range(30), 100, 500]:
        for kinds in (1, 2, 4, 50):
            text = np.array([rng.randrange(1, kinds + 1) for _ in range(n)], dtype=np.int64)
            assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def brute(found):
    raws = [(r[0], (r[1] or "").encode()) for r in found]
    times = Counter(raw[i:i + 200] for _, raw in raws for i in range(len(raw) - 199))
    out = []
    for doc, raw in raws:
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - 199):
            if times[raw[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def found():
    rng = random.Random(9)
    names = ["the", "of", "été", "x", "\n", "zz"] + [
        "".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]

    def some(n):
        return " ".join(rng.choice(names) for _ in range(n))

    passages, texts = [some(rng.choice([30, 45, 60, 120])) for _ in range(12)], []
    for _ in range(120):
        text = some(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            part = rng.choice(passages)
            part = part[rng.randrange(len(part) // 2):] if rng.random() < .5 else part
            half = len(part) // 2
            text += (part[:half] + "#" + part[half:] if rng.random() < .4 else part) + some(5)
        texts.append(text)
    return rows(texts + ["ab" * 400, "orre " * 500, "a" * 199, "b" * 200, "c" * 201, "é" * 150], 50) + [
        r for r in odd() if len(r[1] or "") < 1000]


@pytest.mark.parametrize("hot", [50000, 6, 2])
def test_against_brute_force(spark, found, hot):
    """With all stretches sorted, and with the windows of crowded anchors counted."""
    got = sorted([tuple(r)[:5] for r in remove_repeats(table(spark, found), hot).collect()], key=repr)
    assert got == brute(found)


def test_long_text_and_empty_table(spark):
    got = {r.doc_id: r for r in remove_repeats(table(spark, odd())).collect()}
    long = got[6]
    assert long.n_removed == long.n_bytes == 520000 and long.n_spans == 1
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
