import random

import numpy as np
import pytest
from cases import SCHEMA, odd, rows, table, words
from newsmill.llm import ngram_join
from newsmill.llm.components import components
from newsmill.llm.ngram_join import drop_near_duplicates, near_duplicates


def shingles(text):
    own = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(own[i:i + 4]) for i in range(len(own) - 3)} if len(own) >= 4 else {tuple(own)} - {()}


def brute(found):
    sets, root = [shingles(r[1]) for r in found], list(range(len(found)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a & b and 100 * len(a & b) >= 85 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(found):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0], top(i))
            for i, r in enumerate(found)]


@pytest.fixture(scope="module")
def found():
    rng = random.Random(4)
    names = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(20):
        base = [rng.choice(names) for _ in range(rng.choice([2, 3, 5, 8, 12, 20, 40, 90, 200]))]
        for _ in range(rng.randrange(1, 12)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(names)
            texts.append(" ".join(own + [rng.choice(names) for _ in range(rng.choice([0, 0, 3]))]))
    chain = [rng.choice(names) for _ in range(120)]
    for _ in range(100):  # neighbours link, ends do not
        chain[rng.randrange(120)] = rng.choice(names)
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return rows(texts + ["A b", "a B", "a b"], 50) + odd()


@pytest.mark.parametrize("tree, part, pivots", [(4000, 2000, 2048), (5, 4, 64)])
def test_components_against_brute_force(spark, found, monkeypatch, tree, part, pivots):
    """With one tree for a group, and with groups cut into parts."""
    monkeypatch.setattr(ngram_join, "TREE", tree)
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    got = sorted(map(tuple, near_duplicates(table(spark, found)).collect()), key=repr)
    assert got == sorted([r[:3] for r in brute(found)], key=repr)


def test_one_of_each_component_stays(spark, found):
    docs = table(spark, found)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r, b in zip(found, brute(found)):
        if b[1]:
            groups.setdefault(b[3], []).append(r[0])
    want = sorted(min(i for i in ids if i is not None) for ids in groups.values())
    got = kept.collect()
    assert sorted(r.doc_id for r in got if words(r.text)) == want
    assert sum(not words(r.text) for r in got) == sum(not words(r[1]) for r in found)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == [] and drop_near_duplicates(none).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1050)] + [(7, 7), (3, 2)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1050)}}


def test_another_rule_against_brute_force(spark, found):
    """Five words and 80 percent."""
    def own(text):
        have = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
        return frozenset(tuple(have[i:i + 5]) for i in range(max(len(have) - 4, min(len(have), 1))))

    sets = [own(r[1]) for r in found]
    label = list(range(len(found)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a & b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for x, r in zip(label, found):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    want = [(r[0], len(s), least.get(x) if s else r[0]) for r, s, x in zip(found, sets, label)]
    got = near_duplicates(table(spark, found), words=5, share=80).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("tree", [4000, 2])
def test_sets_are_joined_once(spark, monkeypatch, tree):
    """Copies in several partitions come as one set to where their group is joined."""
    join = ngram_join._join_group

    def once(share):
        joined = join(share)

        def checked(table):
            names = table["name"].to_pylist()
            assert len(names) == len(set(names)), len(names)
            return joined(table)

        return checked

    monkeypatch.setattr(ngram_join, "TREE", tree)
    monkeypatch.setattr(ngram_join, "_join_group", once)
    base = [f"w{i}" for i in range(300)]
    near = [" ".join(base[:i] + ["new"] + base[i + 1:]) for i in (50, 150, 250)]
    docs = spark.createDataFrame(rows(near * 12), SCHEMA).repartition(6)
    assert {r.component_id for r in near_duplicates(docs).collect()} == {0}


def test_packed_points_are_nowhere_below():
    for most in (0, 1, 255, 256, 509, 510, 511, 512, 1021, 1022, 1023, 65535, 2 ** 31 - 1, 2 ** 31):
        point = np.array([most, 0, 1, most // 2, most // 3], dtype=np.uint32)
        back = ngram_join.unpacked([ngram_join.packed(point)])[0]
        assert (back >= point).all(), most
        assert (back[point < 256] == point[point < 256]).all() or most > 255


def test_texts_with_one_passage_in_common_are_not_looked_for(found):
    """Unlinked texts share listings through a passage, but by far not as many as linked ones do;
    two linked texts keep one in common."""
    rng = random.Random(6)
    names = [f"n{i}" for i in range(5000)]
    passage = [rng.choice(names) for _ in range(400)]
    texts = [" ".join([rng.choice(names) for _ in range(1100)] + passage) for _ in range(30)]
    texts += [" ".join([rng.choice(names), *t.split()[1:-i], rng.choice(names)]) for i, t in enumerate(texts[:5], 1)]
    texts += [r[1] or "" for r in found]
    sets = ngram_join.shingle_sets(texts, ngram_join.Hasher())
    lister = ngram_join.Lister(85)
    lists = [set(lister(s).tolist()) for s in sets]
    on = {}
    for one, listed in zip(sets, lists):
        for x in listed:
            on.setdefault(x, set()).add(one.tobytes())
    shared = np.vectorize(lambda x: len(on[int(np.uint64(x % 2 ** 64))]) > 1, otypes=[bool])
    met = [set(lister.met(s, lambda x: shared(x.astype(object)) if len(x) else x.astype(bool)).tolist()) for s in sets]
    assert all(any(lists[i] & lists[j] for j in range(30) if i != j) for i in range(30))
    assert not any(met[5:30]) and all(met[i] & met[30 + i] for i in range(5))
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a.tobytes() != sets[j].tobytes() and ngram_join.linked(a, sets[j], 85):
                assert met[i] & met[j]
                linked += 1
    assert linked > 100


def test_lists_connect_what_their_points_allow():
    """Short lists, long ones and those beyond a tree, in batches that cut them anywhere."""
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 30, (12, 128))
    points = np.maximum(kinds[rng.integers(0, 12, 150)] + rng.integers(-2, 3, (150, 128)), 0).astype(np.uint32)
    sizes = points.sum(axis=1, dtype=np.int64)
    lists = [rng.choice(150, n, replace=False).tolist() for n in (1, 2, 2, 3, 5, 16, 17, 40, 150) * 6]
    rows = [(k * 5 - 60, x * 3 - 100, int(sizes[x]), ngram_join.packed(points[x])) for k, own in enumerate(lists) for x in own]

    def reach(pairs):
        label = {}
        for a, b in pairs:
            one, other = label.setdefault(a, {a}), label.setdefault(b, {b})
            if one is not other:
                one |= other
                label.update(dict.fromkeys(other, one))
        return {frozenset(x) for x in label.values()}

    packed = ngram_join.unpacked([r[3] for r in rows])
    at = {r[1]: i for i, r in enumerate(rows)}
    want = []
    for own in lists:
        for y in own:
            for x in own:
                a, b = at[x * 3 - 100], at[y * 3 - 100]
                most = int(np.minimum(packed[a], packed[b]).sum(dtype=np.int64))
                if x < y and 185 * most >= 85 * int(sizes[x] + sizes[y]):
                    want.append((x * 3 - 100, y * 3 - 100))
    kinds = (ngram_join.pa.int64(),) * 3 + (ngram_join.pa.binary(),)
    chain = np.repeat(np.eye(60, dtype=np.uint32) + np.eye(60, k=1, dtype=np.uint32), 4, axis=1)
    assert (ngram_join._connected(chain, np.full(60, 8), 30) == 0).all()  # neighbours only are allowed
    for step in (1, 7, 10_000):
        batches = [ngram_join.pa.record_batch([ngram_join.pa.array(c, k) for c, k in zip(zip(*rows[i:i + step]), kinds)],
                                              ["sig", "node", "n_shingles", "point"]) for i in range(0, len(rows), step)]
        got = [p for b in ngram_join._meetings(85)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
        assert reach(got) == reach(want)
