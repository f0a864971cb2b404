import pytest
from cases import SCHEMA, odd, rows, table, words
from pyspark.sql import functions as F

from newsmill.llm import mixing, queries
from newsmill.llm.mixing import (
    curriculum, demand, due_at, in_training_order, mixed, placed_copies, targets)

MIX = {"weights": (3, 1, 2), "share": 1.5, "cap": 2.0}


def test_targets_fill_up_to_the_cap(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 500), ("e", 0)]
    got = {r.source: r.target for r in targets(
        spark.createDataFrame(sizes, "source string, source_size long"), **MIX).collect()}
    # by hand: weights 3 1 2 3 1 for a b c e null; shares are filled round by round
    weights = dict(zip(["a", "b", "c", "e", None], (3, 1, 2, 3, 1)))
    caps, left, free = {s: 2 * n for s, n in sizes}, 1.5 * 1610, set(caps_ := weights)
    want = {}
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= caps[s]}
        if not over:
            want.update({s: level * weights[s] for s in free})
            break
        want.update({s: float(caps[s]) for s in over})
        left -= sum(caps[s] for s in over)
        free -= over
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_taken_words_come_near_targets(spark):
    found = rows(["w " * (i % 50) for i in range(900)])
    got = curriculum(table(spark, found), **MIX).collect()
    by = {}
    for r in got:
        assert r.size == len(words("w " * (r.doc_id % 50))) and r.copies in (0, 1, 2)
        assert (r.position is None) == (r.copies == 0)
        assert r.position is None or 0 <= r.position <= 1
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.size * r.copies
    for target, size, taken in by.values():
        assert abs(taken - target) <= 50
    again = curriculum(table(spark, found).repartition(5), **MIX).collect()
    key = lambda r: (r.doc_id, r.copies, r.position)
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)


def test_positions_follow_the_schedule(spark):
    """Half of the demand of a source that grows falls into less than half of the time left."""
    found = [(i, "w w w w", "en", "s", 7) for i in range(400)]
    for slope in (0.8, 0.0, -0.8):
        got = curriculum(table(spark, found), (1,), 1.0, 2.0, slopes=(slope,)).collect()
        early = sum(r.position < 0.5 for r in got) / len(got)
        assert abs(early - (0.5 + slope * (0.25 - 0.5))) < 0.01


def test_training_order_holds_every_copy(spark):
    docs = table(spark, odd() + rows(["a b c"] * 30, 100))
    plan = curriculum(docs, **MIX)
    mixed = in_training_order(docs, **MIX)
    assert mixed.columns == docs.columns
    want = sorted(((r.doc_id, r.size) for r in plan.collect() for _ in range(r.copies)), key=repr)
    got = sorted(((r.doc_id, len(words(r.text))) for r in mixed.collect()), key=repr)
    assert got == want


def test_empty_table_and_no_words(spark):
    assert curriculum(spark.createDataFrame([], SCHEMA), **MIX).collect() == []
    got = curriculum(table(spark, rows(["", None, " "])), **MIX).collect()
    assert [r.copies for r in got] == [0, 0, 0]


def test_every_copy_has_its_position(spark):
    """Copies come in passes over the source, each when the source's demand reaches its first word."""
    docs = table(spark, rows(["w " * (1 + i % 7) for i in range(300)]))
    got = curriculum(docs, (1, 4, 2), 1.5, 4.0).collect()
    slopes, again = dict(zip(("s0", "s1", "s2"), (0.6, 0.0, -0.6))), 0
    for r in got:
        assert len(r.positions) == r.copies and r.positions == sorted(r.positions)
        assert r.position == (r.positions[0] if r.copies else None)
        owed = [r.target * (t + slopes[r.source] * (t * t - t)) for t in r.positions]
        for one, two in zip(owed, owed[1:]):
            assert abs(two - one - r.source_size) < 1e-6
            again += 1
    assert again > 100  # so that there are documents taken more than once


def test_positions_invert_the_integral_of_the_weight(spark):
    ends = spark.range(101).select((F.col("id") / 100).alias("t")).crossJoin(spark.createDataFrame(
        [(s,) for s in (1.0, 0.6, 0.0, -0.6, -1.0)], "_slope double")).withColumn("target", F.lit(700.0))
    got = ends.withColumn("word", demand(F.col("t"))).withColumn("back", due_at(F.col("word"))).collect()
    assert all(abs(r.back - r.t) < 1e-6 for r in got)
    assert all(abs(r.word - 700 * r.t) < 1e-9 for r in got if r.t in (0.0, 1.0))


@pytest.mark.parametrize("most", [mixing.BROADCAST_ROWS, -1])
def test_the_mix_has_every_copy_at_its_position(spark, monkeypatch, most):
    """Whole rows in training order over all sources, equal ones too; the words are those of the copies in place."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
    docs = table(spark, odd() + rows(["w " * (1 + i % 7) for i in range(90)] * 2, 100) + rows(["a b c"] * 30, 50) * 2)
    plan = curriculum(docs, **MIX)
    mix, (turn, nth, at) = placed_copies(docs, plan)
    got = mix.collect()
    assert [r[at] for r in got] == sorted(r[at] for r in got)
    want = {(r.turn, r.nth): r for r in plan.collect()}
    assert len(want) == docs.count()
    assert sorted((r[turn], r[nth], r[at]) for r in got) == sorted(
        (r.turn, r.nth, x) for r in want.values() for x in r.positions)
    assert all((want[r[turn], r[nth]].doc_id, want[r[turn], r[nth]].size) == (r.doc_id, len(words(r.text))) for r in got)
    counted = mixed(docs, **MIX).collect()
    assert len(counted) == len(want)
    for r in counted:
        assert r.taken == r.size * want[r.turn, r.nth].copies and r.position == want[r.turn, r.nth].position


def test_the_query_counts_the_copies_in_place(spark, monkeypatch):
    """What is missing in the mix is missing in the rows of the query."""
    place = mixing.placed_copies

    def without_short(docs, plan):
        mix, names = place(docs, plan)
        return mix.filter("length(text) >= 6"), names

    monkeypatch.setattr(mixing, "placed_copies", without_short)
    monkeypatch.setattr(queries, "documents", lambda *_: table(spark, rows(["w " * (1 + i % 7) for i in range(90)])))
    got = queries.op5_mixing(spark, "").collect()
    assert len(got) == 90 and all((r.taken == 0) == (r.position is None) for r in got)
    assert all(r.taken == 0 for r in got if r.size < 3) and any(r.taken for r in got)
