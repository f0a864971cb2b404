import os
import random
import re
from collections import Counter

import corpus_pipeline
from cases import odd, rows, table, words
from newsmill.llm.mixing import curriculum
from newsmill.llm.quality import judge
from newsmill.llm.queries import MIX
from newsmill.session import drop_stored

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_stages_act_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF_DIR).cache())
    for after in seen[1:-1]:
        assert after.columns == docs.columns
    raw, good, single, clean, mixed, sharded = [df.collect() for df in seen]
    assert 0 < len(good) < len(raw) and 0 < len(single) < len(good)
    assert {r.doc_id for r in single} <= {r.doc_id for r in good} <= {r.doc_id for r in raw}
    assert len({r.doc_id for r in single}) == len(single)
    before = {r.doc_id: r.text for r in single}
    assert any(len(r.text) < len(before[r.doc_id]) for r in clean)
    total = sum(len(words(r.text)) for r in clean)
    assert abs(sum(len(words(r.text)) for r in mixed) - MIX["share"] * total) < 0.1 * total
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in sharded)
    assert {r.shard for r in sharded} == set(range(24))


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    def text(tag, changed=0):  # no word occurs twice; five shingles go with each changed one
        own = [f"{tag}{i}" for i in range(1000)]
        for i in range(changed):
            own[20 + 40 * i] = f"{tag}new{i}"
        return " ".join(own)

    # 0.809 and 0.793 of five words, 0.845 and 0.831 of four
    found = rows([text("a"), text("a", 21), text("b"), text("b", 23)])
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, table(spark, found), SF_DIR).collect()) == [0, 2, 3]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def planted(spark):
    """Odd rows, near copies, a passage of the benchmark, repeated rows, and a null id."""
    rng = random.Random(9)
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(base[::-1]), f"before it {item} after it", item, "a b", "a b"]
    return odd() + rows(texts, 100) + [(100, " ".join(base), "en", "s0", 1), (None, "no id here", None, None, None)]


def multiset(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_keeps_what_the_verdict_says(spark):
    docs = table(spark, planted(spark))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = stage("quality")(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert multiset(kept, "doc_id") == multiset(judge(docs, labels).filter("kept"), "doc_id")


def test_near_duplicates_against_brute_force(spark):
    found = planted(spark)
    sets = []
    for _, text, *_ in found:
        ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    label = list(range(len(found)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    want = Counter()
    for group in set(label):
        members = [r for r, x, s in zip(found, label, sets) if x == group and s]
        if members:
            want[min(members, key=lambda r: (r[0] is None, r[0] or 0))[0]] += 1
    want.update(r[0] for r, s in zip(found, sets) if not s)
    docs = table(spark, found)
    kept = stage("near_duplicates")(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert Counter(i for (i,), n in multiset(kept, "doc_id").items() for _ in range(n)) == want


def test_decontamination_against_brute_force(spark):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        ws = split(r.text)
        n = min(10, len(ws))
        windows |= {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if n else set()
    sizes, want = {len(w) for w in windows}, Counter()
    for doc_id, text, *_ in planted(spark):
        ws = split(text)
        hit = {k for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i:i + n]) in windows for k in range(i, i + n)}
        left = tuple(w for k, w in enumerate(ws) if k not in hit)
        if left or not ws:
            want[doc_id, left] += 1
    docs = table(spark, planted(spark))
    clean = stage("decontamination")(spark, docs, SF_DIR)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, tuple(split(r.text))) for r in clean.collect()) == want
    assert all(r.n_chars == len(r.text) for r in clean.collect() if r.text is not None)


def test_mixing_and_sharding_of_odd_rows(spark):
    docs = table(spark, planted(spark))
    mixed = stage("mixing")(spark, docs, SF_DIR)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in curriculum(docs, **MIX).collect():
        want[r.doc_id] += r.copies
    assert multiset(mixed, "doc_id") == Counter({(i,): n for i, n in want.items() if n})
    sharded = stage("sharding")(spark, mixed, SF_DIR).collect()
    assert Counter(r.doc_id for r in sharded) == +want
    for shard in {r.shard for r in sharded}:
        slots = sorted(r.slot for r in sharded if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_stages_of_an_empty_table(spark):
    docs = table(spark, [])
    for name, apply in corpus_pipeline.STAGES:
        made = apply(spark, docs, SF_DIR)
        assert made.collect() == []
        if name != "sharding":
            assert made.columns == docs.columns


def test_run_leaves_its_last_table_only(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(corpus_pipeline, "drop_stored", lambda df: (kept.append(1), drop_stored(df)))
    rows_made = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows_made and len(kept) == len(corpus_pipeline.STAGES) - 2
