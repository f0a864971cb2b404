import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import SCHEMA, odd, table
from newsmill.llm import token_files
from newsmill.llm.queries import vocabulary
from newsmill.llm.token_counts import count_tokens
from newsmill.llm.token_files import digest, joined_crc, read_ids, write_ids
from newsmill.session import scratch
from tokenizers import Tokenizer

PARTS = list("abXY'sé ñ  \n\t\r\x0b\x1c\x1f\x85\xa0  ᠎​12!?.#") + [
    "<|endoftext|>", "<|startoftext|>", " the", "'re", "́", "Σ", "İ", "\U0001F600", "ﬁ"]


@pytest.fixture(scope="module")
def found():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a " * 70000, "a" * 5000]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + odd()


def library(name, found):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [(row[0], row[1] or "", tokenizer.encode(row[1] or "", add_special_tokens=False).ids)
            for row in found]


def test_counts_are_the_librarys(spark, found):
    want = [(i, len(t.encode()), len(ids)) for i, t, ids in library("word_bpe_49k.json", found)]
    got = count_tokens(table(spark, found), vocabulary("word_bpe_49k.json"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_files_give_the_librarys_ids_back(spark, found):
    want = [(i, len(ids) + 1, zlib.crc32(np.array(ids + [0], dtype="<u4").tobytes()))
            for i, _, ids in library("byte_bpe_50k.json", found)]
    path = scratch(spark, "ids")
    write_ids(table(spark, found), vocabulary("byte_bpe_50k.json"), path)
    got = digest(read_ids(spark, path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    before, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before and (r.doc_id is None or r.doc_id >= last)
        before, last = before + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    one = read_ids(spark, path, [7]).collect()
    assert {r.doc_id for r in one} == {7}
    assert max(len(r.ids) for r in read_ids(spark, path).collect()) <= 2048


def test_lookups_skip_by_metadata(spark, found):
    path = scratch(spark, "ids")
    write_ids(table(spark, found), vocabulary("byte_bpe_50k.json"), path)
    plan = read_ids(spark, path, [7])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [7])]" in plan or "EqualTo(doc_id,7)" in plan


def test_few_pieces_held_give_the_same_ids(found, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 40)
    monkeypatch.setattr(token_files, "TOGETHER", 7)
    encoder, texts = token_files.Encoder(vocabulary("byte_bpe_50k.json")), [r[1] or "" for r in found]
    want = [ids for _, _, ids in library("byte_bpe_50k.json", found)]
    for size in (1, 13, 200):
        got = [x for i in range(0, len(texts), size) for x in encoder.encode(texts[i:i + size])]
        assert [x.tolist() for x in got] == want


def test_pieces_are_no_objects_of_python():
    encoder = token_files.Encoder(vocabulary("byte_bpe_50k.json"))
    texts, calls = [f"{i}x " + " ".join(f"w{i}.{k}" for k in range(20)) for i in range(3000)], []
    encoder.tokenizer = type("Counted", (), {"encode_batch_fast": lambda self, some, real=encoder.tokenizer, **how: (
        calls.append(len(some)), real.encode_batch_fast(some, **how))[1]})()
    encoder.encode(texts[:10])
    before = sys.getallocatedblocks()
    got = encoder.encode(texts[10:])
    assert sys.getallocatedblocks() - before < 20_000 and len(calls) < 100
    assert [x.tolist() for x in got] == [ids for _, _, ids in library(
        "byte_bpe_50k.json", [(0, t) for t in texts[10:]])]


def test_files_have_bloom_filters_and_skip_row_groups(spark):
    docs = spark.range(30_000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text")
    path = scratch(spark, "ids")
    write_ids(docs, vocabulary("byte_bpe_50k.json"), path)
    orc, hadoop = spark._jvm.org.apache.orc, spark._jvm.org.apache.hadoop
    files = hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        hadoop.fs.Path(path + "/*.orc"))
    for file in files:
        reader = orc.OrcFile.createReader(file.getPath(), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        rows = reader.rows()
        for stripe in reader.getStripes():
            kinds = [(s.getKind().toString(), s.getColumn()) for s in rows.readStripeFooter(stripe).getStreamsList()]
            assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds
        rows.close()

    def read(doc_id):
        """Rows that come out of the scan, before they are filtered."""
        df = read_ids(spark, path, [doc_id])
        found = df.collect()
        nodes, scans = [df._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            if node.nodeName().startswith("Scan"):
                scans.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
        return len(found), sum(scans)

    some, scanned = read(20_000)
    assert some == 1 and 0 < scanned <= 2000  # a group of 1000 rows, or two
    none, scanned = read(20_001)  # between the ids of a group: only the Bloom filter can tell
    assert none == 0 and scanned == 0


def test_checksums_of_parts_join():
    data = bytes(range(256)) * 9
    for cut in (0, 1, 5, 700, len(data)):
        assert joined_crc(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]),
                          len(data) - cut) == zlib.crc32(data)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert count_tokens(none, vocabulary("word_bpe_49k.json")).collect() == []
    path = scratch(spark, "ids")
    write_ids(none, vocabulary("byte_bpe_50k.json"), path)
    assert digest(read_ids(spark, path)).collect() == []
