import zlib

from cases import SCHEMA, odd, rows, table
from newsmill.llm.sharding import shard_documents, write_shards
from newsmill.session import scratch


def test_shards_are_contiguous_and_even(spark):
    found = rows(["w" * (i * 37 % 400) for i in range(500)], 100) + odd()[-4:]
    got = shard_documents(table(spark, found), 7).collect()
    assert len(got) == len(found)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(7))
    target = sum(r.size for r in got) / 7
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - target) <= 400 + 8
    ids = [(r.shard, r.slot, -1 if r.doc_id is None else r.doc_id) for r in got]
    in_order = [i for _, _, i in sorted(ids)]
    assert in_order == sorted(in_order)
    texts = {i: (t or "").encode() for i, t, *_ in found if i is not None}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 8
               for r in got if r.doc_id is not None)


def test_large_rows_and_empty_table(spark):
    got = shard_documents(table(spark, odd()), 4).collect()
    assert len(got) == len(odd()) and all(0 <= r.shard < 4 for r in got)
    assert shard_documents(spark.createDataFrame([], SCHEMA), 4).collect() == []


def test_written_shards_hold_every_row(spark):
    path = scratch(spark, "shards")
    docs = table(spark, odd())
    column = write_shards(docs, 3, path)
    back = spark.read.parquet(path)
    assert column == "shard_" and back.count() == len(odd())
    assert set(docs.columns) < set(back.columns)
