"""Token counts of documents from counts of distinct pre-tokens.

A pre-token here is a run of characters other than white space. The tokenizers this suits never
merge across white space, so a document has as many tokens as its pre-tokens have together, and
each distinct pre-token of the corpus is encoded once. No token ids are kept.

Documents are dealt with in chunks of bounded size. A chunk lists, for each of its distinct
pre-tokens, which of its documents hold it and how often. The lists are dealt out by a hash of the
pre-token, many of them to a row, so that those of one pre-token meet where it is encoded: a
frequent one brings an entry per chunk instead of one per document, and all rows of a bucket are
about as large. What the documents owe to a bucket goes back to their chunk to be summed.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm.worker import kept

CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 1 << 14
BUCKETS_PER_PARTITION = 4
CACHED = 1_000_000  # pre-tokens of a bucket whose counts are held; others are counted anew
POSTINGS = "chunk long, bucket int, tokens binary, lengths binary, docs binary, times binary"
# white space as the tokenizer's patterns see it; str.split takes four control characters more
OTHER = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROL = re.compile("[\x1c-\x1f]")


def pre_tokens(text: str) -> list[str]:
    return OTHER.findall(text) if CONTROL.search(text) else text.split()


def chunks(batches, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list, list]]:
    """Lists of ids, sizes and texts with about ``limit`` bytes; a longer text stands alone."""
    ids, sizes, texts, total = [], [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if texts and (total + row[1] > limit or len(texts) >= CHUNK_DOCS):
                yield ids, sizes, texts
                ids, sizes, texts, total = [], [], [], 0
            ids.append(row[0])
            sizes.append(row[1])
            texts.append(row[2])
            total += row[1]
    if texts:
        yield ids, sizes, texts


def slices(batch: pa.RecordBatch, sizes: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes by the column numbered ``sizes``."""
    total = np.cumsum(batch.column(sizes).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _postings(buckets: int):
    """Chunks -> rows (chunk, bucket, tokens, lengths, docs, times).

    ``docs`` and ``times`` say in which documents of the chunk the tokens of the bucket are, and
    how often; ``lengths`` how many entries each token has. A row of bucket -1 has ids and sizes.
    """
    def make(batches):
        task = TaskContext.get().partitionId() << 32
        for n, (ids, sizes, texts) in enumerate(chunks(batches)):
            tokens, times, each = [], [], []
            for text in texts:
                counted = Counter(pre_tokens(text))
                tokens.extend(counted)
                times.extend(counted.values())
                each.append(len(counted))
            known = np.array([i is not None for i in ids], dtype=np.int64)
            head = np.array([[i or 0 for i in ids], known, sizes], dtype=np.int64).tobytes()
            rows = [(task + n, -1, b"", b"", head, b"")]
            if tokens:
                codes, names = pd.factorize(np.array(tokens, dtype=object))
                bucket = (hash_array(names, categorize=False) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                codes, names, bucket = place[codes], names[order].tolist(), bucket[order]
                doc = np.repeat(np.arange(len(texts), dtype=np.uint16), each)
                freq = np.array(times, dtype=np.uint32)
                entry = np.argsort(codes, kind="stable")
                doc, freq = doc[entry], freq[entry]
                lengths = np.bincount(codes, minlength=len(names)).astype(np.uint16)
                ends = np.cumsum(lengths, dtype=np.int64)
                first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(names)]):
                    x, y = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
                    rows.append((task + n, int(bucket[a]), "\n".join(names[a:b]).encode(),
                                 lengths[a:b].tobytes(), doc[x:y].tobytes(), freq[x:y].tobytes()))
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                  [c.split()[0] for c in POSTINGS.split(", ")])

    return make


def _owed(shared, name: int):
    """Rows of postings, sorted by bucket -> rows (chunk, docs, pieces) of the documents' shares."""
    def count(batches):
        from tokenizers import Tokenizer
        tokenizer = kept(("tokenizer", name), lambda: Tokenizer.from_buffer(shared.value))
        here, known = None, {}
        for batch in batches:
            rows = []
            for chunk, bucket, tokens, lengths, docs, times in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    rows.append((chunk, docs, None))
                    continue
                if bucket != here or len(known) > CACHED:
                    here, known = bucket, {}
                names = tokens.decode().split("\n")
                missing = [t for t in names if t not in known]
                for i in range(0, len(missing), 1000):
                    part = missing[i:i + 1000]
                    known.update(zip(part, (len(e.ids) for e in tokenizer.encode_batch_fast(
                        part, add_special_tokens=False))))
                pieces = np.array([known[t] for t in names], dtype=np.int64)
                pieces = np.repeat(pieces, np.frombuffer(lengths, np.uint16))
                at = np.frombuffer(docs, np.uint16)
                owed = np.bincount(at, weights=pieces * np.frombuffer(times, np.uint32))
                some = np.flatnonzero(owed)
                rows.append((chunk, some.astype(np.uint16).tobytes(),
                             owed[some].astype(np.uint32).tobytes()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(
                zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["chunk", "docs", "pieces"])

    return count


def _total(table: pa.Table) -> pa.Table:
    """Counts of the documents of one chunk."""
    owed = table["pieces"].to_pylist()
    docs = table["docs"].to_pylist()
    head = owed.index(None)
    ids, known, sizes = np.frombuffer(docs[head], np.int64).reshape(3, -1)
    total = np.zeros(len(ids), dtype=np.int64)
    for at, pieces in zip(docs, owed):
        if pieces is not None:
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(pieces, np.uint32)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=known == 0),
                     "n_bytes": sizes, "n_tokens": total})


def count_tokens(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one for each row of ``docs``.

    ``vocabulary`` is a tokenizer file. Null and empty texts have no tokens; special strings
    inside texts count as the tokenizer's default has it; repeated rows and null ids keep rows of
    their own.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # one file, of fixed size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    postings = rows.mapInArrow(_postings(parts * BUCKETS_PER_PARTITION), POSTINGS)
    met = postings.repartition(parts, "bucket", F.when(F.col("bucket") < 0, F.col("chunk")))
    owed = met.sortWithinPartitions("bucket").mapInArrow(
        _owed(shared, zlib.crc32(vocabulary)), "chunk long, docs binary, pieces binary")
    return owed.groupBy("chunk").applyInArrow(_total, "doc_id long, n_bytes long, n_tokens long")
