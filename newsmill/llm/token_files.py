"""Token ids of documents as ORC files in the order of document ids.

ORC keeps ids in integer run-length encoding inside stripes that can be read in parallel; row
indexes and a Bloom filter on the document id let a lookup skip stripes and row groups. A document
is cut into rows of at most ``IDS_PER_ROW`` ids, so that readers hold bounded batches however long
a text is. Columns: ``doc_id``; ``part`` and ``nth``, the document's place; ``block``, the row's
place in the document; ``ids``.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm.prefix import with_prefix
from newsmill.llm.token_counts import slices
from newsmill.llm.worker import kept
from newsmill.session import stored

IDS_PER_ROW = 2048
ROWS_PER_FILE = 50_000
CACHED = 600_000  # pieces whose ids a worker holds
TOGETHER = 2000  # pieces encoded at once
TEXT_BYTES = 8 << 20
END = 0
SCHEMA = "doc_id long, part int, nth long, block int, ids array<int>"
ORC = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000",
       "orc.stripe.size": str(32 << 20), "orc.bloom.filter.columns": "doc_id",
       "orc.bloom.filter.fpp": "0.01"}
BLANK = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE = f"[{BLANK}] "
EDGE = re.compile(r"(?<=\S)(?= )")


class Pieces:
    """Ids of pieces that have been seen, one after the other, and where those of each are.

    ``lead`` stands in front of every piece. At most ``CACHED`` pieces are held; when more come,
    half of that stays, those that most chunks of texts have used. Names are an Arrow array, so
    that no piece is an object of Python.
    """

    def __init__(self, lead: str):
        self.lead = lead
        self.names = pa.array([], pa.large_string())
        self.starts, self.sizes, self.used = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.ids = np.zeros(0, dtype=np.uint32)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Place of each piece, -1 for those not held."""
        return pc.index_in(pieces, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def make_room(self, more: int) -> None:
        """Forget pieces so that ``more`` can come; all of them if need be."""
        keep = min(CACHED // 2, max(0, CACHED - more))
        places = np.argsort(-self.used, kind="stable")[:keep]
        self.ids, self.sizes = self.gather(places)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.used = self.used[places] // 2
        self.names = self.names.take(pa.array(places))

    def add(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, pieces])
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used = np.concatenate((self.used, np.zeros(len(pieces), dtype=np.int64)))
        self.ids = np.concatenate((self.ids, ids))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, and how many each has."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[places] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes


class Encoder:
    """Ids of whole texts, from ids of the pieces between single spaces, kept once seen.

    A byte-level tokenizer never merges across a space that follows another character: a text may
    be cut in front of every space whose left neighbour is no white space. The pieces of many texts
    are numbered together, the distinct ones among them are looked up, and ids are gathered by
    number, so that no step of Python is taken for a piece.
    """

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, dtype=bool)  # ids that begin with a space
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.first, self.later = Pieces(""), Pieces(" ")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(one.ids, dtype=np.uint32) for one in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fill(self, store: Pieces, needed: pa.Array) -> np.ndarray:
        """Places of distinct pieces; ids of those not held are made. Pieces after a space are encoded
        together, and told apart by the ids that begin with one, which only their first ids do."""
        lead, places = store.lead, store.find(needed)
        if len(store.names) + np.count_nonzero(places < 0) > CACHED:
            store.make_room(len(needed))
            places = store.find(needed)
        at = np.flatnonzero(places < 0)
        if not len(at):
            return places
        if lead:
            apart = pc.equal(pc.binary_length(needed), 0).to_numpy(zero_copy_only=False)[at]
        else:
            apart = np.array([p[:1] != " " or p[1:2].isspace() or p == " "
                              for p in needed.take(pa.array(at)).to_pylist()])
        alone, together = [at[apart]], at[~apart]
        order, sizes, ids = [], [], []
        if len(together):
            cuts = np.append(np.arange(0, len(together), TOGETHER), len(together))
            joined = pc.binary_join(
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), needed.take(pa.array(together))),
                pa.scalar(lead, pa.large_string()))
            for begin, end, text in zip(cuts.tolist(), cuts[1:].tolist(), joined):
                found = self.ids([lead + text.as_py()])[0]
                first = np.flatnonzero(self.spaced[found])
                if len(first) == end - begin:
                    order.append(together[begin:end])
                    sizes.append(np.diff(first, append=len(found)))
                    ids.append(found)
                else:
                    alone.append(together[begin:end])
        alone = np.concatenate(alone)
        for i in range(0, len(alone), TOGETHER):
            part = alone[i:i + TOGETHER]
            found = self.ids([lead + p for p in needed.take(pa.array(part)).to_pylist()])
            order.append(part)
            sizes.append(np.array([len(x) for x in found]))
            ids += found
        order, n = np.concatenate(order), len(store.names)
        store.add(needed.take(pa.array(order)), np.concatenate(sizes), np.concatenate(ids))
        places[order] = n + np.arange(len(order))
        return places

    def pieces(self, store: Pieces, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these pieces in a row, and how many each has."""
        coded = found.dictionary_encode()
        places = self.fill(store, coded.dictionary)
        store.used[places] += 1
        return store.gather(places[coded.indices.to_numpy()])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        kind = pa.large_string()
        texts = texts.cast(kind) if isinstance(texts, pa.Array) else pa.array(texts, kind)
        out = [None] * len(texts)
        cut = pc.match_substring_regex(texts, WIDE).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~cut).tolist()
        if plain:
            split = pc.split_pattern(texts.filter(pa.array(~cut)) if cut.any() else texts, " ")
            ends, words = split.offsets.to_numpy().astype(np.int64), split.values
            begin = np.zeros(len(words), dtype=bool)
            begin[ends[:-1]] = True
            heads, n_heads = self.pieces(self.first, words.filter(pa.array(begin)))
            rests, n_rests = self.pieces(self.later, words.filter(pa.array(~begin)))
            head_ends, rest_ends = np.cumsum(n_heads), np.concatenate(([0], np.cumsum(n_rests)))
            # words before a text, less the first ones of the texts up to it
            rest_ends = rest_ends[ends - np.arange(len(ends))].tolist()
            for k, (i, a, b) in enumerate(zip(plain, (head_ends - n_heads).tolist(), head_ends.tolist())):
                out[i] = np.concatenate((heads[a:b], rests[rest_ends[k]:rest_ends[k + 1]]))
        wide = np.flatnonzero(cut).tolist()
        if wide:
            each = [EDGE.split(texts[i].as_py()) for i in wide]
            found, sizes = self.pieces(self.first, pa.array([p for some in each for p in some], kind))
            ends = np.cumsum(sizes)[np.cumsum([len(some) for some in each]) - 1]
            for i, ids in zip(wide, np.split(found, ends[:-1])):
                out[i] = ids
        return out


def _in_rows(docs: list, part: int, first: int):
    """A record batch of documents given as (id, token ids)."""
    sizes = np.array([len(ids) for _, ids in docs], dtype=np.int64)
    rows = -(-sizes // IDS_PER_ROW)
    nth = np.repeat(np.arange(len(docs)), rows)
    block = np.arange(len(nth)) - np.repeat(np.cumsum(rows) - rows, rows)
    length = np.minimum(IDS_PER_ROW, sizes[nth] - block * IDS_PER_ROW)
    offsets = np.concatenate(([0], np.cumsum(length)))
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(
        np.concatenate([ids for _, ids in docs]).view(np.int32)))
    keys = pa.array([doc for doc, _ in docs], pa.int64())
    return pa.record_batch([
        keys.take(pa.array(nth)), pa.array(np.full(len(nth), part), pa.int32()),
        pa.array(nth + first, pa.int64()), pa.array(block, pa.int32()), ids],
        ["doc_id", "part", "nth", "block", "ids"])


def encode_rows(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Rows of ids in the order of document ids, null first; rows with one id in any order."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file, of fixed size
    name = zlib.crc32(vocabulary)

    def encode(batches):
        part, done = TaskContext.get().partitionId(), 0
        encoder = kept(("encoder", name), lambda: Encoder(shared.value))
        end = np.array([END], dtype=np.uint32)
        for batch in batches:
            for some in slices(batch, 1, TEXT_BYTES):
                ids = [np.concatenate((x, end)) for x in encoder.encode(some.column(2))]
                held = list(zip(some.column(0).to_pylist(), ids))
                yield _in_rows(held, part, done)
                done += len(held)

    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-docs.count() // ROWS_PER_FILE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("_tie"))
    return rows.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions(
        "doc_id", "_tie").select(
            "doc_id", F.octet_length("text"), "text").mapInArrow(encode, SCHEMA)


def write_ids(docs: DataFrame, vocabulary: bytes, path: str) -> None:
    """Encode every text, end it with id 0, and write ORC files; null texts have only the end."""
    encode_rows(docs, vocabulary).write.options(**ORC).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of ids; with ``doc_ids`` only these, found through indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _times(a: int, b: int) -> int:
    """Product of two polynomials over two elements, modulo the one of crc32, high bit first."""
    product = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def joined_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings in a row, from both and the length of the second."""
    shift, power, n = 1 << 31, 1 << 23, length  # x ** 0 and x ** 8
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return _times(first, shift) ^ second


def _runs(batches):
    """One row for each document that a task meets: ids counted and their crc32."""
    schema = ["doc_id", "part", "nth", "block", "n", "crc"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    run = None
    for batch in batches:
        done = []
        ids = batch.column(4)
        ends, data = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy()).cast("B")
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            held = data[int(ends[i]) * 4:int(ends[i + 1]) * 4]
            if run and run[1:3] == list(row[1:3]) and row[3] == run[6] + 1:
                run[4:] = run[4] + len(held) // 4, zlib.crc32(held, run[5]), row[3]
            else:
                done += [run[:6]] if run else []
                run = [*row, len(held) // 4, zlib.crc32(held), row[3]]
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema)
    if run:
        yield pa.record_batch([pa.array([c], k) for c, k in zip(run[:6], kinds)], schema)


def _join_runs(batches):
    for batch in batches:
        counts, sums = [], []
        for runs in batch.column(3).to_pylist():
            n, crc = 0, 0
            for r in runs:
                n, crc = n + r["n"], joined_crc(crc, r["crc"], r["n"] * 4) if n else r["crc"]
            counts.append(n)
            sums.append(crc)
        yield pa.record_batch([*batch.columns[:3], pa.array(counts, pa.int64()),
                               pa.array(sums, pa.int64())],
                              ["doc_id", "part", "nth", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    """One row for each document in the files: start, number of ids, crc32 of the ids.

    Documents that a reader's split cuts come together by their place.
    """
    runs = rows.mapInArrow(_runs, "doc_id long, part int, nth long, block int, n long, crc long")
    whole = runs.groupBy("doc_id", "part", "nth").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("runs"))
    counted = stored(whole.mapInArrow(
        _join_runs, "doc_id long, part int, nth long, n_tokens long, ids_crc32 long"), "counted")
    return with_prefix(counted, ["part", "nth"], "n_tokens").select(
        "doc_id", F.col("_before").alias("start"), "n_tokens", "ids_crc32")
