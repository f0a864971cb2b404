"""Removal of byte strings that occur more than once, by sorting suffixes.

Two equal strings of ``LENGTH`` bytes have to meet without sorting every suffix of the corpus.

1. Every window of ``LENGTH`` bytes has an anchor, the place of the least hash of ``GRAM`` bytes
   in it; equal windows have equal anchors at equal places. Windows whose anchor's hash is found
   nowhere else cannot repeat, and only the others go on: the windows of one anchor, as one
   stretch of text, dealt out by the anchor's hash.
2. Windows at about the same distance from their anchor share the bytes in their middle. Where
   these are unique, nothing repeats; where not, one symbol takes their place, which leaves short
   strings: some bytes, the symbol, some bytes.
3. These strings are sorted by the difference-cover method: the suffixes at two of three places by
   triples of symbols, by the names of triples again while these tie, then the others by their
   first symbol and the suffix after it, and both are merged. Windows whose neighbours in the order
   begin with as many equal symbols as a window has occur elsewhere.

Anchors that very many stretches share would make a large group; their windows are counted one by
one instead, by 128 bits of hash, in an aggregation that combines before it shuffles.
"""

import hashlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm.bloom import build, may_hold
from newsmill.llm.quality import Hasher
from newsmill.session import stored

LENGTH = 200
GRAM = 32
CELL = 24  # windows that share a middle
HOT = 50_000  # stretches of an anchor from which its windows are counted one by one
BLOCK = 1 << 22  # bytes of a text looked at together
SORTED = 1 << 21  # bytes of stretches sorted together, or one anchor's
SEEN = 200_000
CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _rolling(data: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes from each place on, made of halves."""
    if length == 1:
        return CODES[data] + np.uint64(salt)
    half = length // 2
    part = _rolling(data, half, salt)
    found = part[:len(part) - half] * np.uint64(0xD6E8FEB86659FD93 + 2 * length) + part[half:]
    found ^= found >> np.uint64(29)
    if length % 2:
        found = found[:-1] * np.uint64(0x94D049BB133111EB) + CODES[data[length - 1:]]
        found ^= found >> np.uint64(31)
    return found


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key in each run of ``width`` places."""
    reach = 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    return np.minimum(keys[:len(keys) - (width - reach)], keys[width - reach:])


def stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor place, first and last window of each stretch of a text."""
    parts = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        block = data[begin:begin + BLOCK + LENGTH - 1]
        hashes = _rolling(block, GRAM)
        keys = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(keys, LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        parts.append((hashes[at[first]].view(np.int64), at[first] + begin, first + begin,
                      last + begin))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _anchors(batches):
    """Rows (anchor, n): anchors of each text, with the number of their stretches."""
    for batch in batches:
        found, times, size = [], [], 0
        for text in batch.column(0).to_pylist():
            anchors, n = np.unique(stretches(np.frombuffer(text.encode(), np.uint8))[0],
                                   return_counts=True)
            found.append(anchors)
            times.append(n)
        if found:
            yield pa.record_batch([pa.array(np.concatenate(found), pa.int64()),
                                   pa.array(np.concatenate(times), pa.int64())], ["anchor", "n"])


STRETCH = "k1 long, k2 long, first long, n int, anchor long, before int, bytes binary"


def _stretches(repeated, hot):
    """Stretches whose anchor may be found elsewhere.

    Of equal stretches in a task one is sent on. The others are repeats already, and so is that
    one; they come as rows without bytes, which say that all their windows are repeated.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def find(batches):
        seen: dict[bytes, list] = {}
        for batch in batches:
            rows, size = [], 0
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                anchors, at, first, last = stretches(np.frombuffer(raw, np.uint8))
                if not len(anchors):
                    continue
                some = may_hold(repeated.value, anchors)
                if hot is not None:
                    some &= ~may_hold(hot.value, anchors)
                for i in np.flatnonzero(some).tolist():
                    a, b, anchor = int(first[i]), int(last[i]) + 1, int(anchors[i])
                    before, part = int(at[i]) - a, raw[a:b + LENGTH - 1]
                    name = blake2b(part, digest_size=16, salt=before.to_bytes(2, "little")).digest()
                    row = [k1, k2, a, b - a, anchor, before, part]
                    met = seen.get(name)
                    if met is None:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[name] = row[:4]
                        rows.append(row)
                        size += len(part)
                    else:
                        rows.append([*row[:4], None, None, None])
                        if met:
                            rows.append([*met, None, None, None])
                            seen[name] = []
                if size > BLOCK:
                    yield _batch(rows, kinds, STRETCH)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds, STRETCH)

    return find


def _batch(rows: list, kinds: list, schema: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                           [c.split()[0] for c in schema.split(", ")])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of positive numbers, by the difference cover {1, 2} of 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    symbols = np.concatenate((np.unique(text, return_inverse=True)[1] + 1, np.zeros(3, np.int64)))
    base = int(symbols.max()) + 1
    places = np.arange(n + (n % 3 == 1))
    sampled = np.concatenate((places[places % 3 == 1], places[places % 3 == 2]))
    # triples by their first two symbols, named, and the third
    pair = np.unique(symbols[sampled] * base + symbols[sampled + 1], return_inverse=True)[1]
    names, found = np.unique(pair * base + symbols[sampled + 2], return_inverse=True)
    order = np.argsort(found, kind="stable") if len(names) == len(sampled) \
        else suffix_array(found + 1)
    sampled_order = sampled[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled_order] = np.arange(1, len(sampled_order) + 1)
    sampled_order = sampled_order[sampled_order < n]
    size = n + 3
    rest = places[(places % 3 == 0) & (places < n)]
    key = symbols[rest] * size + rank[rest + 1]
    turn = np.argsort(key, kind="stable")
    rest, key = rest[turn], key[turn]
    # a remaining suffix goes after the sampled ones below it, counted for both kinds of these
    one = sampled_order[sampled_order % 3 == 1]
    below = np.searchsorted(symbols[one] * size + rank[one + 1], key)
    two = sampled_order[sampled_order % 3 == 2]
    pairs = np.unique(np.concatenate((symbols[two] * base + symbols[two + 1],
                                      symbols[rest] * base + symbols[rest + 1])),
                      return_inverse=True)[1]
    below = below + np.searchsorted(pairs[:len(two)] * size + rank[two + 2],
                                    pairs[len(two):] * size + rank[rest + 2])
    merged = np.empty(n, dtype=np.int64)
    at = below + np.arange(len(rest))
    merged[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    merged[free] = sampled_order
    return merged


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from each ``first`` up to each ``last``."""
    size = np.maximum(last - first, 0)
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _same(*columns: np.ndarray) -> np.ndarray:
    """A number for each different row."""
    found = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        value = np.unique(c, return_inverse=True)[1]
        found = np.unique(found * (int(value.max(initial=0)) + 1) + value, return_inverse=True)[1]
    return found


def repeats(anchors: np.ndarray, before: np.ndarray, n: np.ndarray, parts: list[bytes],
            hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of stretches: the stretch, the first window in it and how many follow.

    ``before`` is how far the anchor lies behind the first of ``n`` windows. Windows of a stretch
    are cut into cells by their distance from the anchor.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    start = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
    cells = LENGTH // CELL + 1
    # the first window of a stretch is at offset 0 and the anchor's at ``before``
    low, high = cells * CELL - before, cells * CELL - before + n
    each = high // CELL - low // CELL + (high % CELL > 0)
    row = np.repeat(np.arange(len(parts)), each)
    cell = _ranges(low // CELL, low // CELL + each)
    a = np.maximum(low[row], cell * CELL)  # windows of the stretch in the cell
    b = np.minimum(high[row], (cell + 1) * CELL)
    zero = start[row] - low[row]  # where the window at offset 0 would start
    middle = zero + (cell + 1) * CELL - 1
    end = zero + cell * CELL + LENGTH
    shared = _same(anchors[row], cell, hasher(data, middle, end).view(np.int64))
    some = np.bincount(shared)[shared] > 1
    if not some.any():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    row, cell, a, b, zero, middle, end, shared = (
        x[some] for x in (row, cell, a, b, zero, middle, end, shared))
    left, right = zero + a, zero + b - 1 + LENGTH
    # equal strings are one, with a count
    whole = _same(shared, a, b, hasher(data, left, middle).view(np.int64),
                  hasher(data, end, right).view(np.int64))
    times = np.bincount(whole)
    one = np.unique(whole, return_index=True)[1]
    sizes = (middle - left + 1 + right - end)[one]
    head = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(int((sizes + 1).sum()), dtype=np.int64)
    text[_ranges(head, head + (middle - left)[one])] = 1 + data[_ranges(left[one], middle[one])]
    text[head + (middle - left)[one]] = 257 + shared[one]
    text[_ranges(head + sizes - (right - end)[one], head + sizes)] = 1 + data[
        _ranges(end[one], right[one])]
    text[head + sizes] = 257 + int(shared.max()) + 1 + np.arange(len(one))  # no two alike
    order = suffix_array(text)
    # neighbours in the order that begin with a window's worth of equal symbols
    padded = np.concatenate((text, -np.arange(1, CELL + 1)))
    equal, x, y = np.ones(len(order) - 1, dtype=bool), order[:-1], order[1:]
    for i in range(CELL):
        at = np.flatnonzero(equal)
        equal[at] = padded[x[at] + i] == padded[y[at] + i]
    again = np.zeros(len(text), dtype=bool)
    again[x[equal]] = True
    again[y[equal]] = True
    # every string of a cell looks its windows up
    width = b - a
    window = _ranges(a, b)
    owner = np.repeat(np.arange(len(row)), width)
    inside = again[head[whole[owner]] + window - a[owner]] | (times[whole[owner]] > 1)
    return row[owner][inside], (window - low[row[owner]])[inside], np.ones(int(inside.sum()), np.int64)


FOUND = "k1 long, k2 long, first long, n int"


def _sorted(batches):
    """Stretches in the order of anchors -> ranges of repeated windows of each text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    hasher, held, size = Hasher(), [], 0

    def ranges():
        columns = list(zip(*held))
        row, at, _ = repeats(np.array(columns[4]), np.array(columns[5], dtype=np.int64),
                             np.array(columns[3], dtype=np.int64), columns[6], hasher)
        if not len(row):
            return None
        turn = np.lexsort((at, row))
        row, at = row[turn], at[turn]
        cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))))
        row, at, n = row[cut], at[cut], np.diff(np.append(cut, len(row)))
        first = np.array(columns[2])[row] + at
        return pa.record_batch([pa.array(c, k) for c, k in zip(
            (np.array(columns[0])[row], np.array(columns[1])[row], first, n), kinds)],
            [c.split()[0] for c in FOUND.split(", ")])

    for batch in batches:
        told = batch.filter(batch.column(6).is_null())
        if told.num_rows:
            yield told.select([0, 1, 2, 3])
        kept = batch.filter(batch.column(6).is_valid())
        for row in zip(*(c.to_pylist() for c in kept.columns)):
            if size > SORTED and held[-1][4] != row[4]:
                found = ranges()
                if found:
                    yield found
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        found = ranges()
        if found:
            yield found


def _windows(hot):
    """Windows of hot anchors: rows (h1, h2, k1, k2, first)."""
    def find(batches):
        for batch in batches:
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(text.encode(), np.uint8)
                anchors, _, first, last = stretches(data)
                some = np.flatnonzero(may_hold(hot.value, anchors))
                if not len(some):
                    continue
                for begin in range(0, len(some), 1 << 13):
                    part = some[begin:begin + (1 << 13)]
                    a, b = int(first[part[0]]), int(last[part[-1]]) + LENGTH
                    at = _ranges(first[part], last[part] + 1)
                    one = _rolling(data[a:b], LENGTH)[at - a]
                    two = _rolling(data[a:b], LENGTH, 0x5851F42D4C957F2D)[at - a]
                    yield pa.record_batch([
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                        pa.array(np.full(len(at), k1), pa.int64()),
                        pa.array(np.full(len(at), k2), pa.int64()), pa.array(at)],
                        ["h1", "h2", "k1", "k2", "first"])

    return find


def _cut(batches):
    """Texts with the ranges of their repeated windows -> what is removed and what stays."""
    for batch in batches:
        done = []
        for doc, text, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            change = np.zeros(len(raw) + 1, dtype=np.int32)
            for r in ranges or ():
                change[r["first"]] += 1
                change[r["first"] + r["n"] - 1 + LENGTH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            done.append((doc, len(raw), int(gone.sum()), len(edge) // 2,
                         hashlib.sha256(kept).hexdigest(), edge.tolist()))
        if done:
            yield _batch(done, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                                pa.list_(pa.int64())], CUT)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row for each document: bytes, removed bytes and runs, digest of the rest, the runs.

    A byte goes when a string of ``LENGTH`` bytes around it starts at any other place too, in this
    or another document; all strings are judged on the texts as given. Repeated rows are documents
    of their own, so equal texts of ``LENGTH`` bytes lose all. Null and empty texts lose nothing.
    Runs are (start, end) in bytes, ends exclusive, one after the other.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"),
                       F.xxhash64("text").alias("k2"), "text")
    keyed = rows.select("k1", "k2", "text")
    anchors = stored(rows.select("text").mapInArrow(_anchors, "anchor long, n long").groupBy(
        "anchor").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    repeated = spark.sparkContext.broadcast(build(anchors.select("anchor")))  # of fixed size
    crowded = anchors.filter(F.col("n") >= hot).select("anchor")
    many = None if crowded.isEmpty() else spark.sparkContext.broadcast(build(crowded))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.mapInArrow(_stretches(repeated, many), STRETCH).repartition(
        parts, "anchor", F.when(F.col("anchor").isNull(), F.hash("k1", "first"))).sortWithinPartitions(
            "anchor").mapInArrow(_sorted, FOUND)
    if many is not None:
        windows = stored(keyed.mapInArrow(
            _windows(many), "h1 long, h2 long, k1 long, k2 long, first long"), "windows")
        twice = windows.groupBy("h1", "h2").count().filter("count > 1").drop("count")
        found = found.union(windows.join(twice, ["h1", "h2"]).select(
            "k1", "k2", "first", F.lit(1).alias("n")))
    ranges = found.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("first", "n")).alias("ranges"))
    return rows.join(ranges.hint("merge"), ["k1", "k2"], "left").select(
        "doc_id", "text", "ranges").mapInArrow(_cut, CUT)
