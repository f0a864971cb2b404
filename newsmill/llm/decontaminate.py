"""Benchmark passages in training documents, found with an FM-index for each training shard.

A shard is a run of documents inside one task, of bounded size. Its words become numbers of the
benchmark's vocabulary, the sequence is indexed (suffix array, Burrows-Wheeler transform in a
wavelet matrix, sampled suffix positions), all test phrases are searched backwards at once, and
their places are merged into removal spans. Nothing is shuffled. Words that cannot be part of any
phrase, since their neighbourhood holds no run of phrase n-grams long enough, are left out of the
index.
"""

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm.token_counts import slices

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 500_000  # benchmark words searched for at a time
SAMPLE = 16  # every so many suffix positions are kept
GRAM = 3

KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
             for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(KEPT).split()


class Phrases(NamedTuple):
    """A block of the benchmark: vocabulary, windows by length, and the items they come from."""
    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]  # one matrix of word numbers for each length
    owners: list[list[tuple]]  # items of each row, in the order of the windows
    grams: np.ndarray  # sorted keys of the n-grams in the windows
    gram: int
    least: int  # words of the shortest window


def _gram_keys(codes: np.ndarray, gram: int, base: int) -> np.ndarray:
    """A key for the n-gram at each place; 0 where a word is unknown."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for i in range(gram):
        key = key * base + codes[i:n + i]
        known &= codes[i:n + i] > 0
    return np.where(known, key, 0)


def phrases(items: list[tuple]) -> Phrases:
    """Windows of (item id, words); items without words are left out."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple, set] = {}
    for item, words in items:
        codes = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        size = min(WINDOW, len(codes))
        for i in range(len(codes) - size + 1 if size else 0):
            found.setdefault(tuple(codes[i:i + size]), set()).add(item)
    by_size: dict[int, list] = {}
    for window in found:
        by_size.setdefault(len(window), []).append(window)
    sizes = sorted(by_size)
    gram = min([GRAM, *sizes])
    windows = [np.array(by_size[s], dtype=np.int64) for s in sizes]
    base = len(vocabulary) + 1
    grams = [_gram_keys(w[:, i:i + gram].reshape(-1), gram, base)[::gram]
             for w in windows for i in range(w.shape[1] - gram + 1)]
    return Phrases(
        vocabulary, windows,
        [[tuple(i for i in found[w] if i is not None) for w in by_size[s]] for s in sizes],
        np.unique(np.concatenate(grams)) if grams else np.zeros(0, dtype=np.int64), gram,
        min(sizes, default=0))


def blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words, or one longer item."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row.text or "")
        if held and size + len(words) > BLOCK_WORDS:
            yield phrases(held)
            held, size = [], 0
        held.append((row.item_id, words))
        size += len(words)
    if size:
        yield phrases(held)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the length they are sorted by."""
    n, step = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class Index:
    """FM-index of a sequence of numbers from 1 to ``size`` - 1; a final 0 closes it."""

    def __init__(self, codes: np.ndarray, size: int):
        codes = np.append(codes, 0)
        order = suffix_array(codes)
        self.n = len(codes)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=size))))
        self.last = codes[order - 1]  # the code before each suffix, in suffix order
        self.sampled = order % SAMPLE == 0
        self.before = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]
        self.levels = []
        level = self.last
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (level >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))), int((~ones).sum())))
            level = np.concatenate((level[~ones], level[ones]))

    def rank(self, code: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each code stands in front of the first ``end`` suffixes."""
        begin, end = np.zeros(len(code), dtype=np.int64), end
        for bit, ones, zeros in self.levels:
            high = code >> bit & 1 == 1
            begin = np.where(high, zeros + ones[begin], begin - ones[begin])
            end = np.where(high, zeros + ones[end], end - ones[end])
        return end - begin

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which rows of ``windows`` occur, and which row it is."""
        rows = np.arange(len(windows))
        low = np.zeros(len(rows), dtype=np.int64)
        high = np.full(len(rows), self.n, dtype=np.int64)
        for column in reversed(range(windows.shape[1])):
            code = windows[rows, column]
            low = self.first[code] + self.rank(code, low)
            high = self.first[code] + self.rank(code, high)
            alive = low < high
            rows, low, high = rows[alive], low[alive], high[alive]
        times = high - low
        each = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        return self.locate(each), np.repeat(rows, times)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back to a sampled one, plus what that one says."""
        found, steps = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        left = np.arange(len(at))
        while len(left):
            known = self.sampled[at[left]]
            done = left[known]
            found[done] = self.places[self.before[at[done]]] + steps[done]
            left = left[~known]
            code = self.last[at[left]]
            at[left] = self.first[code] + self.rank(code, at[left])
            steps[left] += 1
        return found


def _search(docs: list[list[bytes]], block: Phrases) -> tuple[np.ndarray, ...]:
    """Occurrences in a shard: document, first word, words, kind of window, row of the window."""
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.fromiter((block.vocabulary.get(w, 0) for d in docs for w in d), np.int64,
                        count=int(lengths.sum()))
    keys = _gram_keys(codes, block.gram, len(block.vocabulary) + 1)
    at = np.flatnonzero(keys)
    place = np.minimum(np.searchsorted(block.grams, keys[at]), len(block.grams) - 1)
    at = at[block.grams[place] == keys[at]]
    owner = np.searchsorted(starts, at, "right") - 1
    inside = at + block.gram <= starts[owner] + lengths[owner]
    at, owner = at[inside], owner[inside]
    if not len(at):
        return empty
    # runs of n-grams that follow each other inside one document, long enough for a window
    cut = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner) != 0)))
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(at)))
    enough = size >= block.least - block.gram + 1
    begin, size = at[begin[enough]], size[enough] + block.gram - 1
    if not len(begin):
        return empty
    # the indexed sequence: 1, the words of a run, 1, the words of the next, and so on; words
    # are their numbers and one more
    total = int((size + 1).sum())
    head = np.cumsum(size + 1) - size - 1
    origin = np.arange(total) - np.repeat(head, size + 1) - 1 + np.repeat(begin, size + 1)
    sequence = codes[np.maximum(origin, 0)] + 1
    sequence[head] = 1
    index = Index(sequence, len(block.vocabulary) + 2)
    found = []
    for kind, windows in enumerate(block.windows):
        places, rows = index.search(windows + 1)
        word = origin[places]
        doc = np.searchsorted(starts, word, "right") - 1
        found.append((doc, word - starts[doc], np.full(len(doc), windows.shape[1]),
                      np.full(len(doc), kind), rows))
    return tuple(np.concatenate(c) for c in zip(*found))


def shard_hits(texts: list[str], parts: list[Phrases]) -> list[tuple[int, list, list]]:
    """Of each text: its number of words, merged spans of hit words, and ids of the items hit."""
    docs = [words_of(t) for t in texts]
    spans = [[] for _ in docs]
    items = [set() for _ in docs]
    for block in parts:
        for doc, first, size, kind, row in zip(*(c.tolist() for c in _search(docs, block))):
            spans[doc].append((first, first + size))
            items[doc].update(block.owners[kind][row])
    merged = []
    for own in spans:
        joined = []
        for first, last in sorted(own):
            if joined and first <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], last)
            else:
                joined.append([first, last])
        merged.append(joined)
    return [(len(d), m, sorted(map(str, i))) for d, m, i in zip(docs, merged, items)]


def _shared(docs: DataFrame, benchmark: DataFrame) -> list:
    """The query set in blocks of bounded size, as plain tuples: a worker need not know this package."""
    return [docs.sparkSession.sparkContext.broadcast(tuple(b)) for b in blocks(benchmark)]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: words, hit words, items, their digest, spans of hit words.

    A word is hit when it lies in a window of ``WINDOW`` consecutive words of an item, or in the
    whole of a shorter item. Null and empty texts have no words; items without words find
    nothing; an item whose id is null marks words but isn't named; an id given twice is one item.
    Span ends are exclusive, in words.
    """
    parts = _shared(docs, benchmark)

    def scan(batches):
        for batch in batches:
            for shard in slices(batch, 1, SHARD_BYTES):
                found = shard_hits(shard.column(2).to_pylist(), [Phrases(*p.value) for p in parts])
                hit = [sum(b - a for a, b in spans) for _, spans, _ in found]
                yield pa.record_batch([
                    shard.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array(hit, pa.int64()), pa.array([len(i) for _, _, i in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest()
                              for _, _, i in found], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                    pa.array([[x for s in spans for x in s] for _, spans, _ in found],
                             pa.list_(pa.int64()))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
                     "spans"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).alias("_size"),
        text.alias("text")).mapInArrow(
            scan, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
                  "contaminated boolean, spans array<long>")


def _without(text: str, spans: list) -> str:
    """The text without these spans of words, from the first letter to the last."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.translate(KEPT))]
    done, kept = 0, []
    for first, last in spans:
        kept.append(raw[done:places[first][0]])
        done = places[last - 1][1]
    return b"".join([*kept, raw[done:]]).decode()


def remove_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without their hit words; ``n_chars``, if there, follows the text.

    A document that had words and has none left goes. Other rows and columns stay as they are.
    """
    parts = _shared(docs, benchmark)
    names = docs.columns
    n, at = len(names), names.index("text")
    numbered = [f"c{i}" for i in range(n)]  # columns go by number, since names may hold dots

    def clean(batches):
        for batch in batches:
            for shard in slices(batch, n, SHARD_BYTES):
                texts = shard.column(at).to_pylist()
                found = shard_hits([t or "" for t in texts], [Phrases(*p.value) for p in parts])
                gone = [bool(w) and sum(b - a for a, b in spans) == w for w, spans, _ in found]
                texts = [_without(t, spans) if spans else t
                         for t, (_, spans, _) in zip(texts, found)]
                columns = [pa.array(texts, pa.string()) if i == at else shard.column(i)
                           for i in range(n)]
                cleaned = pa.record_batch(columns, numbered)
                yield cleaned.filter(pa.array([not g for g in gone], pa.bool_()))

    sized = docs.select("*", F.coalesce(F.octet_length("text"), F.lit(0)))
    rows = sized.toDF(*numbered, "size").mapInArrow(clean, docs.toDF(*numbered).schema).toDF(*names)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in names else rows
