"""Quality rules: counted limits, and a calibrated classifier over hashed n-grams.

The classifier is a logistic regression on the shares of hashed words, word pairs and runs of four
bytes in a text, trained on labelled rows, calibrated on labelled rows it has not seen, and
applied in Arrow batches against a fixed threshold.
"""

from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.token_counts import chunks, slices

DIM = 1 << 15  # buckets for each of words, word pairs and byte runs
SAMPLE_ROWS = 2000  # labelled rows at most that the classifier is fitted on
HELD_OUT = 4  # one in so many of them calibrates
MIN_WORDS, MAX_REPEATED = 10, 0.2
MIN_PROBABILITY = 0.35
BLOCK = 1 << 20
WINDOW, RUN = 5, 4

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, dtype=np.uint64)
    found[:1] = 1
    return np.cumprod(found)


class Hasher:
    """64-bit hashes of words, from running sums of byte codes times powers of an odd number."""

    def __init__(self):
        self.codes = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.size = 0

    def __call__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of ``data[first:last]`` for each pair."""
        parts, at = [], 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(last, first[at] + BLOCK, "right")))
            begin, end = int(first[at]), int(last[to - 1])
            if end - begin >= self.size:  # an empty word may start at the end
                self.size = max(BLOCK, end - begin) + 1
                self.up = _powers(STEP, self.size)
                self.down = _powers(pow(STEP, -1, 1 << 64), self.size)
            sums = np.zeros(end - begin + 1, dtype=np.uint64)
            np.cumsum(self.codes[data[begin:end]] * self.up[:end - begin], out=sums[1:])
            a, b = first[at:to] - begin, last[at:to] - begin
            h = (sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * MIX
            parts.append(h ^ (h >> np.uint64(29)))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


class Texts:
    """Words of a chunk of texts: their places, documents and hashes."""

    def __init__(self, raw: list[bytes], hasher: Hasher):
        self.raw = raw
        self.data = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in self.raw])
        self.starts = self.ends - [len(t) for t in self.raw]
        self.space = SPACE[self.data]
        edge = np.ones(len(self.data) + 1, dtype=bool)  # a word can't go on from the left
        edge[1:] = np.append(self.space, True)[:len(self.data)]
        edge[self.starts] = True
        first = np.flatnonzero(edge[:-1] & ~self.space)
        stop = np.ones(len(self.data) + 1, dtype=bool)  # a word can't go on to here
        stop[:-1] = self.space
        stop[self.starts] = True
        last = np.flatnonzero(stop[1:] & ~self.space) + 1
        self.hashes = hasher(self.data, first, last)
        self.doc = self.owner(first)
        self.n_words = np.bincount(self.doc, minlength=len(raw))
        self.same = self.doc[:-1] == self.doc[1:]

    @cached_property
    def pairs(self) -> np.ndarray:
        """Hashes of pairs of words; those across two documents are not ``same``."""
        pair = self.hashes[:-1] * np.uint64(0xBF58476D1CE4E5B9) + self.hashes[1:]
        pair = (pair ^ (pair >> np.uint64(30))) * MIX
        return pair ^ (pair >> np.uint64(27))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Documents that hold these bytes."""
        return np.searchsorted(self.starts, at, "right") - 1

    def base(self) -> list[np.ndarray]:
        """The counted columns, in the order of ``BASE``."""
        n = len(self.raw)
        letters = ~self.space & ((self.data & 0xC0) != 0x80)
        chars = [np.count_nonzero(letters[a:b]) for a, b in zip(self.starts, self.ends)]
        symbols = np.bincount(self.owner(np.flatnonzero(SYMBOL[self.data])), minlength=n)
        lines = np.zeros(n, dtype=np.int64)
        for i, text in enumerate(self.raw):
            if b"\n" in text:
                filled = [x for x in text.split(b"\n") if x and not x.isspace()]
                lines[i] = len(filled) - len(set(filled))
        return [self.n_words, np.array(chars, dtype=np.int64), symbols, lines, self.repeated()]

    def repeated(self) -> np.ndarray:
        """Words inside windows that the document holds more than once."""
        h, m = self.hashes, len(self.hashes) - WINDOW + 1
        covered = np.zeros(len(h), dtype=bool)
        if m > 0:
            key = self.doc[:m].astype(np.uint64) * MIX
            for i in range(WINDOW):
                key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + h[i:m + i]
            inside = np.flatnonzero(self.doc[:m] == self.doc[WINDOW - 1:])
            key = key[inside]
            ordered = np.sort(key)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                twice = np.unique(twice)
                at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
                found = inside[twice[at] == key]
                for i in range(WINDOW):
                    covered[found + i] = True
        return np.bincount(self.doc[covered], minlength=len(self.raw))

    def runs(self, begin: int, end: int) -> np.ndarray:
        """Buckets of the runs of four bytes that start in this range, across documents too."""
        stop = min(end, len(self.data) - RUN + 1)
        if stop <= begin:
            return np.zeros(0, dtype=np.uint32)
        code = np.zeros(stop - begin, dtype=np.uint32)
        for i in range(RUN):
            code |= self.data[begin + i:stop + i].astype(np.uint32) << np.uint32(8 * i)
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(17)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum over the three kinds of n-gram of their mean weight in each text."""
        n, total = len(self.raw), np.zeros(len(self.raw))
        kinds = ((self.hashes, np.ones(len(self.hashes), dtype=bool), 0), (self.pairs, self.same, 1))
        for hashes, valid, kind in kinds:
            doc = self.doc[:len(hashes)][valid]
            found = weights[kind * DIM + (hashes[valid] >> np.uint64(49)).astype(np.int64)]
            times = np.bincount(doc, minlength=n)
            total += np.bincount(doc, weights=found, minlength=n) / np.maximum(times, 1)
        length = np.maximum(self.ends - self.starts - RUN + 1, 0)
        sums = np.zeros(n)
        for begin in range(0, len(self.data), BLOCK):
            found = weights[2 * DIM + self.runs(begin, begin + BLOCK).astype(np.int64)]
            before = np.concatenate(([0.0], np.cumsum(found, dtype=np.float64)))
            a = np.clip(self.starts - begin, 0, len(found))
            b = np.clip(self.starts + length - begin, 0, len(found))
            sums += before[b] - before[a]
        return total + sums / np.maximum(length, 1)

    def features(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their shares for one text."""
        own = self.doc == i
        pairs = self.pairs[self.same & own[:-1]] if len(own) else self.pairs
        length = max(int(self.ends[i] - self.starts[i]) - RUN + 1, 0)
        runs = self.runs(int(self.starts[i]), int(self.starts[i]) + length)
        at, share = [], []
        for kind, found in enumerate((self.hashes[own] >> np.uint64(49), pairs >> np.uint64(49), runs)):
            bucket, times = np.unique(found, return_counts=True)
            at.append(bucket.astype(np.int64) + kind * DIM)
            share.append(times / max(len(found), 1))
        return np.concatenate(at), np.concatenate(share)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, scores: np.ndarray) -> np.ndarray:
        """Calibrated probability of a good text."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (scores + self.bias) + self.offset, -60, 60)))


#: What is taken to be good without labels of both kinds to learn from.
EVERYTHING = Model(np.zeros(3 * DIM, dtype=np.float32), 0.0, 0.0, 60.0)


def _calibrate(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method on smoothed targets."""
    n1, n0 = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([scores, np.ones(len(scores))])
    both = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ x, -60, 60)))
        slope = x @ (p - target) + 1e-3 * both
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)) @ x.T + 1e-3 * np.eye(2), slope)
        both = both - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(both[0]), float(both[1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150) -> Model:
    """A model from (buckets, shares, good) of labelled texts, whose numbers may be narrow ones: what
    is made of them is as wide as ever."""
    good = np.array([r[2] for r in rows], dtype=np.float64)
    held = np.arange(len(rows)) % HELD_OUT == HELD_OUT - 1
    if min(good[held].sum(), (1 - good[held]).sum(), good[~held].sum(), (1 - good[~held]).sum()) < 1:
        return EVERYTHING
    train = np.flatnonzero(~held)
    at = np.concatenate([rows[i][0] for i in train])
    share = np.concatenate([rows[i][1] for i in train])
    row = np.repeat(np.arange(len(train), dtype=np.int32), [len(rows[i][0]) for i in train])
    y, n = good[train], len(train)
    each = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))  # both kinds count alike
    weights, bias = np.zeros(3 * DIM), 0.0
    seen, seen_bias = np.full(3 * DIM, 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(row, weights=weights[at] * share, minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * each / n
        slope = np.bincount(at, weights=share * error[row], minlength=3 * DIM) + 1e-7 * weights
        seen += slope * slope
        weights -= 0.5 * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    weights = weights.astype(np.float32)
    scores = np.array([(weights[rows[i][0]] * rows[i][1].astype(np.float64)).sum() for i in np.flatnonzero(held)])
    return Model(weights, bias, *_calibrate(scores + bias, good[held]))


def _features(batches):
    hasher = Hasher()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i, text in enumerate(texts):
            at, share = Texts([text.encode()], hasher).features(0)
            yield pa.record_batch([
                batch.column(0).slice(i, 1), batch.column(1).slice(i, 1),
                pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                pa.array([share.astype(np.float32).tobytes()], pa.binary())],
                ["doc_id", "good", "at", "share"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled texts: ``sample_rows`` of them at most, the first by a hash of the id.

    An id labelled more than once counts with its worst label, of rows that share an id the one
    whose text hashes lowest; labels without a document, and null ids and labels, are left out.
    Without both kinds of label every text is taken as good.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids and labels
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = rows.mapInArrow(_features, "doc_id long, good int, at binary, share binary")
    found = [(r.doc_id * 0x9E3779B1 % (1 << 32), bytes(r.at), bytes(r.share), int(r.good > 0))
             for r in found.collect()]
    found.sort(key=lambda r: r[:3])
    return fit([(np.frombuffer(at, np.int32), np.frombuffer(share, np.float32), good)
                for _, at, share, good in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, the columns of ``BASE``, probability), one for each row of ``docs``.

    Null and empty texts count nothing.
    """
    # 3 * DIM numbers, as a plain tuple: a worker need not know this package
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def scored(batches):
        hasher, model = Hasher(), Model(*shared.value)
        for ids, _, texts in chunks(batches, BLOCK):
            found = Texts([t.encode() for t in texts], hasher)
            probability = model.probability(found.scores(model.weights))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in found.base()],
                 pa.array(probability, pa.float64())],
                ["doc_id", *[c.split()[0] for c in BASE.split(", ")], "probability"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("_size"), text.alias("text")).mapInArrow(
        scored, f"doc_id long, {BASE}, probability double")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = MIN_PROBABILITY,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counted columns, ``base_failed``, ``probability`` and ``kept`` of every document."""
    scored = score(docs, train(docs, labels, sample_rows)).withColumn("base_failed", base_failed())
    return scored.withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = MIN_PROBABILITY,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, without moving any."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(train(docs, labels, sample_rows)))
    at, n = docs.columns.index("text"), len(docs.columns)
    # columns go by number, since names may hold dots
    numbered = [f"c{i}" for i in range(n)]

    def good(batches):
        hasher, model = Hasher(), Model(*shared.value)
        for batch in batches:
            for part in slices(batch, n, BLOCK):
                found = Texts([(t or "").encode() for t in part.column(at).to_pylist()], hasher)
                words, repeated = found.n_words, found.repeated()
                chance = model.probability(found.scores(model.weights))
                kept = (words >= MIN_WORDS) & (100 * repeated <= int(100 * MAX_REPEATED) * words) \
                    & (chance >= threshold)
                yield pa.record_batch(part.columns[:n], numbered).filter(pa.array(kept))

    sized = docs.select("*", F.coalesce(F.octet_length("text"), F.lit(0)))
    return sized.toDF(*numbered, "size").mapInArrow(
        good, docs.toDF(*numbered).schema).toDF(*docs.columns)
