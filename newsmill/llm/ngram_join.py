"""Similarity join on word shingles by the overlap of count vectors.

Shingles are hashed, and hashes fall into groups. How many shingles of a text fall into each group
makes a point; two texts share at most the sum over groups of the smaller count. Points are kept
in an R-tree whose nodes know the largest counts below them, so that the same bound skips whole
subtrees; pairs it does not rule out are verified on their sets.

One tree over a corpus would prune little, for large nodes bound nothing. So the points are first
dealt out without losing a pair: two linked texts differ in so few shingles that, with one more
group than that, the contents of some group are the same in both. A text is listed under the
contents of each of its groups, for the classes of sizes it can be linked in. Points listed together
are compared by the bound, those it allows are connected, and each connected group of texts becomes
one tree, whose pairs are verified.
"""

from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm.bloom import build, may_hold
from newsmill.llm.components import components
from newsmill.llm.quality import MIX, Hasher, Texts
from newsmill.llm.token_counts import chunks
from newsmill.session import forget, passing, stored

WORDS = 4  # of a shingle, unless a caller asks for others
SHARE = 85  # linked from this percentage of common shingles; above 100 / CLASS
CLASS = 1.6  # ratio of the sizes in one class
GROUPS = 256  # coordinates of a point
SKETCH = 128  # of the points that candidates are compared by
FINE = 1024  # of the points that tell long sets of large groups apart
LEAF = 256
SHORT = 16  # of the lists whose pairs are all compared by their points
PAIRS = 1 << 14  # of points that are compared at once
TREE, TREE_BYTES = 4000, 64 << 20  # of the sets in one tree; more are joined in parts
PART, PART_BYTES = 2000, 32 << 20
PIVOTS, SHARES = 2048, 64  # pivots of a group in one round, and how many windows choose them
SEEN = 20_000
BROADCAST_ROWS = 500_000  # of four numbers each
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str], hasher: Hasher, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; of all its words if they are fewer."""
    found = Texts([t.encode().translate(LOWER) for t in texts], hasher)
    ends = np.cumsum(found.n_words)
    h, n = found.hashes, len(found.hashes) - words + 1
    key = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(words if n > 0 else 0):
        key = _mixed(key * MIX + h[i:n + i] + np.uint64(i))
    sets = []
    for end, size in zip(ends.tolist(), found.n_words.tolist()):
        if size >= words:
            own = np.sort(key[end - size:end - words + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            whole = np.full(1, 77 + size, dtype=np.uint64)
            for word in h[end - size:end]:
                whole = _mixed(whole * MIX + word)
            sets.append(whole[:min(size, 1)])
    return sets


def _classes(size: int, share: int) -> list[tuple[int, int, int]]:
    """Size classes a set is listed in: number, groups, and the most shingles a pair differs in.

    Classes are ranges of sizes. A pair across classes meets in the lower one: a set is listed in
    its own class, and in the next lower one if that has sizes it can be linked with. Linked sets
    of sizes m and n differ in (m + n) (1 - t) / (1 + t) shingles at most.
    """
    def first(k):  # least size of class k
        return int(np.ceil(CLASS ** k))

    k = 0
    while first(k + 1) <= size:
        k += 1
    found = []
    for c in (k, k - 1):
        largest = first(c + 1) - 1
        if c < 0 or (c < k and 100 * largest < share * size):
            continue
        differ = (largest + largest * 100 // share) * (100 - share) // (100 + share)
        found.append((c, (differ + 1) * 11 // 10 + 1, differ))
    return found


def most_different(size: int, share: int) -> int:
    """The most shingles in which a set of this size differs from a linked one."""
    return (size + 100 * size // share) * (100 - share) // (100 + share)


class Lister:
    """Lists sets under the contents of their groups, which are equal ranges of hashes.

    Of a set's groups that hold something, at most as many as its shingles that differ are not the
    same in a linked set; if it has more of them, one is. Sets that have not, which are few, are
    listed under their empty groups too: of all groups one is the same in any case.
    """

    def __init__(self, share: int):
        self.share, self.known, self.ranges = share, {}, {}

    def classes(self, size: int) -> list:
        if size not in self.known:
            self.known[size] = [self.range(*one) for one in _classes(size, self.share)]
        return self.known[size]

    def range(self, k: int, groups: int, differ: int) -> tuple:
        if k not in self.ranges:
            self.ranges[k] = (
                differ, np.array([(g << 64) // groups for g in range(groups)], dtype=np.uint64),
                _mixed(np.arange(groups, dtype=np.uint64) * MIX + np.uint64(k)))
        return self.ranges[k]

    def parts(self, found: np.ndarray):
        """The listings in each class, and the most of them that a linked set may not share; None
        where empty groups are listed too."""
        if not len(found):
            return
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(found))))
        for differ, edges, marks in self.classes(len(found)):
            first = np.searchsorted(found, edges)
            last = np.append(first[1:], len(found))
            listed = _mixed(sums[last] - sums[first] + marks)
            filled = last > first
            if filled.sum() > differ:
                yield listed[filled], min(differ, most_different(len(found), self.share))
            else:
                yield listed, None

    def __call__(self, found: np.ndarray) -> np.ndarray:
        parts = [listed for listed, _ in self.parts(found)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def met(self, found: np.ndarray, shared) -> np.ndarray:
        """The listings a set has to be looked for under, where ``shared`` says which of them other
        sets may be on.

        A linked set is on all but ``differ`` of them. Where more have no other set on, there is none;
        else, with those first and the others by value, which is one order for all sets, the first
        ``differ`` + 1 of two linked sets have one in common.
        """
        parts = [np.zeros(0, dtype=np.uint64)]
        for listed, differ in self.parts(found):
            more = listed[shared(listed.view(np.int64))]
            if differ is not None:
                first = max(0, differ + 1 - (len(listed) - len(more)))
                more = np.partition(more, first)[:first] if first < len(more) else more
            parts.append(more)
        return np.concatenate(parts)


def _print(found: np.ndarray) -> bytes:
    """Identity of a set; its first half names the node of the candidate graph."""
    return blake2b(found.tobytes(), digest_size=16).digest()


def _node(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _listed(words: int, share: int):
    """Rows (node, lists) of all texts."""
    def found(batches):
        hasher, lister = Hasher(), Lister(share)
        for _, _, texts in chunks(batches, 1 << 20):
            sets = shingle_sets(texts, hasher, words)
            lists = [lister(s) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            yield pa.record_batch([
                pa.array([_node(_print(s)) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(np.concatenate(lists).view(np.int64)))],
                ["node", "lists"])

    return found


DIGEST = ("doc_id long, mark long, n_shingles long, name binary, node long, lists array<long>, "
          "point binary, found binary")


def _digests(passed, words: int, share: int):
    """One row for each text; with its listings, point and set where it may share a listing."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()),
             pa.binary(), pa.binary()]

    def found(batches):
        hasher, lister, seen = Hasher(), Lister(share), set()
        shared = partial(may_hold, passed.value)
        for keys, _, texts in chunks(batches, 1 << 20):
            rows = []
            for key, one in zip(keys, shingle_sets(texts, hasher, words)):
                name = _print(one)
                row = [key["doc_id"], key["mark"], len(one), name, _node(name), None, None, None]
                if name not in seen:  # of copies in one task, one is enough
                    lists = lister.met(one, shared).view(np.int64)
                    if len(lists):
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        row[5:] = lists, packed(point_of(one, SKETCH)), one.tobytes()
                rows.append(row)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                  [c.split()[0] for c in DIGEST.split(", ")])

    return found


def packed(point: np.ndarray) -> bytes:
    """A point in a byte for each coordinate, after the power of two they are rounded up to."""
    most = int(point.max())
    shift = max(0, most.bit_length() - 8)
    shift += -(-most >> shift) > 255  # rounding up may take one bit more
    return bytes([shift]) + (-(-point.astype(np.int64) >> shift)).astype(np.uint8).tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """Points that are nowhere below the packed ones."""
    return _widened(np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1))


def _widened(rows: np.ndarray) -> np.ndarray:
    return rows[:, 1:].astype(np.uint32) << rows[:, :1].astype(np.uint32)


def _meetings(share: int):
    """Rows (sig, node, n_shingles, point), sorted by sig -> candidate edges (a, b).

    Of the texts listed together, those whose points allow a link are connected, by as few edges
    as that takes. A list longer than a tree may be is connected as a whole.
    """
    def edges(sig, node, size, points):
        begin, length = _runs(sig)
        firsts = _short_lists(begin[length <= SHORT], length[length <= SHORT], size, points, share)
        for i, n in zip(begin[length > SHORT].tolist(), length[length > SHORT].tolist()):
            labels = i + _connected(_widened(points[i:i + n]), size[i:i + n], share)
            firsts.append(np.stack([labels, np.arange(i, i + n)]))
        a, b = np.concatenate(firsts, axis=1) if firsts else np.zeros((2, 0), dtype=np.int64)
        # texts meet under many listings: one edge of a pair is enough
        low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        new &= low != high
        return _edges(low[new], high[new])

    def found(batches):
        held, rows, long = [], 0, None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            part.append(_matrix(batch.column(3)))
            if long:  # more of a list that is connected as a whole
                more = int(np.searchsorted(part[0], long[0], "right"))
                yield _edges(np.full(more, long[1]), part[1][:more])
                part = [c[more:] for c in part]
                long = long if not len(part[0]) else None
            held.append(part)
            rows += len(part[0])
            if rows <= TREE:
                continue
            sig, *others = (np.concatenate(c) for c in zip(*held))
            begin, length = _runs(sig)
            for i, n in zip(begin[length > TREE].tolist(), length[length > TREE].tolist()):
                yield _edges(np.full(n - 1, others[0][i]), others[0][i + 1:i + n])
            if length[-1] > TREE:
                long = int(sig[-1]), int(others[0][begin[-1]])
            short = np.repeat(length <= TREE, length)
            last = begin[-1]  # which may go on in the next batch
            now = short & (np.arange(len(sig)) < last)
            if now.any():
                yield edges(sig[now], *(c[now] for c in others))
            held = [[c[last:].copy() for c in (sig, *others)]] if short[-1] else []
            rows = len(sig) - last if held else 0
        if rows:
            yield edges(*(np.concatenate(c) for c in zip(*held)))

    return found


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), dtype=bool),
                                           values[1:] != values[:-1])))
    return begin, np.diff(np.append(begin, len(values)))


def _matrix(points: pa.BinaryArray) -> np.ndarray:
    """Packed points as rows of bytes."""
    points = points.cast(pa.binary())
    ends = np.frombuffer(points.buffers()[1], np.int32)[points.offset:points.offset + len(points) + 1]
    return np.frombuffer(points.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(points), -1) \
        if len(points) else np.zeros((0, SKETCH + 1), dtype=np.uint8)


def _short_lists(begin, length, size, points, share: int) -> list[np.ndarray]:
    """Pairs (first, row) of rows in short lists, ``first`` being the least row that a row is
    connected with by pairs that may be linked. Lists of one length are dealt with together."""
    found = []
    for n in np.unique(length[length > 1]).tolist():
        x, y = np.triu_indices(n, 1)
        lists = begin[length == n]
        for some in np.array_split(lists, len(lists) * len(x) // PAIRS + 1):
            rows = (some[:, None] + np.arange(n)).ravel()
            i, j = ((np.arange(len(some))[:, None] * n + of).ravel() for of in (x, y))
            most = np.minimum(_widened(points[rows[i]]), _widened(points[rows[j]])).sum(
                axis=1, dtype=np.int64)
            fits = (100 + share) * most >= share * (size[rows[i]] + size[rows[j]])
            i, j, labels = i[fits], j[fits], np.arange(len(rows))
            while True:
                least = np.minimum(labels[i], labels[j])
                if (labels[i] == least).all() and (labels[j] == least).all():
                    break
                np.minimum.at(labels, i, least)
                np.minimum.at(labels, j, least)
            found.append(np.stack([rows[labels], rows]))
    return found


def _connected(points: np.ndarray, sizes: np.ndarray, share: int) -> np.ndarray:
    """Label of each point: the first row that it is connected with by pairs that may be linked.

    Points are compared with all that are not yet connected with them or with one before: those
    of a list are much alike, so that the nodes of a tree would rule out next to nothing.
    """
    labels = np.arange(len(points))
    left = labels.copy()
    while len(left):
        first, open_ = left[0], [left[0]]
        left, among, own = left[1:], points[left[1:]], sizes[left[1:]]
        while open_ and len(left):
            row = open_.pop()
            most = np.minimum(among, points[row]).sum(axis=1, dtype=np.int64)
            fits = (100 + share) * most >= share * (own + sizes[row])
            if fits.any():
                labels[left[fits]] = first
                open_ += left[fits].tolist()
                left, among, own = left[~fits], among[~fits], own[~fits]
    return labels


class Tree:
    """R-tree over count vectors, loaded at once by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, share: int):
        self.points, self.sizes, self.share = points, sizes, share
        self.root = self.build(np.arange(len(points)))

    def build(self, rows: np.ndarray):
        points = self.points[rows]
        upper, least = points.max(axis=0), int(self.sizes[rows].min())
        if len(rows) <= LEAF:
            return rows, upper, least, None
        spread = upper.astype(np.int64) - points.min(axis=0)
        order = np.argsort(points[:, int(spread.argmax())], kind="stable")
        half = len(rows) // 2
        return rows, upper, least, (self.build(rows[order[:half]]), self.build(rows[order[half:]]))

    def search(self, point: np.ndarray, size: int, labels: np.ndarray, own: int,
               after: int = -1) -> np.ndarray:
        """Rows beyond ``after`` that may be linked with a point and carry another label than ``own``."""
        found, open_, share = [], [self.root], self.share
        while open_:
            rows, upper, least, below = open_.pop()
            rows = rows[(rows > after) & (labels[rows] != own)]
            if not len(rows):
                continue
            # shared >= t / (1 + t) (m + n), for the smallest n below this node
            if (100 + share) * int(np.minimum(point, upper).sum(dtype=np.int64)) < share * (
                    size + max(least, -(-share * size // 100))):
                continue
            if below:
                open_ += below
                continue
            most = np.minimum(self.points[rows], point).sum(axis=1, dtype=np.int64)
            fits = (100 + share) * most >= share * (size + self.sizes[rows])
            found.append(np.stack([most[fits], rows[fits]]))
        if not found:
            return np.zeros(0, dtype=np.int64)
        most, rows = np.concatenate(found, axis=1)
        return rows[np.argsort(-most, kind="stable")]


def point_of(found: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts of a set's hashes in each group."""
    return np.bincount((found >> np.uint64(16)).astype(np.int64) % groups,
                       minlength=groups).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both) and both > 0


def link(sets: list[np.ndarray], share: int) -> np.ndarray:
    """Label of each set: the first row of its component. Pairs already connected are not tried,
    and no pair is tried twice."""
    labels = np.arange(len(sets))
    points = np.stack([point_of(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = Tree(points, sizes, share)
    for i, one in enumerate(sets):
        rows = tree.search(points[i], int(sizes[i]), labels, labels[i], i)
        while len(rows):
            if linked(one, sets[rows[0]], share):
                joined = min(labels[i], labels[rows[0]])
                labels[(labels == labels[i]) | (labels == labels[rows[0]])] = joined
                rows = rows[labels[rows] != joined]
            else:
                rows = rows[1:]
    return labels


def _labelled(names: list[bytes], labels: np.ndarray) -> pa.Table:
    least = {}
    for name, label in zip(names, labels.tolist()):
        least[label] = min(name, least.get(label, name))
    return pa.table({"name": pa.array(names, pa.binary()),
                     "label": pa.array([least[x] for x in labels.tolist()], pa.binary())})


def _distinct(table: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    rows = dict(zip(table["name"].to_pylist(), table["found"].to_pylist()))
    names = sorted(rows)
    return names, [np.frombuffer(rows[n], np.uint64) for n in names]


def _join_group(share: int):
    def joined(table: pa.Table) -> pa.Table:
        names, sets = _distinct(table)
        return _labelled(names, link(sets, share))

    return joined


def _against_pivots(share: int):
    def met(members: pa.Table, pivots: pa.Table) -> pa.Table:
        """Links (a, b) between members of a part and the pivots of their group."""
        pairs = []
        if members.num_rows and pivots.num_rows:
            pivots = pivots.rename_columns({"pivot": "name", "own": "found"})
            names, sets = _distinct(pivots)
            labels = dict(zip(pivots["name"].to_pylist(), pivots["reached"].to_pylist()))
            kinds = {x: i for i, x in enumerate(sorted(set(labels.values())))}
            label = np.array([kinds[labels[n]] for n in names])
            tree = Tree(np.stack([point_of(s) for s in sets]), np.array([len(s) for s in sets]), share)
            for name, own, raw in zip(*(members[c].to_pylist() for c in ("name", "label", "found"))):
                one = np.frombuffer(raw, np.uint64)
                rows = tree.search(point_of(one), len(one), label, kinds.get(own, -1))
                while len(rows):
                    if linked(one, sets[rows[0]], share):
                        pairs.append((own, labels[names[rows[0]]]))
                        rows = rows[label[rows] != label[rows[0]]]
                    else:
                        rows = rows[1:]
        pairs = sorted(set(pairs))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()),
                         "b": pa.array([p[1] for p in pairs], pa.binary())})

    return met


def _finer(rows):
    """Points of ``FINE`` counts for rows (group, name, found)."""
    for batch in rows:
        sets = [np.frombuffer(raw, np.uint64) for raw in batch.column(2).to_pylist()]
        yield pa.record_batch([
            batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([packed(point_of(s, FINE)) for s in sets], pa.binary())],
            ["group", "name", "n", "point"])


def _deal_out(share: int):
    def dealt(table: pa.Table) -> pa.Table:
        """The members of a group with the least name that they are connected with."""
        rows = sorted(dict(zip(table["name"].to_pylist(), zip(
            table["n"].to_pylist(), table["point"].to_pylist()))).items())
        names = [name for name, _ in rows]
        labels = _connected(unpacked([point for _, (_, point) in rows]),
                            np.array([n for _, (n, _) in rows]), share)
        return _labelled(names, labels)

    return dealt


def _split_large(sets: DataFrame, share: int) -> DataFrame:
    """Large candidate groups, as rows (name, found, group, parts, large), cut where finer points
    allow no link.

    The coarse points of sets of thousands of shingles bound little, so unrelated long texts that
    have a passage in common make up groups that hardly link. Finer points are read for the
    members of such groups only, a byte for each count. Groups with so many members that these are
    more than a tree may hold stay as they are.
    """
    sets = stored(sets, "large")
    fits = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") <= TREE_BYTES // FINE // 4).select("group")
    points = sets.join(F.broadcast(fits), "group").select("group", "name", "found").mapInArrow(
        _finer, "group long, name binary, n long, point binary")
    dealt = points.groupBy("group").applyInArrow(
        _deal_out(share), "name binary, label binary").withColumnRenamed("label", "of")
    named = sets.select("name", "group", F.octet_length("found").alias("size")).join(
        dealt, "name", "left").withColumn("group", F.coalesce(F.xxhash64("of"), "group"))
    sizes = named.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    placed = named.join(sizes, "group").select(
        "name", "group", *_parts(F.col("n"), F.col("bytes")))
    return sets.select("name", "found").join(_small(stored(placed, "split")), "name")


def _small(narrow: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast where it is known to be small."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def _parts(n, size) -> list:
    """Into how many parts a group goes, and whether it is too large for one tree."""
    return [F.greatest(F.ceil(n / PART), F.ceil(size / PART_BYTES)).alias("parts"),
            ((n > TREE) | (size > TREE_BYTES)).alias("large")]


def _join_large(sets: DataFrame, share: int) -> DataFrame:
    """Labels in candidate groups too large for one tree, from rows (name, found, group, parts).

    Groups are cut into parts, and each part is joined by itself. Then, round by round, members
    that are not in their group's largest component become pivots and are compared with every
    part of the group. A member that was a pivot has met all others. It ends when no member
    outside of the largest component is left that has not been one.
    """
    part = F.pmod(F.xxhash64("name"), F.col("parts"))
    members = stored(sets.withColumn("part", part), "members")
    labels = stored(members.groupBy("group", "part").applyInArrow(
        _join_group(share), "name binary, label binary"), "labels")
    done = labels.select("name").limit(0)
    while True:
        state = members.select("name", "group", "parts").join(labels, "name")
        sizes = state.groupBy("group", "label").count()
        main = sizes.groupBy("group").agg(F.max(F.struct("count", "label")).alias("m")).select(
            "group", F.col("m.label").alias("main"))
        left = state.join(main, "group").filter("label <> main").join(done, "name", "left_anti")
        # some of each component, so that large ones meet early
        window = F.pmod(F.xxhash64("name"), F.lit(SHARES))
        left = left.withColumns({"share": window, "turn": F.row_number().over(
            Window.partitionBy("group", "label", window).orderBy("name"))})
        left = left.withColumn("nth", F.row_number().over(
            Window.partitionBy("group", "share").orderBy("turn", "name")))
        left = left.filter(F.col("nth") <= PIVOTS // SHARES)
        pivots = stored(left.select("name", "group", "parts", "label"), "pivots")
        if pivots.isEmpty():
            return labels
        spread = pivots.join(members.select("name", "found"), "name").select(
            F.col("group").alias("of"), F.explode(F.sequence(
                F.lit(0).cast("long"), F.col("parts") - 1)).alias("at"),
            F.col("name").alias("pivot"), F.col("label").alias("reached"),
            F.col("found").alias("own"))
        found = members.join(labels, "name").groupBy("group", "part").cogroup(
            spread.groupBy("of", "at")).applyInArrow(_against_pivots(share), "a binary, b binary")
        joined = components(found)
        labels = stored(labels.join(joined.withColumnRenamed("label", "least"), F.col("label") == F.col(
            "node"), "left").select("name", F.coalesce("least", "label").alias("label")), "labels")
        done = stored(done.union(pivots.select("name")), "done")


def _shared_lists(rows: DataFrame, words: int, share: int) -> np.ndarray:
    """Bloom filter of the lists that more than one set is on."""
    listed = rows.mapInArrow(_listed(words, share), "node long, lists array<long>").select(
        "node", F.explode("lists").alias("sig"))
    return build(listed.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter(
        "a < b").select("sig"))


def _joined(docs: DataFrame, words: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n_shingles, name), and rows (name, label) of linked sets."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(F.struct(doc, F.xxhash64("text").alias("mark")).alias("key"),
                       F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    passed = docs.sparkSession.sparkContext.broadcast(_shared_lists(rows, words, share))  # of fixed size
    digests = stored(rows.mapInArrow(_digests(passed, words, share), DIGEST).withColumn(
        "at", F.monotonically_increasing_id()), "digests")
    forget(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meetings = digests.select(F.explode("lists").alias("sig"), "node", "n_shingles", "point")
    edges = meetings.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(
        _meetings(share), "a long, b long")
    groups = components(edges).withColumnRenamed("label", "group")
    forget(docs.sparkSession)
    # tasks and what they forget make rows with the same set; the first of them stands for all
    found = digests.filter("found is not null")
    once = found.groupBy("name").agg(F.min("at").alias("at"), F.first("node").alias("node"),
                                     F.first("n_shingles").alias("n_shingles")).join(groups, "node")
    sizes = once.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("n_shingles")).alias("bytes"))
    placed = stored(once.join(sizes, "group").select(
        "at", "group", *_parts(F.col("n"), F.col("bytes"))), "placed")
    # where the narrow side is known to be small, sets are moved to their group only
    sets = found.select("at", "name", "found").join(_small(placed), "at").drop("at")
    joined = sets.filter("not large").groupBy("group").applyInArrow(
        _join_group(share), "name binary, label binary")
    labels = stored(joined, "labels")
    if not placed.filter("large").isEmpty():
        split = stored(_split_large(sets.filter("large"), share), "split_sets")
        labels = labels.union(stored(split.filter("not large").groupBy("group").applyInArrow(
            _join_group(share), "name binary, label binary"), "labels"))
        if not split.filter("large").isEmpty():
            labels = labels.union(_join_large(split.filter("large").drop("large"), share))
    return digests.select("doc_id", "mark", "n_shingles", "name"), labels


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``.

    Texts link when ``share`` percent of their shingles of ``words`` words are common; the component is named by the
    least id reachable. Equal sets are one node, so copies are never paired. Texts without words
    link with nothing. Null ids take part in links, and their rows have the id of the component.
    """
    digests, labels = _joined(docs, words, share)
    nodes = digests.groupBy("name").agg(F.min("doc_id").alias("id")).join(
        labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    least = nodes.groupBy("label").agg(F.min("id").alias("component_id"))
    named = nodes.join(least, "label").select("name", "component_id")
    return digests.join(named, "name").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
            F.col("component_id")).alias("component_id"))


def _set_aside(docs: DataFrame, words: int, share: int) -> DataFrame:
    """Rows (doc_id, mark, stays) of documents with words: those that don't stay, and those that
    are there more than once."""
    digests, labels = _joined(docs, words, share)
    labelled = digests.filter("n_shingles > 0").join(labels, "name", "left").withColumn(
        "label", F.coalesce("label", "name"))
    keys = labelled.groupBy("label", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    chosen = keys.groupBy("label").agg(first.alias("f")).select(
        F.col("label").alias("of"), F.col("f.doc_id").alias("id"), F.col("f.mark").alias("by"))
    same = (F.col("label") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (
        F.col("mark") == F.col("by"))
    return keys.join(chosen, same, "left").select(
        "doc_id", "mark", F.col("of").isNotNull().alias("stays"), "n").filter("not stays or n > 1")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """One document of each component, that with the least id, with all its columns.

    Rows alike in id and text are one document; texts without words all stay. A null id is the
    last choice. Documents are not moved where the keys of those that go can be broadcast; what
    the join has stored is removed, but for these keys.
    """
    with passing(docs.sparkSession):
        aside = stored(_set_aside(docs, words, share), "set_aside", last=True)
    tail = "_" * max(map(len, docs.columns))  # names that the documents cannot have
    known = aside.select(*[F.col(c).alias(c + tail) for c in ("doc_id", "mark", "stays")])
    narrow, mark = _small(known), "of" + tail
    rows = docs.withColumn(mark, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("doc_id" + tail)) & (
        F.col(mark) == F.col("mark" + tail))
    left = rows.join(narrow, same, "left_anti")
    if not aside.filter("stays").isEmpty():
        again = rows.join(narrow.filter("stays" + tail), same, "left_semi")
        left = left.unionAll(again.dropDuplicates(["doc_id", mark]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
