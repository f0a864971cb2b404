"""Longest common subsequences, bit-parallel: one big-integer step per token.

Row ``i`` is an integer whose bit ``j`` is 0 where the LCS of the first ``i`` left tokens and
``j + 1`` right tokens is longer than with ``j`` right tokens, so LCS lengths are zero counts.
(Crochemore et al. 2001, Hyyro 2004.)
"""


def rows(left, right):
    """All rows, from the empty left sequence on."""
    where = {}
    for j, token in enumerate(right):
        where[token] = where.get(token, 0) | (1 << j)
    full = (1 << len(right)) - 1
    state, out = full, [full]
    for token in left:
        hit = state & where.get(token, 0)
        state = ((state + hit) | (state - hit)) & full
        out.append(state)
    return out


def length(left, right) -> int:
    if len(left) < len(right):
        left, right = right, left  # fewer bits per step
    where = {}
    for j, token in enumerate(right):
        where[token] = where.get(token, 0) | (1 << j)
    full = (1 << len(right)) - 1
    state = full
    for token in left:
        hit = state & where.get(token, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return len(right) - state.bit_count()


def positions(left, right) -> set[int]:
    """Left positions of one LCS, the one found walking back from the ends and leaving the
    left sequence first when both ways are equally long."""
    table = rows(left, right)

    def count(i, j):
        return j - (table[i] & ((1 << j) - 1)).bit_count()

    found, i, j = set(), len(left), len(right)
    while i and j:
        if left[i - 1] == right[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif count(i, j) > count(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


def union_hits(references, predictions) -> int:
    """Summary-level hits: per reference line the union of its LCS with every predicted line,
    each token counted at most as often as it occurs on either side."""
    spare_ref, spare_pred = {}, {}
    for lines, spare in ((references, spare_ref), (predictions, spare_pred)):
        for line in lines:
            for token in line:
                spare[token] = spare.get(token, 0) + 1
    hits = 0
    for line in references:
        taken = set()
        for other in predictions:
            taken |= positions(line, other)
        for i in sorted(taken):
            token = line[i]
            if spare_ref.get(token, 0) > 0 and spare_pred.get(token, 0) > 0:
                spare_ref[token] -= 1
                spare_pred[token] -= 1
                hits += 1
    return hits
