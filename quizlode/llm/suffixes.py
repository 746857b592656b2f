"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes as smaller or larger than their successors, sorts the substrings between leftmost
smaller suffixes by inducing, names them, sorts the suffixes of the string of names and induces the whole array from it.
Inducing works through the buckets in order; where buckets are long (bytes), a bucket's entries are handled together, in
as many rounds as a letter repeats itself; where they are short (short texts), one by one. Names have many short buckets:
their suffixes are sorted by twice as many names in each round, all that are not told apart yet together.

``common_prefixes`` gives, for every position in the order of the text, what its suffix shares with its predecessor in
the array. A position whose preceding symbol is also that of its predecessor has one less than the position before; the
others are compared, eight symbols at a time.
"""

from __future__ import annotations

import numpy as np

#: Symbols for each bucket from which buckets are handled as a whole.
LONG_BUCKETS = 64
#: Entries that are put into their buckets one by one.
FEW = 8


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, a unique least symbol, is."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    # equal symbols are of the type of the next unequal ones
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(sa: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, edge: np.ndarray, direction: int) -> None:
    """Put suffixes, in order, at the edges of their buckets, and move the edges."""
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    sizes = np.diff(np.append(first, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(first, sizes)
    sa[edge[symbols] + (rank if direction > 0 else -1 - rank)] = suffixes[order]
    edge[symbols[first]] += direction * sizes


def _induced_by_bucket(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sa = np.full(len(text), -1, np.int32)
    tail = ends.copy()
    _deal(sa, text[leftmost[::-1]], leftmost[::-1], tail, -1)
    used = np.flatnonzero(ends > starts).tolist()

    def induce(block: np.ndarray, kind: bool, edge: np.ndarray, direction: int) -> None:
        if len(block) <= FEW:
            for i in block.tolist():
                if i > 0 and bool(smaller[i - 1]) == kind:
                    c = text[i - 1]
                    sa[edge[c] if direction > 0 else edge[c] - 1] = i - 1
                    edge[c] += direction
            return
        before = block[block > 0] - 1
        before = before[smaller[before] == kind]
        if len(before):
            _deal(sa, text[before], before, edge, direction)

    head = starts.copy()
    for c in used:
        done = starts[c]
        while done < head[c]:
            block, done = sa[done : head[c]].copy(), head[c]
            induce(block, False, head, 1)
        induce(sa[tail[c] : ends[c]], False, head, 1)
    tail = ends.copy()
    for c in reversed(used):
        done = ends[c]
        if c == text[-1]:
            sa[starts[c]], tail[c] = len(text) - 1, starts[c]
        while tail[c] < done:
            block, done = sa[tail[c] : done][::-1].copy(), tail[c]
            induce(block, True, tail, -1)
        induce(sa[starts[c] : head[c]][::-1], True, tail, -1)
    return sa


def _induced_one_by_one(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(text)
    sa = [-1] * n
    edge = ends.tolist()
    for i, c in zip(leftmost[::-1].tolist(), text[leftmost[::-1]].tolist(), strict=True):
        edge[c] -= 1
        sa[edge[c]] = i
    # the symbol in front of each suffix if it begins one of the kind, else -1, as behind the end, where empty places look
    larger, less = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    symbols = text[:-1].astype(np.int64)
    larger[1:n] = np.where(smaller[:-1], -1, symbols)
    less[1:n] = np.where(smaller[:-1], symbols, -1)
    front, edge = larger.tolist(), starts.tolist()
    for i in sa:  # what is put ahead is met later
        c = front[i]
        if c >= 0:
            e = edge[c]
            sa[e] = i - 1
            edge[c] = e + 1
    front, edge = less.tolist(), ends.tolist()
    for i in reversed(sa):
        c = front[i]
        if c >= 0:
            e = edge[c] = edge[c] - 1
            sa[e] = i - 1
    return np.array(sa, np.int32)


def _names(text: np.ndarray, order: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Names, equal for equal ones and ordered as they are, of the substrings that begin at ``order``."""
    length = np.zeros(len(text), np.int32)
    length[leftmost[:-1]] = np.diff(leftmost) + 1
    length[leftmost[-1]] = 1
    same = np.zeros(len(order), bool)
    pair = np.flatnonzero(length[order[1:]] == length[order[:-1]]) + 1
    a, b, left = order[pair - 1], order[pair], length[order[pair]]
    for k in range(32):
        equal = text[a + k] == text[b + k]
        same[pair[equal & (left == k + 1)]] = True
        on = equal & (left > k + 1)
        pair, a, b, left = pair[on], a[on], b[on], left[on]
        if not len(pair):
            break
    for p, x, y, n in zip(pair.tolist(), a.tolist(), b.tolist(), left.tolist(), strict=True):
        same[p] = bool((text[x : x + n] == text[y : y + n]).all())
    return np.cumsum(~same) - 1


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of names (below their number; the last is the least and occurs once), by prefixes twice as long each round."""
    n = len(names)
    bits, place = max(1, int(n).bit_length()), np.arange(n)
    sa, rank = np.empty(n, np.int64), np.zeros(n, np.int64)
    open_, after, k = place, names.astype(np.int64), 1
    while len(open_):
        group = rank[open_]
        if 3 * bits <= 63:
            packed = np.sort((group << 2 * bits) | (after << bits) | open_)
            key, open_ = packed >> bits, packed & ((1 << bits) - 1)
            group = key >> bits
        else:
            order = np.lexsort((after, group))
            open_, group = open_[order], group[order]
            key = (group << bits) | after[order]
        at = place[: len(key)]
        starts = np.ones(len(key), bool)
        starts[1:] = group[1:] != group[:-1]
        # a suffix's rank is where its group begins in the array
        at = group + at - np.maximum.accumulate(np.where(starts, at, 0))
        starts[1:] = key[1:] != key[:-1]
        sa[at] = open_
        rank[open_] = np.maximum.accumulate(np.where(starts, at, 0))
        several = ~(starts & np.append(starts[1:], True))
        open_ = open_[several]
        after, k = rank[open_ + k], 2 * k  # none reaches over the end: its last name is there once
    return sa.astype(np.int32)


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of whole numbers below ``symbols``; the last is the least and occurs once."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    smaller = _smaller(text)
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    sizes = np.bincount(text, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    induced = _induced_by_bucket if n > LONG_BUCKETS * symbols else _induced_one_by_one
    sa = induced(text, smaller, leftmost, starts, ends)
    number = np.full(n, -1, np.int32)
    number[leftmost] = np.arange(len(leftmost), dtype=np.int32)
    order = sa[number[sa] >= 0]
    names = _names(text, order, leftmost)
    reduced = np.empty(len(leftmost), np.int32)
    reduced[number[order]] = names
    if names[-1] + 1 < len(leftmost):
        order = leftmost[_doubled(reduced)]
    return induced(text, smaller, order, starts, ends)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the symbols that its suffix shares with the one before it in the suffix array (the first: none)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    # reducible: the symbols in front are equal, and so the positions in front are neighbours in the array too
    told = np.zeros(n, bool)
    told[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:], 1) - 1])
    open_ = np.flatnonzero(~told & (before >= 0))
    found = np.zeros(n, np.int64)
    coded = text.astype(np.uint16).tobytes() + bytes(16)
    four = np.lib.stride_tricks.as_strided(np.frombuffer(coded, np.uint64, len(coded) // 8), (n + 4,), (2,))
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(coded, np.uint16), (n, 1), (2, 2))[:, 0]
    i, j = open_, before[open_]
    k = 0
    rows = np.arange(len(open_))
    length = np.zeros(len(open_), np.int64)
    while len(rows):
        a, b = np.minimum(i + k, n), np.minimum(j + k, n)
        differ = four[a] ^ four[b]
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        length[rows[stop]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4)
        rows, i, j = rows[~stop], i[~stop], j[~stop]
        k += 4
        if k >= 256 and len(rows) < 64:
            break
    for r, x, y in zip(rows.tolist(), i.tolist(), j.tolist(), strict=True):
        length[r] = k + _shared(eight, x + k, y + k)
    found[open_] = length
    last = np.maximum.accumulate(np.where(told, 0, at))
    return np.where(told, np.maximum(found[last] - (at - last), 0), found)


def _shared(text: np.ndarray, x: int, y: int, step: int = 4096) -> int:
    start = x
    while True:
        n = min(step, len(text) - max(x, y))
        differ = np.flatnonzero(text[x : x + n] != text[y : y + n])
        if len(differ) or n < step:
            return x - start + (int(differ[0]) if len(differ) else n)
        x, y = x + n, y + n


def repeated_starts(texts: list[bytes], copies: list[int], window: int) -> list[np.ndarray]:
    """For every text, which of its runs of ``window`` bytes start anywhere else too; a text counts as often as it has copies.

    Copies are told by a number and not written out: the neighbour of such a suffix is its own copy, as long as it is.
    """
    joined = np.zeros(sum(len(t) + 1 for t in texts) + 1, np.uint16)
    can, several = np.zeros(len(joined), bool), np.zeros(len(joined), bool)
    at, starts = 0, []
    for t, n in zip(texts, copies, strict=True):
        joined[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 2
        joined[at + len(t)] = 1
        can[at : at + max(0, len(t) - window + 1)] = True
        several[at : at + len(t)] = n > 1
        starts.append(at)
        at += len(t) + 1
    sa = suffix_array(joined, 258)
    shared = common_prefixes(joined, sa) >= window
    found = shared | several
    found[sa[:-1]] |= shared[sa[1:]]
    found &= can
    return [found[a : a + max(0, len(t) - window + 1)] for a, t in zip(starts, texts, strict=True)]
