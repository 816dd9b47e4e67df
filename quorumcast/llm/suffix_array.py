"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their successor.  The
leftmost S suffixes of each run are put in order first: their substrings are
sorted by inducing and named, and where names repeat, the string of names is
sorted in turn.  All other suffixes are then induced from them in linear time.

Inducing goes bucket by bucket: all entries of a bucket that are known are handled
as one array, in waves where a bucket feeds itself, so the work is array
operations however long the text is.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the end counts as smaller."""
    n = len(t)
    differs = np.append(t[1:] != t[:-1], True)
    up = np.append(t[1:] > t[:-1], True)
    # A run of equal letters has the type of its last one.
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return up[nearest]


def _induce(t: np.ndarray, s_type: np.ndarray, size: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes, given the leftmost S ones in order (bucket by bucket)."""
    n = len(t)
    ends = np.cumsum(size)
    begins = ends - size
    sa = np.full(n, -1, np.int64)
    letters = np.flatnonzero(size)
    lms_letter = t[lms]
    lms_cut = np.searchsorted(lms_letter, np.arange(len(size) + 1))
    head = begins.copy()

    def push(found: np.ndarray, letter: np.ndarray, forwards: bool, edge: np.ndarray) -> None:
        order = np.argsort(letter, kind="stable")
        found, letter = found[order], letter[order]
        first = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
        count = np.diff(np.append(first, len(letter)))
        within = np.arange(len(letter)) - np.repeat(first, count)
        which = letter[first]
        if forwards:
            sa[np.repeat(edge[which], count) + within] = found
            edge[which] += count
        else:
            sa[np.repeat(edge[which], count) - 1 - within] = found
            edge[which] -= count

    def before(wave: np.ndarray, want_s: bool) -> tuple[np.ndarray, np.ndarray]:
        p = wave[wave > 0] - 1
        p = p[s_type[p] == want_s]
        return p, t[p]

    # The suffix at the end is preceded by nothing smaller: it induces first.
    p, c = before(np.array([n]), False)
    if len(p):
        push(p, c, True, head)
    for letter in letters:
        done = begins[letter]
        while done < head[letter]:
            wave = sa[done:head[letter]]
            done = head[letter]
            p, c = before(wave, False)
            if len(p):
                push(p, c, True, head)
        p, c = before(lms[lms_cut[letter]:lms_cut[letter + 1]], False)
        if len(p):
            push(p, c, True, head)

    tail = ends.copy()
    p, c = before(np.array([n]), True)
    if len(p):
        push(p, c, False, tail)
    for letter in letters[::-1]:
        done = ends[letter]
        while done > tail[letter]:
            wave = sa[tail[letter]:done][::-1]
            done = tail[letter]
            p, c = before(wave, True)
            if len(p):
                push(p, c, False, tail)
        p, c = before(sa[begins[letter]:head[letter]][::-1], True)
        if len(p):
            push(p, c, False, tail)
    return sa


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names, whose alphabet is as large as it:
    prefixes of doubling length, taking up only the suffixes not yet told apart."""
    n = len(names)
    rank = names.astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    h = 1
    while True:
        r = rank[sa]
        same = np.zeros(n, bool)
        same[1:] = r[1:] == r[:-1]
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = np.flatnonzero(open_)
        if len(at) == 0:
            return sa
        i = sa[at]
        follow = np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
        order = np.lexsort((follow, r[at]))
        sa[at] = i[order]
        r, follow = r[at][order], follow[order]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        split = new_group | np.concatenate([[True], follow[1:] != follow[:-1]])
        # A suffix's rank is the place of the first of its group.
        rank[sa[at]] = np.maximum.accumulate(np.where(split, at, 0))
        if h == 1:  # ranks so far were names, not places
            single = np.flatnonzero(~open_)
            rank[sa[single]] = single
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small non-negative integers."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    s_type = _smaller(t)
    s_type[-1] = False  # before the virtual end, which is smaller than all
    differs = np.append(t[1:] != t[:-1], True)
    if n > 1 and not differs[:-1].all():
        # A run that reaches the end consists of L suffixes.
        run = np.flatnonzero(differs[:-1])
        s_type[(run[-1] + 1 if len(run) else 0):] = False
    size = np.bincount(t)
    leftmost = s_type.copy()
    leftmost[0] = False
    leftmost[1:] &= ~s_type[:-1]
    lms = np.flatnonzero(leftmost)
    if len(lms) > 1:
        by_letter = lms[np.argsort(t[lms], kind="stable")]
        sa = _induce(t, s_type, size, by_letter)
        ordered = sa[leftmost[sa]]
        # Name the substrings from each leftmost S suffix to the next.
        length = np.full(n, 0, np.int64)
        length[lms[:-1]] = np.diff(lms)
        length[lms[-1]] = n - lms[-1]
        a, b = ordered[:-1], ordered[1:]
        equal = length[a] == length[b]
        live = np.flatnonzero(equal & (a != lms[-1]) & (b != lms[-1]))
        equal[(a == lms[-1]) | (b == lms[-1])] = False
        off = 0
        while len(live):
            ok = t[a[live] + off] == t[b[live] + off]
            equal[live[~ok]] = False
            live = live[ok]
            live = live[length[a[live]] > off]
            off += 1
        name = np.zeros(n, np.int64)
        name[ordered] = np.concatenate([[0], np.cumsum(~equal)])
        if not equal.any():
            lms = ordered
        else:
            lms = lms[_rank_names(name[lms])]
    return _induce(t, s_type, size, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP: for each position the common prefix with its predecessor in the suffix array.

    Where the letters before the two are equal, the value is one less than at the position
    before; only the other positions are compared, eight letters at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    left_equal = np.zeros(n, bool)
    left_equal[1:] = (phi[1:] > 0) & (t[:-1] == t[np.maximum(phi[1:], 1) - 1])
    # Letters as bytes, eight of them in a word at every position.
    letters, small = np.unique(t, return_inverse=True)
    if len(letters) > 255:
        raise ValueError("an alphabet of at most 255 letters is supported")
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = small + 1
    words = np.zeros(n + 1, np.uint64)
    for k in range(8):
        mine = words[k::8]
        mine[:] = np.frombuffer(padded, np.uint64, len(mine), k)
    plcp = np.zeros(n, np.int64)
    i = np.flatnonzero(~left_equal & (phi >= 0))
    j = phi[i]
    have = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x = words[np.minimum(i[live] + have[live], n)] ^ words[np.minimum(j[live] + have[live], n)]
        # Equal letters before the lowest set bit; all eight if there is none.
        have[live] += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        live = live[x == 0]
        live = live[(i[live] + have[live] < n) & (j[live] + have[live] < n)]
    have = np.minimum(have, n - np.maximum(i, j))
    plcp[i] = have
    # Reducible positions count down from the last irreducible one.
    source = np.maximum.accumulate(np.where(left_equal, 0, at))
    return np.where(left_equal, np.maximum(0, plcp[source] - (at - source)), plcp)
