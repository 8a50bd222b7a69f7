"""Suffix arrays by induced sorting, in NumPy, and their permuted common prefixes.

A suffix is of type S if it is smaller than the one after it, else of type L. An S suffix after an L one is leftmost-smaller
(LMS). From any order of the LMS places two scans induce the order of all suffixes: a scan from the smallest puts each L
suffix at the head of its bucket as the suffix after it is passed, a scan from the largest does the same for the S suffixes.
From the LMS places in the order of their first symbols the scans sort the substrings between LMS places; these are named,
the string of names is sorted by the same method recursively, and a second pair of scans induces the suffix array.

A scan takes all entries up to the first place that isn't filled yet as one step, and a run of equal symbols is placed at
once: its suffixes stand in sub-buckets by the symbols left of the run.
"""

from __future__ import annotations

import numpy as np


def _runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the run of equal symbols that each place lies in."""
    at = np.arange(len(s))
    change = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(np.r_[True, change], at, 0))
    last = np.minimum.accumulate(np.where(np.r_[change, True], at, len(s))[::-1])[::-1]
    return first, last


def _induce(value: np.ndarray, wanted: np.ndarray, given: np.ndarray, runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The wanted suffixes in the order of a scan by rising value that passes them and the given ones; each follows from the suffix after it.

    Suffixes of one value: the wanted ones first, those with fewer symbols left of their run before those with more, then
    the given ones in their order.
    """
    first, last = runs
    at = np.flatnonzero(wanted)
    left = last[at] - at + 1
    longest = int(left.max()) + 1 if len(at) else 1
    top = int(value.max()) + 1
    kind = np.concatenate([value[at] * longest + left - 1, value[given] * longest + longest - 1])
    if top * longest <= 4 * len(value) + 1024:
        size = np.bincount(kind, minlength=top * longest)
        bucket = np.full(len(value), -1, np.int64)
        bucket[at] = kind[: len(at)]
    else:
        kinds, kind, size = np.unique(kind, return_inverse=True, return_counts=True)
        bucket = np.full(len(value), -1, np.int64)
        bucket[at] = kind[: len(at)]
    head = np.cumsum(size) - size
    line = np.full(len(kind), -1, np.int64)
    of = kind[len(at) :]  # given: rising already
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    line[head[of] + np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))] = given
    fresh = np.zeros(len(line), bool)
    fresh[: len(line)] = line < 0

    lo, reach = 0, 64
    while lo < len(line):
        hi = lo
        while True:  # the first place that isn't filled
            part = line[hi : hi + reach]
            gap = int((part < 0).argmax()) if len(part) else 0
            if len(part) and part[gap] < 0:
                hi += gap
                break
            hi += len(part)
            if hi >= len(line):
                break
            reach *= 2
        if hi == lo:  # nothing leads here: the text is not what its types say
            raise ValueError("a suffix can't be induced")
        reach = max(64, 2 * (hi - lo))
        p = line[lo:hi] - 1
        lo = hi
        p = p[p >= 0]
        p = p[bucket[p] >= 0]
        p = p[last[p] == p]  # inside a run: placed with its last symbol
        if not len(p):
            continue
        far = p - first[p]
        if far.any():
            many = far + 1
            p = np.repeat(p, many) - (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        b = bucket[p]
        if len(p) == 1:
            line[head[b]] = p
            head[b] += 1
            continue
        order = np.argsort(b, kind="stable")
        b, p = b[order], p[order]
        new = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        many = np.diff(np.r_[new, len(b)])
        line[head[b] + np.arange(len(b)) - np.repeat(new, many)] = p
        head[b[new]] += many
    return line[fresh]


def _both(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The L and the S suffixes in order, induced from the LMS places in theirs; s ends in the sentinel, which belongs to neither."""
    l_order = _induce(s, ~is_s, lms, runs)
    wanted = is_s.copy()
    wanted[-1] = False
    return l_order, _induce(s.max() - s, wanted, l_order[::-1], runs)[::-1]


def _names(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """A number for the substring from each LMS place to the next one (included), by its order; lms ends in the sentinel, sorted_ doesn't have it."""
    n = len(s)
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(len(lms))
    size = np.diff(lms)[place[sorted_]] + 1
    equal = size[1:] == size[:-1]
    at = np.flatnonzero(equal)
    if len(at):
        many = size[at]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        a, b = np.repeat(sorted_[at], many) + within, np.repeat(sorted_[at + 1], many) + within
        differ = (s[a] != s[b]) | (is_s[a] != is_s[b])
        equal[at] = np.bincount(np.repeat(np.arange(len(at)), many), differ, len(at)) == 0
    names = np.empty(len(lms) - 1, np.int64)
    names[place[sorted_]] = np.r_[0, np.cumsum(~equal)]
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of text's suffixes in order; text holds integers from 1 on. A proper prefix comes before what it begins."""
    n = len(text)
    if n <= 1:
        return np.arange(n)
    s = np.append(np.asarray(text, dtype=np.int64), 0)
    runs = _runs(s)
    after = np.minimum(runs[1] + 1, n)  # the first place with another symbol
    is_s = s < s[after]
    is_s[-1] = True
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1  # the last one is the sentinel
    if len(lms) > 1:
        own = lms[:-1]
        order = np.r_[n, own[np.argsort(s[own], kind="stable")]]
        _, s_order = _both(s, is_s, order, runs)
        mark = np.zeros(n + 1, bool)
        mark[own] = True
        by_substring = s_order[mark[s_order]]
        names = _names(s, is_s, lms, by_substring)
        own = by_substring if names.max() + 1 == len(own) else own[suffix_array(names + 1)]
        lms = np.r_[n, own]
    l_order, s_order = _both(s, is_s, lms, runs)
    # of one symbol the L suffixes come first
    both = np.concatenate([l_order, s_order])
    return both[np.argsort(2 * s[both] + is_s[both], kind="stable")]


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int, step: int = 16) -> np.ndarray:
    """For each place, the length of the prefix, up to most, that its suffix shares with the one before it in the order. text: bytes.

    The value of a place is at least that of the place before it, less one. So every step-th place is compared first, and
    the others from what the last of these leaves on, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.zeros(n + most + 8, np.uint64)  # the eight bytes from each place on, the first one lowest
    for k in range(8):
        words |= padded[k : k + n + most + 8].astype(np.uint64) << np.uint64(8 * k)
    # neither suffix goes beyond the text's end
    room = np.minimum(most, n - np.maximum(np.arange(n), before))
    out = np.zeros(n, np.int64)

    def compare(at: np.ndarray) -> None:
        while len(at):
            k = out[at]
            differ = words[at + k] ^ words[before[at] + k]
            lowest = differ & (~differ + np.uint64(1))
            # the place of a lone bit, over 8: bytes that agree
            out[at] = k + np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) // 8)
            at = at[(differ == 0) & (out[at] < room[at])]

    firsts = np.arange(0, n, step)
    compare(firsts[before[firsts] >= 0])
    np.minimum(out, room, out=out)
    out = np.maximum(out, np.repeat(out[firsts], step)[:n] - np.arange(n) % step)
    out[before < 0] = 0
    rest = np.flatnonzero((before >= 0) & (np.arange(n) % step > 0))
    compare(rest[out[rest] < room[rest]])
    return np.minimum(out, room)
