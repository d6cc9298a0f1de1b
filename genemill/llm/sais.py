"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, size: int) -> list[int]:
    """Suffix array of a sequence of integers in [0, size), by induced sorting.

    Suffixes are classified as smaller or larger than the next one; the leftmost smaller ones (LMS) are put at the ends
    of their buckets and induce the order of all LMS substrings; if two of those are equal, their names are sorted
    recursively; then the sorted LMS suffixes induce the order of all suffixes in two linear passes.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    s, kind = text.tolist(), smaller.tolist()
    heads, tails = (ends - counts).tolist(), ends.tolist()
    # order by first symbol only, then induce
    order = _induce(s, kind, lms.tolist(), heads, tails)
    if len(lms) > 1:
        names, distinct = _names(text, lms, np.array(order))
        if distinct < len(lms):
            order = lms[suffix_array(names, distinct)].tolist()
        else:
            order = lms[np.argsort(names)].tolist()
        order = _induce(s, kind, order, heads, tails)
    return order


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the empty suffix is the smallest."""
    step = np.sign(np.diff(text.astype(np.int64)))
    step = np.append(step, -1)
    # a run of equal symbols goes as the first change after it
    at = np.where(step != 0, np.arange(len(step)), len(step))
    change = np.minimum.accumulate(at[::-1])[::-1]
    return step[change] > 0


def _induce(s: list[int], smaller: list[bool], lms: list[int], heads: list[int], tails: list[int]) -> list[int]:
    n = len(s)
    order = [-1] * n
    tail = tails.copy()
    for i in reversed(lms):
        c = s[i]
        tail[c] -= 1
        order[tail[c]] = i
    head = heads.copy()
    # the last suffix comes before the empty one's successor: it is larger, and first in its bucket
    c = s[n - 1]
    order[head[c]] = n - 1
    head[c] += 1
    for k in range(n):
        i = order[k] - 1
        if i >= 0 and not smaller[i]:
            c = s[i]
            order[head[c]] = i
            head[c] += 1
    tail = tails.copy()
    for k in range(n - 1, -1, -1):
        i = order[k] - 1
        if i >= 0 and smaller[i]:
            c = s[i]
            tail[c] -= 1
            order[tail[c]] = i
    return order


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, in text order, by their induced order; equal substrings have equal names."""
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = order[is_lms[order]]
    place = np.zeros(len(text), np.int64)
    place[lms] = np.arange(len(lms))
    # a substring reaches to the next LMS symbol; the last one reaches the end and equals no other
    length = np.append(np.diff(lms), 0)[place[ordered]]
    same = (length[1:] == length[:-1]) & (length[1:] > 0)
    left, right, size = ordered[:-1][same], ordered[1:][same], length[1:][same]
    equal = np.ones(len(left), bool)
    live = np.arange(len(left))
    for d in range(int(size.max()) + 1 if len(size) else 0):
        live = live[size[live] >= d]
        if not len(live):
            break
        ok = text[left[live] + d] == text[right[live] + d]
        equal[live[~ok]] = False
        live = live[ok]
    new = np.ones(len(ordered), bool)
    new[np.flatnonzero(same) + 1] = ~equal
    names = np.empty(len(lms), np.int64)
    names[place[ordered]] = np.cumsum(new) - 1
    return names, int(new.sum())


def permuted_lcp(text: np.ndarray, order: list[int]) -> np.ndarray:
    """For each place of the text, the common prefix of its suffix with the one before it in the suffix array."""
    n, s = len(text), text.tolist()
    before = [-1] * n
    for k in range(1, n):
        before[order[k]] = order[k - 1]
    out, length = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            length = 0
            continue
        while i + length < n and j + length < n and s[i + length] == s[j + length]:
            length += 1
        out[i] = length
        if length:
            length -= 1
    return np.array(out)
