"""Suffix arrays by induced sorting, and permuted longest common prefixes, in NumPy.

The steps are those of induced sorting; each works on whole character buckets
instead of one suffix at a time:

1. classify suffixes as smaller (S) or larger (L) than the next one;
2. sort the substrings between leftmost-smaller (LMS) positions by inducing
   from their first characters, and name them;
3. sort the LMS suffixes by their names, recursively: each round sorts
   pairs of the names of the round before, so names cover twice the text;
   it ends when all differ or cover ``depth`` characters;
4. induce the whole array from the sorted LMS suffixes, linearly.

Suffixes that agree in their first ``depth`` characters may come in any order
among themselves.
"""

from __future__ import annotations

import numpy as np


def smaller_type(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (the last one, a unique smallest character, is)."""
    n = len(text)
    rises = text[:-1] < text[1:]
    differs = np.flatnonzero(text[:-1] != text[1:])
    # equal neighbours have the type of the next difference
    following = np.searchsorted(differs, np.arange(n - 1))
    out = np.ones(n, dtype=bool)
    if len(differs):
        out[:-1] = rises[differs[np.minimum(following, len(differs) - 1)]]
    return out


def _deal(positions: np.ndarray, chars: np.ndarray, bins: list[list[np.ndarray]]) -> None:
    """Append positions to the bins of their characters, in the order given."""
    if not len(positions):
        return
    order = np.argsort(chars, kind="stable")
    ranked, positions = chars[order], positions[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    for part, c in zip(np.split(positions, cuts), ranked[np.concatenate([[0], cuts])], strict=True):
        bins[c].append(part)


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that sorted LMS positions ``seeds`` induce."""
    larger_bins: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller_bins: list[list[np.ndarray]] = [[] for _ in range(256)]
    seed_bins: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(seeds, text[seeds], seed_bins)

    def before(positions: np.ndarray, of_smaller: bool) -> tuple[np.ndarray, np.ndarray]:
        """The positions just before, if of the type asked for, and their characters."""
        p = positions[positions > 0] - 1
        p = p[smaller[p] == of_smaller]
        return p, text[p]

    # L types, from small characters to large; a bucket's own additions follow in waves
    for c in range(256):
        waves, wave = [], np.concatenate(larger_bins[c]) if larger_bins[c] else None
        while wave is not None and len(wave):
            waves.append(wave)
            p, chars = before(wave, False)
            wave = p[chars == c]
            _deal(p[chars != c], chars[chars != c], larger_bins)
        larger_bins[c] = [np.concatenate(waves)] if waves else []
        for seed in seed_bins[c]:
            p, chars = before(seed, False)
            _deal(p, chars, larger_bins)
    # S types, from large characters to small and from each bucket's end
    for c in range(255, -1, -1):
        waves, wave = [], np.concatenate(smaller_bins[c]) if smaller_bins[c] else None
        while wave is not None and len(wave):
            waves.append(wave)
            p, chars = before(wave, True)
            wave = p[chars == c]
            _deal(p[chars != c], chars[chars != c], smaller_bins)
        if waves:
            smaller_bins[c] = [np.concatenate(waves)[::-1]]
        for part in larger_bins[c]:
            p, chars = before(part[::-1], True)
            _deal(p, chars, smaller_bins)
    smaller_bins[text[-1]].insert(0, np.array([len(text) - 1]))
    return np.concatenate([part for c in range(256) for part in (*larger_bins[c], *smaller_bins[c])])


def _names(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of sorted substrings text[start : end + 1]; equal ones share a rank."""
    new = np.ones(len(starts), dtype=np.int64)
    lengths = ends - starts + 1
    open_pairs = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
    offset = 0
    while len(open_pairs):
        a, b = starts[open_pairs] + offset, starts[open_pairs - 1] + offset
        same = text[a] == text[b]
        open_pairs = open_pairs[same]
        offset += 1
        ended = lengths[open_pairs] <= offset
        new[open_pairs[ended]] = 0
        open_pairs = open_pairs[~ended]
    return np.cumsum(new) - 1


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (uint8; ends with a unique smallest character) in the order of their suffixes."""
    smaller = smaller_type(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return induce(text, smaller, lms)
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    by_substring = induce(text, smaller, lms)
    ranked = by_substring[is_lms[by_substring]]
    place = np.searchsorted(lms, ranked)
    ends = np.append(lms[1:], len(text) - 1)
    names = np.empty(len(lms), dtype=np.int64)
    names[place] = _names(text, ranked, ends[place])
    span = 1
    while names.max() + 1 < len(lms) and 2 * span < depth:
        follow = np.zeros(len(lms), dtype=np.int64)
        follow[:-span] = names[span:] + 1
        key = names * (names.max() + 2) + follow
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        names[order] = steps
        span *= 2
    return induce(text, smaller, lms[np.argsort(names, kind="stable")])


def permuted_lcp(text: np.ndarray, order: np.ndarray, most: int, separator: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the one before it in ``order`` (-1 for the first) and their common prefix.

    Where i - 1 and its predecessor agree and the predecessor of i is theirs, moved by one, the
    common prefix is one shorter.  Only the other positions, and those after a separator, are
    compared, up to ``most`` characters (at least what is asked for plus the distance of separators).
    """
    n = len(text)
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    alone = np.ones(n, dtype=bool)
    alone[1:] = ((previous[1:] != previous[:-1] + 1) | (previous[:-1] < 0)
                 | (text[:-1] != text[previous[:-1]]) | (text[:-1] == separator))
    heads = np.flatnonzero(alone & (previous >= 0))
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))
    common = np.zeros(len(heads), dtype=np.int64)
    going = np.arange(len(heads))
    while len(going):
        a, b = heads[going] + common[going], previous[heads[going]] + common[going]
        inside = (a < n) & (b < n)
        differ = np.ones(len(going), dtype=np.uint64)
        differ[inside] = eights[a[inside]] ^ eights[b[inside]]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) >> 3)
        common[going] += np.where(inside, same, 0)
        going = going[(differ == 0) & inside & (common[going] < most)]
    lcp = np.zeros(n, dtype=np.int64)
    lcp[heads] = np.minimum(common, most)
    # along each chain the prefix shrinks by one a step
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(alone, at, 0))
    return previous, np.where(previous >= 0, np.maximum(lcp[head] - (at - head), 0), 0)
