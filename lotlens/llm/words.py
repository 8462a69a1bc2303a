"""Vectorised words, word hashes and window hashes of a block of texts (NumPy, inside tasks)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: 64-bit odd multipliers: of the byte polynomial, of the window polynomial, of the finaliser.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Words(NamedTuple):
    """Words of several texts, one after the other."""

    hashes: np.ndarray  # uint64, a word each
    starts: np.ndarray  # byte offsets of the words in the joined texts
    ends: np.ndarray
    first: np.ndarray  # per text, the index of its first word; one more at the end


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


#: Power tables that this worker has made, by base.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n + (n >> 2), base, dtype=np.uint64)
        out[:1] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def _blank_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def find_words(texts: list[bytes]) -> Words:
    """Runs of ``[^\\x20\\x09-\\x0D]`` of each text; no word crosses texts."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    text_ends = np.cumsum(sizes)
    inside = ~_blank_table()[buffer]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first = np.searchsorted(starts, np.concatenate([[0], text_ends]))
    if not len(starts):
        return Words(np.zeros(0, dtype=np.uint64), starts, ends, first)
    # byte polynomial of each word from prefix sums, brought to the word's own origin
    up, down = powers(BYTE_BASE, len(buffer)), powers(pow(BYTE_BASE, -1, 1 << 64), len(buffer))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up)])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return Words(hashes, starts, ends, first)


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and whether those are all of one text.

    Entries whose window would leave the text are meaningless.
    """
    h = words.hashes
    out = np.zeros(len(h), dtype=np.uint64)
    if len(h) >= n:
        total = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            total = total * np.uint64(WORD_BASE) + h[k:len(h) - n + 1 + k]
        out[:len(total)] = mixed(total)
    last = np.repeat(words.first[1:], np.diff(words.first))  # one past the last word of each word's text
    return out, np.arange(len(h)) + n <= last


def blocks(texts: list[bytes], size: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each (a longer text is a range of its own)."""
    out, start, held = [], 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > size:
            out.append((start, k))
            start, held = k, 0
        held += len(text) + 1
    if start < len(texts):
        out.append((start, len(texts)))
    return out
