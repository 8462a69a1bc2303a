"""CRC-32 of any piece of a byte buffer from two running values (NumPy, inside tasks).

The CRC register is linear over GF(2).  If ``R[i]`` is the register after the
first i bytes, the register of the piece from s to e alone is ``R[e]`` without
what ``R[s]`` has become after e - s zero bytes: the shift cancels all that
stands before the piece, so one scan of the buffer serves every piece of it.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

POLYNOMIAL = 0xEDB88320
ALL_ONES = np.uint32(0xFFFFFFFF)
#: Bytes that are scanned side by side, and shifts with a table of their own.
CHUNK = 256


@cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _advanced(register: np.ndarray) -> np.ndarray:
    """Registers after one zero byte."""
    return _byte_table()[register & np.uint32(255)] ^ (register >> np.uint32(8))


@cache
def _short_shifts() -> np.ndarray:
    """[n, k, v]: the register ``v << 8k`` after n zero bytes, for n below ``CHUNK``."""
    rows = [np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))]
    for _ in range(CHUNK):
        rows.append(_advanced(rows[-1]))
    return np.stack(rows)


def _looked_up(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (table[0][x & np.uint32(255)] ^ table[1][x >> np.uint32(8) & np.uint32(255)]
            ^ table[2][x >> np.uint32(16) & np.uint32(255)] ^ table[3][x >> np.uint32(24)])


@cache
def _long_shift(k: int) -> np.ndarray:
    """Table of the shift by ``CHUNK`` * 2^k zero bytes."""
    if k == 0:
        return _short_shifts()[CHUNK]
    half = _long_shift(k - 1)
    return np.stack([_looked_up(half, half[j]) for j in range(4)])


def shifted(registers: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """Each register after so many zero bytes."""
    short = zero_bytes % CHUNK
    flat = _short_shifts().ravel()
    at = short * 1024
    out = (flat[at + (registers & np.uint32(255))] ^ flat[at + 256 + (registers >> np.uint32(8) & np.uint32(255))]
           ^ flat[at + 512 + (registers >> np.uint32(16) & np.uint32(255))] ^ flat[at + 768 + (registers >> np.uint32(24))])
    rest = np.flatnonzero(zero_bytes >= CHUNK)
    chunks, k = zero_bytes[rest] // CHUNK, 0
    while len(rest):
        odd = rest[chunks & 1 == 1]
        out[odd] = _looked_up(_long_shift(k), out[odd])
        rest, chunks, k = rest[chunks > 1], chunks[chunks > 1] >> 1, k + 1
    return out


def running_registers(data: bytes) -> np.ndarray:
    """The register before the first byte and after every byte of ``data`` (begun at 0)."""
    n = len(data)
    padded = np.zeros(-(-n // CHUNK) * CHUNK, dtype=np.uint8)
    padded[:n] = np.frombuffer(data, dtype=np.uint8)
    columns = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
    view, crc, begun = memoryview(data), 0xFFFFFFFF, []
    for a in range(0, n, CHUNK):
        begun.append(crc ^ 0xFFFFFFFF)
        crc = zlib.crc32(view[a:a + CHUNK], crc)
    register = np.array(begun, dtype=np.uint32)
    out = np.empty((len(begun), CHUNK), dtype=np.uint32)
    table = _byte_table()
    for j in range(CHUNK):
        register = table[(register ^ columns[j]) & np.uint32(255)] ^ (register >> np.uint32(8))
        out[:, j] = register
    return np.concatenate([np.zeros(1, dtype=np.uint32), out.ravel()[:n]])


def piece_crcs(registers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes from each start to each end, as ``zlib.crc32`` has it."""
    return shifted(registers[starts] ^ ALL_ONES, ends - starts) ^ registers[ends] ^ ALL_ONES
