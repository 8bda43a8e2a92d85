"""Static binary fuse filters: approximate membership of 64-bit keys in about 1.15 x 16 bits a key.

Three places in neighbouring segments of one array are derived from a key by a seeded mix; the exclusive
or of the three 16-bit cells is the key's fingerprint. Construction peels keys that are alone in a cell,
all such keys of a round at once, then fills the cells in reverse order. No key that was added is missed.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three cells of each hash: one in each of three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first.astype(np.int64) * length
    mask = np.uint64(length - 1)
    inside = [(h & mask), ((h >> np.uint64(18)) & mask), ((h >> np.uint64(9)) & mask)]
    return np.stack([base + k * length + inside[k].astype(np.int64) for k in range(3)])


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter of 64-bit keys (any integer dtype of 8 bytes); repeated keys count once."""
    keys = np.unique(np.ascontiguousarray(keys).view(np.uint64))
    n = len(keys)
    length = 1 << max(2, min(18, int(math.floor(math.log(max(2, n)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(3, n)))
    segments = max(1, math.ceil(n * factor / length) - 2)
    for seed in range(1, 200):
        if seed % 8 == 0:  # an unlucky shape: a little more room
            segments += 1 + segments // 16
        cells = (segments + 2) * length
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        where = _places(h, length, segments)
        order = _peel(where, cells, n)
        if order is None:
            continue
        table, prints = np.zeros(cells, dtype=np.uint16), _prints(h)
        for rows, own in reversed(order):
            rest = table[where[0, rows]] ^ table[where[1, rows]] ^ table[where[2, rows]] ^ table[own]
            table[own] = prints[rows] ^ rest
        return _HEAD.pack(seed * 0x9E3779B97F4A7C15 % 2**64, length, segments, n) + table.tobytes()
    raise ValueError("no binary fuse filter found")


def _peel(where: np.ndarray, cells: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell each is alone in), or None if some keys are never alone."""
    count = np.bincount(where.ravel(), minlength=cells)
    member = np.zeros(cells, dtype=np.int64)  # exclusive or of the keys in a cell: the key itself where it is alone
    for k in range(3):
        np.bitwise_xor.at(member, where[k], np.arange(n))
    left, order = n, []
    look = np.flatnonzero(count == 1)
    while left:
        look = look[count[look] == 1]
        if not len(look):
            return None
        rows, at = np.unique(member[look], return_index=True)
        order.append((rows, look[at]))
        left -= len(rows)
        touched = where[:, rows]
        for k in range(3):
            np.subtract.at(count, touched[k], 1)
            np.bitwise_xor.at(member, touched[k], rows)
        look = np.unique(touched)
    return order


def contains(packed: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, False if it was certainly not added."""
    seed, length, segments, n = _HEAD.unpack_from(packed)
    keys = np.ascontiguousarray(keys).view(np.uint64)
    if not n:
        return np.zeros(len(keys), dtype=bool)
    table = np.frombuffer(packed, dtype=np.uint16, offset=_HEAD.size)
    h = _mix(keys, seed)
    where = _places(h, length, segments)
    return (table[where[0]] ^ table[where[1]] ^ table[where[2]]) == _prints(h)
