"""Bit-sliced comparison: bit planes of many fingerprints, and carry-save counters over them, in blocks of 64-bit lanes.

Plane k holds bit k of all members, 64 members a word. One fingerprint against all members is, for each plane, one xor
and about five more operations on whole lanes: a counter of `levels` bits holds ones, twos, fours, ...; at each level two
planes and the level's own bit go through a carry-save adder, so the carry is only made once in two inputs. What is
carried out of the highest level has exceeded the radius 2 ** levels - 1 and stays marked. After every 2 ** levels planes
nothing is pending; rows of a block of which all members have exceeded the radius are then abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fingerprints that are compared with all later members at once.
ROWS = 128
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(fps: np.ndarray) -> np.ndarray:
    """Planes x lanes (uint64) of fingerprints of several words (members x words, uint64)."""
    members, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(members, words * 8), axis=1, bitorder="little")
    lanes = -(-members // 64)
    packed = np.zeros((words * 64, lanes * 8), np.uint8)
    packed[:, : -(-members // 8)] = np.packbits(bits, axis=0, bitorder="little").T
    return packed.view(np.uint64)


def _within(sliced: np.ndarray, own: np.ndarray, levels: int, over: np.ndarray) -> np.ndarray:
    """over (rows x lanes), with the members marked that differ from the rows in over 2 ** levels - 1 bits. own: the rows'
    bits, planes x rows, as words of zeros or ones. Rows that are abandoned stay as they are: all marked."""
    bit: list[np.ndarray] = []
    pending: list[np.ndarray | None] = [None] * levels
    alive = np.arange(len(over))
    out = over.copy()
    for k in range(len(sliced)):
        x = sliced[k] ^ own[k][:, None]
        level = 0
        while level < levels:
            if level == len(bit):
                bit.append(np.zeros_like(x))
            first = pending[level]
            if first is None:
                pending[level] = x
                break
            pending[level] = None
            half = first ^ x
            carry = (first & x) | (half & bit[level])
            bit[level] = half ^ bit[level]
            x, level = carry, level + 1
        else:
            over |= x
        if (k + 1) % (1 << levels) == 0 and k + 1 < len(sliced):
            live = ~(over == _ALL).all(axis=1)
            if not live.all():
                out[alive[~live]] = _ALL
                alive, over, own = alive[live], over[live], own[:, live]
                bit = [b[live] for b in bit]
                if not len(alive):
                    return out
    # What is still pending is added one by one.
    for start in range(levels):
        x, level = pending[start], start
        if x is None:
            continue
        while level < levels:
            if level == len(bit):
                bit.append(np.zeros_like(x))
            x, bit[level] = bit[level] & x, bit[level] ^ x
            level += 1
        over |= x
    out[alive] = over
    return out


def near_pairs(fps: np.ndarray, levels: int, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of all members that differ in at most 2 ** levels - 1 bits, by blocks of rows."""
    members = len(fps)
    sliced = planes(fps)
    lanes = sliced.shape[1]
    for at in range(0, members, rows):
        first, block = at // 64, fps[at : at + rows]
        bits = np.unpackbits(np.ascontiguousarray(block).view(np.uint8).reshape(len(block), -1), axis=1, bitorder="little").T
        own = np.where(bits.astype(bool), _ALL, np.uint64(0))
        over = np.zeros((len(block), lanes - first), np.uint64)
        if members % 64:
            over[:, -1] = _ALL << np.uint64(members % 64)  # no members there
        near = ~_within(sliced[:, first:], own, levels, over)
        r, lane = np.nonzero(near)
        if not len(r):
            continue
        found = np.unpackbits(near[r, lane].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(found)
        i, j = at + r[which], 64 * (first + lane[which]) + bit
        later = j > i
        if later.any():
            yield i[later], j[later]
