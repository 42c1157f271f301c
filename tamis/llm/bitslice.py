"""All pairs within a Hamming radius inside groups, on bit planes.

Fingerprints stand vertically: plane p holds bit p of 64 fingerprints a word.  Row i meets row
i + lag by XOR of a plane with itself shifted by the lag, so one word operation serves 64 pairs;
carry-save counters add up the differences, a lane that passes the radius stays marked, and words
whose lanes are all marked are abandoned between rounds of planes.  Many lags are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ROUND = 8
#: Words of one array operation.
CHUNK = 1 << 14
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(values: np.ndarray) -> np.ndarray:
    """(64 k, words + 2) planes of uint64 values (n,) or (n, k); the words at the end are empty."""
    wide = np.ascontiguousarray(values.reshape(len(values), -1))
    n, k = wide.shape
    words = (n + 63) >> 6
    bits = np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    lanes = np.zeros((64 * k, words << 6), np.uint8)
    lanes[:, :n] = bits.T
    out = np.zeros((64 * k, words + 2), np.uint64)
    out[:, :words] = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
    return out


def _flat(root: np.ndarray) -> None:
    """Every index points at the top of its tree."""
    while True:
        up = root[root]
        if (up == root).all():
            return
        root[:] = up


def pairs(values: np.ndarray, groups: np.ndarray, radius: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of values in one group (equal neighbours in ``groups``) at most ``radius`` bits apart.

    ``root``: a forest that the caller extends as pairs come; what it connects by then is left out."""
    n = len(values)
    if n < 2:
        return
    planes = planes_of(values)
    words = (n + 63) >> 6
    ends = np.flatnonzero(np.append(groups[1:] != groups[:-1], True))
    sizes = np.diff(np.concatenate([[-1], ends]))
    rest = np.zeros(words << 6, np.int64)
    rest[:n] = np.repeat(ends, sizes) - np.arange(n)
    rest = rest.reshape(words, 64)
    longest = rest.max(axis=1)
    last = int(longest.max(initial=0))
    active, lag = np.arange(words), 1
    while lag <= last:
        # Neighbours first: in a group of copies they connect all, and nothing is left to do.
        at, lags, size = [], [], 0
        while lag <= last and not (lags and (size >= CHUNK or lags[0][0] == 1)):
            active = active[longest[active] >= lag]
            at.append(active)
            lags.append(np.full(len(active), lag))
            size += len(active)
            lag += 1
        yield from _compare(planes, rest, np.concatenate(at), np.concatenate(lags), radius, root)


def _compare(planes: np.ndarray, rest: np.ndarray, at: np.ndarray, lag: np.ndarray, radius: int, root: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, i + lag) for the lanes i of the words ``at``."""
    wanted = rest[at] >= lag[:, None]
    if root is not None:
        _flat(root)
        i = (at[:, None] << 6) + np.arange(64)
        word, lane = np.nonzero(wanted)
        i = i[word, lane]
        wanted[word, lane] = root[i] != root[i + lag[word]]
    some = wanted.any(axis=1)
    at, lag, wanted = at[some], lag[some], wanted[some]
    if not len(at):
        return
    end = planes.shape[1] - 1
    over = ~np.packbits(wanted, axis=1, bitorder="little").view(np.uint64).ravel()
    bits = max(1, int(radius).bit_length())
    start = (1 << bits) - 1 - radius  # the counter overflows at radius + 1 differences
    counters = [np.full(len(at), FULL if start >> b & 1 else 0, np.uint64) for b in range(bits)]
    low, shift = np.minimum(at + (lag >> 6), end), (lag & 63).astype(np.uint64)
    high, back = np.minimum(low + 1, end), np.uint64(64) - shift
    whole = shift == 0
    for p in range(len(planes)):
        plane = planes[p]
        carried = plane[high] << (back & np.uint64(63))
        carried[whole] = 0
        carry = plane[at] ^ (plane[low] >> shift | carried)
        for b in range(bits):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if p % ROUND == ROUND - 1:
            keep = over != FULL
            if not keep.any():
                return
            if keep.sum() < 0.7 * len(keep):
                at, lag, over, low, high, shift, back, whole = (x[keep] for x in (at, lag, over, low, high, shift, back, whole))
                counters = [c[keep] for c in counters]
    near = np.unpackbits((~over).view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
    word, lane = np.nonzero(near)
    if len(word):
        i = (at[word] << 6) + lane
        yield i, i + lag[word]


def forest(values: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """The least index that each index is connected to by pairs within the radius; pairs are used up as they come."""
    root = np.arange(len(values))
    for a, b in pairs(values, groups, radius, root):
        while True:
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = low != high
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(root, high[open_], low[open_])
            _flat(root)
    _flat(root)
    return root
