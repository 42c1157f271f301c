"""Sampled suffixes of whole texts, and a logarithmic family of sorted suffix arrays.

Every window of LENGTH bytes picks its least hashed block of BLOCK bytes (a minimizer); windows
in a row that pick the same block form a run.  Equal windows pick the same block at the same
place, so they can only meet in runs that share it: one suffix in about thirty stands for all.
"""

from __future__ import annotations

import numpy as np

from tamis.llm.textbytes import mix, prefix_hash, range_hash

LENGTH = 100
BLOCK = 32


def runs(data: np.ndarray, offsets: np.ndarray, length: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each run, its picked block, and prefix hashes of the bytes."""
    n, span = len(data), length - block + 1
    prefix = prefix_hash(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, prefix
    at = np.arange(n - block + 1)
    key = range_hash(prefix, at, at + block)
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    key = (key & ~mask) | at.astype(np.uint64)  # ties: the leftmost
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    picked = (key & mask).astype(np.int64)
    # Windows that stay in one row.
    inside = np.zeros(n - length + 2, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(starts):
        return none, none, none, prefix
    picked = picked[starts]
    edge = np.flatnonzero((picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(starts)]]) - 1
    return starts[first], starts[last], picked[first], prefix


def run_keys(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, picked: np.ndarray, length: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shared block, and hash of the run's whole content with the block's place in it."""
    # Picked blocks have small hashes, so they are hashed once more to spread evenly over buckets.
    key = mix(range_hash(prefix, picked, picked + block) ^ np.uint64(0xA0761D6478BD642F))
    whole = range_hash(prefix, first, last + length)
    return key, mix(whole + (picked - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def symbols(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two hashes as one string of sixteen bytes."""
    return np.ascontiguousarray(np.column_stack([a, b]).astype(">u8")).view("S16").ravel()


def windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The suffixes at these places, as far as they matter: strings of ``length`` bytes."""
    if not len(starts):
        return np.zeros(0, f"S{length}")
    return np.lib.stride_tricks.sliding_window_view(data, length)[starts].view(f"S{length}").ravel()


Places = tuple[np.ndarray, np.ndarray, np.ndarray]


class Level:
    """A sorted array of suffixes, each as a string of one fixed width, with the first place of each.

    Strings of one width that differ only in zero bytes at their ends would be equal; of whole width they are not."""

    __slots__ = ("key", "doc", "at", "tag")

    def __init__(self, key, doc, at, tag):
        self.key, self.doc, self.at, self.tag = key, doc, at, tag

    def __len__(self) -> int:
        return len(self.key)


def level(key: np.ndarray, doc: np.ndarray, at: np.ndarray, tag: np.ndarray) -> tuple[Level, Places]:
    """Sort the suffixes of a batch; equal ones become one entry with the first place.  Also: the places of the others."""
    order = np.argsort(key, kind="stable")
    key, doc, at, tag = key[order], doc[order], at[order], tag[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(key)))
    many = np.repeat(sizes > 1, sizes)
    if not many.any():
        return Level(key, doc, at, tag), (doc[:0], at[:0], tag[:0])
    # Only groups of several are put in order of place.
    m = np.flatnonzero(many)
    group = np.repeat(np.arange(len(first)), sizes)[m]
    o = m[np.lexsort((at[m], doc[m], group))]
    doc[m], at[m], tag[m] = doc[o], at[o], tag[o]
    # Rows that share an id share their places: none is earlier than the other.
    later = ~new & ((doc != np.repeat(doc[first], sizes)) | (at != np.repeat(at[first], sizes)))
    return Level(key[first], doc[first], at[first], tag[first]), (doc[later], at[later], tag[later])


def merge(x: Level, y: Level) -> tuple[Level, Places]:
    """One level of two, by a scan of y along x.  Where a suffix stands in both, the earlier place stays; also: the later places."""
    spot = np.searchsorted(x.key, y.key)
    both = np.zeros(len(y), dtype=bool)
    inside = np.flatnonzero(spot < len(x))
    both[inside] = x.key[spot[inside]] == y.key[inside]
    old, now = spot[both], np.flatnonzero(both)
    first = (y.doc[now] < x.doc[old]) | ((y.doc[now] == x.doc[old]) & (y.at[now] < x.at[old]))
    apart = (y.doc[now] != x.doc[old]) | (y.at[now] != x.at[old])
    later = tuple(np.where(first, getattr(x, k)[old], getattr(y, k)[now])[apart] for k in ("doc", "at", "tag"))
    for k in ("doc", "at", "tag"):
        getattr(x, k)[old[first]] = getattr(y, k)[now[first]]
    # What is new goes between the entries of x.
    rest = np.flatnonzero(~both)
    slot = spot[rest] + np.arange(len(rest))
    kept = np.ones(len(x) + len(rest), dtype=bool)
    kept[slot] = False
    out = []
    for k in Level.__slots__:
        a, b = getattr(x, k), getattr(y, k)
        c = np.empty(len(kept), a.dtype)
        c[kept], c[slot] = a, b[rest]
        out.append(c)
    return Level(*out), later


class Family:
    """Levels of doubling size.  A new batch is sorted into a level of its own and merged with levels
    of its size, as a binary counter carries; each merge scan reports the places whose suffix also
    stands in an earlier place."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, key, doc, at, tag) -> list[Places]:
        new, later = level(key, doc, at, tag)
        found = [later]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new, later = merge(self.levels.pop(), new)
            found.append(later)
        self.levels.append(new)
        return found

    def close(self) -> tuple[Level | None, list[Places]]:
        """Merge all levels into one."""
        found = []
        while len(self.levels) > 1:
            y, x = self.levels.pop(), self.levels.pop()
            new, later = merge(x, y)
            self.levels.append(new)
            found.append(later)
        return (self.levels[0] if self.levels else None), found
