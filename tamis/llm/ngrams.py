"""LM scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark.

    p(w | u v) = max(c(uvw) - D3, 0) / c(uv.) + g3(uv) * p(w | v)
    p(w | v)   = max(n(.vw) - D2, 0) / n(.v.) + g2(v) * p(w)
    p(w)       = max(n(.w) - D1, 0) / n(..) + g1 / (V + 1)

n(.x) is the number of different words before x; each level has three discounts from its counts of
counts.  A document is words and one end token; its first word follows two begin tokens, which are
never predicted.  All training documents are counted, and no count is pruned.

Counting.  Words come first: sorted arrays of 64-bit hashes, cut into parts by hash, in which a
word's place is its number.  Triples of numbers are then sent to the part of their middle word, so
the contexts (u, v) and the pairs (v, w) are whole there.  Each shuffle is pre-aggregated in its
task, packed, and sorted by bucket; a part is settled one bucket after another.  A middle word of
more than HOT_TOKENS tokens (and the begin token) is no one's burden: its triples are spread by
their own hash, and its contexts and pairs by theirs in a second, smaller shuffle.

Storage.  A part is one file of sorted arrays and a table of their places.  Scoring tasks map files
into memory, MOST_OPEN at a time, and look up sorted queries, so a worker holds no model of its own.
A file that the model lists and that is missing is an error.

Defined cases: a null text is empty and consists of its end token; without any training text every
probability is one; a null id is trained on; repeated rows count each; a text may be of any length;
an empty table has no scores; other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.llm.textbytes import LOWER, NONSPACE, flat, forget_powers, mix, pieces, word_bounds, word_hashes
from tamis.tables import read

PIECE_BYTES = 1 << 20
SCORE_BYTES = 1 << 21
#: Tokens that a counting task sorts together; input bytes of a bucket, settled at once, and of a part, a file.
BATCH_TOKENS = 1 << 21
BUCKET_BYTES = 4 << 20
PART_BYTES = 64 << 20
#: A word of more tokens is spread.
HOT_TOKENS = 1 << 22
MOST_OPEN = 128
END = np.uint64(0x2545F4914F6CDD1D)


# ---- packed columns ----


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first is sorted and stored as differences."""
    out = [struct.pack("<q", len(columns[0]))]
    for k, c in enumerate(columns):
        c = np.ascontiguousarray(c if k else np.diff(c, prepend=c.dtype.type(0)))
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<q", raw), 8, []
    for k, t in enumerate(types):
        width = np.dtype(t).itemsize
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(t).ravel()
        out.append(c if k else np.cumsum(c, dtype=c.dtype))
        at += n * width
    return out


def place(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def tally(*keys: np.ndarray, counts: list[np.ndarray] | np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different keys in order, and the sums of each count (without any: how often each is there)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    first = changes(*keys)
    if counts is None:
        sums = [np.diff(np.append(first, len(order)))]
    else:
        sums = [np.add.reduceat(c[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for c in counts]
    return [k[first] for k in keys], sums


def split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers and their rows, in order."""
    order = np.argsort(bucket, kind="stable")
    first = changes(bucket[order])
    for x, y in zip(first, np.append(first, len(bucket))[1:], strict=True):
        yield int(bucket[order[x]]), order[x:y]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's tokens (words, then the end), and rows' token counts."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NONSPACE)
    return np.insert(word_hashes(data, starts, ends), first[1:], END), np.diff(first) + 1


def histories(w: np.ndarray, size: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The token two before and the token before each token of rows of these sizes."""
    first = np.cumsum(size) - size
    v = np.concatenate([[begin], w[:-1]]).astype(w.dtype)[: len(w)]
    v[first] = begin
    u = np.concatenate([[begin], v[:-1]]).astype(w.dtype)[: len(w)]
    u[first] = begin
    return u, v


def triples(u: np.ndarray, v: np.ndarray, w: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Different triples of numbers up to ``most`` in order of (v, u, w), the index of each triple among them, and counts."""
    bits = int(most).bit_length()
    if 3 * bits > 64:
        order = np.lexsort((w, u, v))
        first = changes(v[order], u[order], w[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        at = order[first]
        return u[at], v[at], w[at], back, np.diff(np.append(first, len(order)))
    b = np.uint64(bits)
    key, back, counts = np.unique((v.astype(np.uint64) << b | u.astype(np.uint64)) << b | w.astype(np.uint64), return_inverse=True, return_counts=True)
    mask = np.uint64((1 << bits) - 1)
    return (key >> b & mask).astype(np.int64), (key >> b >> b).astype(np.int64), (key & mask).astype(np.int64), back, counts


def _key(*numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of words' numbers."""
    h = np.full(len(numbers[0]), 0x9E3779B97F4A7C15 * len(numbers) & (1 << 64) - 1, np.uint64)
    for x in numbers:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) ^ x.astype(np.uint64))
    return h


# ---- files of sorted arrays ----


def small(name: str, chunks: list[np.ndarray]) -> dict[str, list[np.ndarray]]:
    """Counts as bytes; those of 255 and more stand aside with their places."""
    at, where, what = 0, [], []
    for c in chunks:
        big = np.flatnonzero(c >= 255)
        where.append(big + at)
        what.append(c[big].astype(np.int64))
        at += len(c)
    return {name: [np.minimum(c, 255).astype(np.uint8) for c in chunks], f"{name}!at": where, f"{name}!is": what}


def values(f: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = f[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = f[f"{name}!is"][np.searchsorted(f[f"{name}!at"], at[big])]
    return out


def lower_bound(a: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first place in a[low:high], sorted, whose value is not below x; for many slices at once."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    x = x.astype(a.dtype)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = a[middle] < x[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def found(a: np.ndarray, at: np.ndarray, end: np.ndarray | int, x: np.ndarray) -> np.ndarray:
    """Whether x stands at its place before the end of its slice."""
    inside = at < end
    out = np.zeros(len(at), dtype=bool)
    out[inside] = a[at[inside]] == x[inside].astype(a.dtype)
    return out


def slices(starts: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to of groups that begin at ``starts``, the last of which ends at ``end``."""
    after = starts[np.minimum(at + 1, len(starts) - 1)].astype(np.int64)
    return starts[at].astype(np.int64), np.where(at + 1 < len(starts), after, end)


class Files:
    """The parts of one kind, mapped on first use; beyond MOST_OPEN the one unused for longest is closed."""

    def __init__(self, uri: str, parts: frozenset[int]):
        self.uri, self.parts = uri, parts
        self.open: dict[int, dict[str, np.ndarray]] = {}

    def get(self, part: int) -> dict[str, np.ndarray] | None:
        """None for a part that was never written, because nothing fell into it."""
        if part not in self.parts:
            return None
        f = self.open.pop(part, None)
        if f is None:
            while len(self.open) >= MOST_OPEN:
                self.open.pop(next(iter(self.open)))
            f = shared.get_arrays(f"{self.uri}/{part}")
        self.open[part] = f
        return f


STATS = ("total", "n1", "n2", "n3")


def stats_of(c: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each group (by its first place): the sum of its counts, and how many are one, two, more."""
    if not len(first):
        return [np.zeros(0, np.int64)] * 4
    return [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2)]


@dataclass(frozen=True)
class Model:
    uri: str
    #: Numbers of words before each part, and all of them.
    base: tuple[int, ...]
    n_tokens: int
    discounts: tuple[tuple[float, float, float], ...]  # of words, pairs, triples
    #: Of the different words' predecessors: their sum, and the mass that discounts set free.
    predecessors: int
    free: float
    hot_tokens: int
    #: Parts that were written, by kind.
    files: dict[str, frozenset[int]] = field(default_factory=dict)

    @property
    def n_types(self) -> int:
        return self.base[-1]

    @property
    def parts(self) -> int:
        return len(self.base) - 1


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from n1..n4; plain ones where a count is zero."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.0), 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)


class Words:
    """Numbers and counts of words by their hashes."""

    def __init__(self, uri: str, base: tuple[int, ...], parts: frozenset[int]):
        self.files, self.base = Files(f"{uri}/words", parts), base

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """h is sorted.  The number of an unknown word is one beyond that of the begin token."""
        number, count = np.full(len(h), self.base[-1] + 1, np.int64), np.zeros(len(h), np.int64)
        for part, rows in split(place(h, len(self.base) - 1)):
            f = self.files.get(part)
            if f is not None:
                at = np.searchsorted(f["hash"], h[rows])
                hit = found(f["hash"], at, len(f["hash"]), h[rows])
                number[rows[hit]] = self.base[part] + at[hit]
                count[rows[hit]] = values(f, "count", at[hit])
        return number, count


# ---- counting ----

ROWS = "kind string, part int, bucket int, blob binary, a long, b long, c long, d long, e long"
_ROW_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.binary()] + [pa.int64()] * 5


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *[None] * (9 - len(r))) for r in rows]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*full, strict=True), _ROW_KINDS, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])


def _sizes(kind: str, c: np.ndarray) -> tuple:
    return (kind, None, None, None, *[int((c == k).sum()) for k in (1, 2, 3, 4)], int(c.sum()))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[str, list[bytes]]]]:
    """(part, bucket, blobs by kind) of rows that come sorted by bucket; one bucket is held at a time."""
    now, held = None, defaultdict(list)
    for batch in batches:
        for kind, part, bucket, blob in zip(*(batch.column(k) for k in ("kind", "part", "bucket", "blob")), strict=True):
            at = part.as_py(), bucket.as_py()
            if at != now:
                if held:
                    yield *now, held
                now, held = at, defaultdict(list)
            held[kind.as_py()].append(blob.as_py())
    if held:
        yield *now, held


def _gather(blobs: list[bytes], *types: str) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(b, *types) for b in blobs), strict=True)]


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.select("kind", "part", "bucket", "blob").repartitionById(parts, "part").sortWithinPartitions("part", "bucket")


class _Part:
    """The arrays of one part, gathered bucket by bucket and written as a file when the part is whole."""

    def __init__(self, uri: str, kind: str):
        self.uri, self.kind, self.part = uri, kind, None
        self.plain: dict[str, list[np.ndarray]] = defaultdict(list)
        self.counts: dict[str, list[np.ndarray]] = defaultdict(list)

    def turn(self, part: int | None) -> list[tuple]:
        """Begin a part; of the one before, if another was, its row."""
        out = []
        if self.part is not None and part != self.part:
            arrays = dict(self.plain)
            for name, chunks in self.counts.items():
                arrays |= small(name, chunks)
            shared.put_arrays(f"{self.uri}/{self.kind}/{self.part}", arrays)
            out = [("file:" + self.kind, self.part)]
            self.plain.clear()
            self.counts.clear()
        self.part = part
        return out


def layout(docs: DataFrame, text: str) -> tuple[int, int]:
    """Parts, and buckets in each, by the size of the input."""
    size = shared.input_bytes(docs, text)
    buckets = max(-(-size // BUCKET_BYTES), 1)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-size // PART_BYTES), min(buckets, 2 * cores))
    return int(parts), int(-(-buckets // parts))


def _count_words(docs: DataFrame, uri: str, parts: int, each: int) -> DataFrame:
    batch_tokens = BATCH_TOKENS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[np.ndarray]) -> pa.RecordBatch:
            (w,), (c,) = tally(np.concatenate(held))
            return _rows([("words", b // each, b, pack(w[r], c[r].astype(np.uint32))) for b, r in split(place(w, parts * each))])

        held, size = [], 0
        for part in pieces(batches, "text", PIECE_BYTES):
            held.append(tokens(part.column("text"))[0])
            forget_powers(4 * PIECE_BYTES)
            size += len(held[-1])
            if size >= batch_tokens:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Part(uri, "words")
        for part, _, blobs in _by_bucket(batches):
            done = out.turn(part)
            h, c = _gather(blobs["words"], "<u8", "<u4")
            (h,), (c,) = tally(h, counts=[c])
            out.plain["hash"].append(h)
            out.counts["count"].append(c)
            yield _rows([*done, ("sum", part, None, None, int(c.sum()), len(c))])
        if done := out.turn(None):
            yield _rows(done)

    return _dealt(docs.select("text").mapInArrow(local, ROWS), parts).mapInArrow(settle, ROWS)


def _count_triples(docs: DataFrame, uri: str, each: int, base: tuple[int, ...], have: frozenset[int], hot_tokens: int) -> DataFrame:
    batch_tokens, parts, n_types = BATCH_TOKENS, len(base) - 1, base[-1]
    wide = "<u4" if n_types < (1 << 32) - 2 else "<u8"
    starts = np.array(base)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(uri, base, have)

        def send(held: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
            h, rank = np.unique(np.concatenate(held), return_inverse=True)
            number, count = words(h)
            # The begin token stands beyond all words and is always spread.
            number, hot = np.append(number, n_types), np.append(count > hot_tokens, True)
            u, v, w, _, c = triples(*histories(rank, np.concatenate(sizes), len(h)), rank, len(h))
            spread = hot[v]
            u, w, v, bucket_of = number[u], number[w], number[v], np.append(place(h, parts * each), 0)[v]
            rows = []
            for kind, own in (("triples", np.flatnonzero(~spread)), ("hot", np.flatnonzero(spread))):
                bucket = bucket_of[own] if kind == "triples" else place(_key(u[own], v[own], w[own]), parts * each)
                for b, r in split(bucket):
                    r = own[r]
                    rows.append((kind, b // each, b, pack(v[r].astype(wide), u[r].astype(wide), w[r].astype(wide), c[r].astype(np.uint32))))
            return _rows(rows)

        held, sizes, size = [], [], 0
        for part in pieces(batches, "text", PIECE_BYTES):
            h, n = tokens(part.column("text"))
            forget_powers(4 * PIECE_BYTES)
            held.append(h)
            sizes.append(n)
            size += len(h)
            if size >= batch_tokens:
                yield send(held, sizes)
                held, sizes, size = [], [], 0
        if size:
            yield send(held, sizes)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Part(uri, "triples")
        n_ctx = n_tri = n_pair = 0
        for part, _, blobs in _by_bucket(batches):
            if part != out.part:
                n_ctx = n_tri = n_pair = 0
            rows = out.turn(part)
            if blobs["triples"]:
                (v, u, w), (c,) = _tally_triples(*_gather(blobs["triples"], wide, wide, wide, "<u4"))
                ctx = changes(v, u)
                word = changes(v[ctx])  # among contexts
                out.plain["u"].append(u[ctx])
                out.plain["w"].append(w)
                out.plain["ctx>triple"].append((ctx + n_tri).astype(np.uint32 if n_tri + len(w) < 1 << 32 else np.uint64))
                out.counts["c"].append(c)
                for name, x in zip(STATS, stats_of(c, ctx), strict=True):
                    out.counts[f"ctx.{name}"].append(x)
                (pv, pw), (n,) = tally(v, w)
                pair = changes(pv)
                out.plain["v"].append(v[ctx[word]])
                out.plain["v>ctx"].append((word + n_ctx).astype(np.uint64))
                out.plain["v>pair"].append((pair + n_pair).astype(np.uint64))
                out.plain["pair.w"].append(pw)
                out.counts["pair.n"].append(n)
                for name, x in zip(STATS, stats_of(n, pair), strict=True):
                    out.counts[f"v.{name}"].append(x)
                n_ctx, n_tri, n_pair = n_ctx + len(ctx), n_tri + len(w), n_pair + len(pw)
                rows += [_sizes("sizes3", c), _sizes("sizes2", n)]
                rows += _predecessors(pw, starts, wide)
            if blobs["hot"]:
                (v, u, w), (c,) = _tally_triples(*_gather(blobs["hot"], wide, wide, wide, "<u4"))
                key = _key(u, v, w)
                order = np.argsort(key)
                out.plain["hot"].append(key[order])
                out.counts["hot.c"].append(c[order])
                rows.append(_sizes("sizes3", c))
                ctx = changes(v, u)
                for b, r in split(place(_key(u[ctx], v[ctx]), parts * each)):
                    rows.append(("contexts", b // each, b, pack(v[ctx[r]], u[ctx[r]], *[x[r].astype(np.uint32 if k else np.uint64) for k, x in enumerate(stats_of(c, ctx))])))
                (pv, pw), (n,) = tally(v, w)
                for b, r in split(place(_key(pv, pw), parts * each)):
                    rows.append(("pairs", b // each, b, pack(pv[r], pw[r], n[r].astype(np.uint32))))
            yield _rows(rows)
        if done := out.turn(None):
            yield _rows(done)

    return _dealt(docs.select("text").mapInArrow(local, ROWS), parts).mapInArrow(settle, ROWS)


def _tally_triples(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different triples in order of (v, u, w) and their counts; a single sort key where the numbers are narrow enough."""
    low = v.min()
    bits = [int(x).bit_length() for x in (v.max() - low, u.max(), w.max())]
    if sum(bits) > 64:
        return tally(v, u, w, counts=[c])
    b, d = np.uint64(bits[1]), np.uint64(bits[2])
    (key,), sums = tally(((v - low).astype(np.uint64) << b | u.astype(np.uint64)) << d | w.astype(np.uint64), counts=[c])
    narrow = lambda x, k: (x & np.uint64((1 << k) - 1)).astype(v.dtype)
    return [narrow(key >> b >> d, bits[0]) + low, narrow(key >> d, bits[1]), narrow(key, bits[2])], sums


def _predecessors(w: np.ndarray, starts: np.ndarray, wide: str) -> list[tuple]:
    """Rows that tell the parts of words how many different words were seen before each."""
    (w,), (n,) = tally(w)
    part = np.searchsorted(starts, w, "right") - 1
    return [("before", p, p, pack(w[r].astype(wide), n[r].astype(np.uint32))) for p, r in split(part)]


def _settle_hot(counted: DataFrame, uri: str, base: tuple[int, ...]) -> DataFrame:
    """Contexts and pairs of spread words."""
    parts, starts = len(base) - 1, np.array(base)
    wide = "<u4" if base[-1] < (1 << 32) - 2 else "<u8"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Part(uri, "hot")
        for part, _, blobs in _by_bucket(batches):
            rows = out.turn(part)
            if blobs["contexts"]:
                v, u, *s = _gather(blobs["contexts"], wide, wide, "<u8", "<u4", "<u4", "<u4")
                (v, u), s = tally(v, u, counts=s)
                key = _key(u, v)
                order = np.argsort(key)
                out.plain["ctx"].append(key[order])
                for name, x in zip(STATS, s, strict=True):
                    out.counts[f"ctx.{name}"].append(x[order])
            if blobs["pairs"]:
                v, w, n = _gather(blobs["pairs"], wide, wide, "<u4")
                (v, w), (n,) = tally(v, w, counts=[n])
                key = _key(v, w)
                order = np.argsort(key)
                out.plain["pair"].append(key[order])
                out.counts["pair.n"].append(n[order])
                first = changes(v)
                s = stats_of(n, first)
                own = np.searchsorted(starts[:-1], v[first], "right") - 1  # the begin token is kept with the last part
                rows += [("stats", p, p, pack(v[first[r]], *[x[r].astype(np.uint64) for x in s])) for p, r in split(own)]
                rows.append(_sizes("sizes2", n))
                rows += _predecessors(w, starts, wide)
            yield _rows(rows or [("none",)])
        if done := out.turn(None):
            yield _rows(done)

    return _dealt(counted.where("kind IN ('contexts', 'pairs')"), parts).mapInArrow(settle, ROWS)


def _settle_predecessors(counted: DataFrame, uri: str, base: tuple[int, ...]) -> DataFrame:
    """How many different words stand before each word, by its place; and what follows spread words."""
    parts = len(base) - 1
    wide = "<u4" if base[-1] < (1 << 32) - 2 else "<u8"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Part(uri, "before")
        for part, _, blobs in _by_bucket(batches):
            rows = out.turn(part)
            n = np.zeros(base[part + 1] - base[part], np.int64)
            for blob in blobs["before"]:
                w, c = unpack(blob, wide, "<u4")
                n[w.astype(np.int64) - base[part]] += c
            out.counts["n"].append(n)
            v, s = np.zeros(0, wide), [np.zeros(0, np.int64)] * 4
            if blobs["stats"]:
                v, *s = _gather(blobs["stats"], wide, "<u8", "<u8", "<u8", "<u8")
                (v,), s = tally(v, counts=s)
            out.plain["hot"].append(v)
            for name, x in zip(STATS, s, strict=True):
                out.plain[name].append(x)
            yield _rows([*rows, _sizes("sizes1", n), ("more", None, None, None, int((n > 2).sum()))])
        if done := out.turn(None):
            yield _rows(done)

    return _dealt(counted.where("kind IN ('before', 'stats')"), parts).mapInArrow(settle, ROWS)


def _sums(rows: DataFrame, kind: str) -> list[int]:
    row = rows.where(F.col("kind") == kind).agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in "abcde"]).first()
    return [int(x) for x in row]


def _written(rows: DataFrame, kind: str) -> frozenset[int]:
    """Numbers of the parts that have a file; as many as there are files."""
    return frozenset(r.part for r in rows.where(F.col("kind") == "file:" + kind).select("part").collect())


def train(spark: SparkSession, docs: DataFrame, *, text: str = "text") -> Model:
    """Count all rows of ``docs``.  The model's arrays stay in the shared folder until ``forget``."""
    own = docs.select(F.col(text).alias("text"))
    parts, each = layout(own, "text")
    uri = shared.scratch(spark, "model")
    words = shared.table(spark, _count_words(own, uri, parts, each), f"{uri}/sums-1")
    shared.release(spark)
    per = {r.part: r for r in words.where("kind = 'sum'").groupBy("part").agg(F.sum("a").alias("tokens"), F.sum("b").alias("types")).collect()}  # one a part
    n_tokens = sum(r.tokens for r in per.values())
    base = (0, *np.cumsum([per[p].types if p in per else 0 for p in range(parts)]).tolist())
    have = _written(words, "words")
    hot_tokens = HOT_TOKENS
    counted = shared.table(spark, _count_triples(own, uri, each, base, have, hot_tokens), f"{uri}/sums-2")
    shared.release(spark)
    hot = shared.table(spark, _settle_hot(counted, uri, base), f"{uri}/sums-3")
    shared.release(spark)
    both = counted.unionByName(hot)
    before = shared.table(spark, _settle_predecessors(both, uri, base), f"{uri}/sums-4")
    shared.release(spark)
    one, two, three = _sums(before, "sizes1"), _sums(both, "sizes2"), _sums(counted, "sizes3")
    d = discounts(one[:4])
    more = _sums(before, "more")[0]
    free = (d[0] * one[0] + d[1] * one[1] + d[2] * more) / one[4] if one[4] else 1.0
    files = {"words": have, "triples": _written(counted, "triples"), "hot": _written(hot, "hot"), "before": _written(before, "before")}
    shared.drop(spark, *[f"{uri}/sums-{k}" for k in (1, 2, 3, 4)])
    return Model(uri, base, n_tokens, (d, discounts(two[:4]), discounts(three[:4])), one[4], free, hot_tokens, files)


# ---- scoring ----


class Scorer:
    """Looks up a batch's words, pairs and triples in the mapped arrays."""

    def __init__(self, m: Model):
        self.m = m
        self.words = Words(m.uri, m.base, m.files["words"])
        self.triples, self.hot, self.before = (Files(f"{m.uri}/{k}", m.files[k]) for k in ("triples", "hot", "before"))
        self.starts = np.array(m.base)

    def __call__(self, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token of rows of these sizes: its count in training, and log10 of its probability."""
        m = self.m
        word, rank = np.unique(h, return_inverse=True)
        number, count = self.words(word)
        low = self._low(number)
        number, hot = np.append(number, m.n_types), np.append(count > m.hot_tokens, True)
        u, v, w, back, _ = triples(*histories(rank, size, len(word)), rank, len(word))
        c = np.zeros((len(w), 10), np.int64)  # of the triple, of its pair, of its context, of its middle word
        spread = hot[v]
        self._cold(number[u], number[v], number[w], np.flatnonzero(~spread), c)
        self._spread(number[u], number[v], number[w], np.flatnonzero(spread), c)
        _, d2, d3 = (np.array([0.0, *d]) for d in m.discounts)
        two = self._mixed(c[:, 1], c[:, 6:], d2, low[w])
        three = self._mixed(c[:, 0], c[:, 2:6], d3, two)
        return count[rank], np.log10(three)[back]

    @staticmethod
    def _mixed(c: np.ndarray, stats: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Discounted counts plus the freed mass times the lower order; the lower order where the context is unknown."""
        total = stats[:, 0]
        some = np.maximum(total, 1)
        gamma = np.where(total > 0, stats[:, 1:] @ d[1:] / some, 1.0)
        return (c - d[np.minimum(c, 3)]) / some + gamma * lower

    def _low(self, number: np.ndarray) -> np.ndarray:
        m = self.m
        n = np.zeros(len(number), np.int64)
        known = np.flatnonzero(number < m.n_types)
        for part, rows in split(np.searchsorted(self.starts, number[known], "right") - 1):
            rows = known[rows]
            n[rows] = values(self.before.get(part), "n", number[rows] - m.base[part])
        d = np.array([0.0, *m.discounts[0]])
        return (n - d[np.minimum(n, 3)]) / max(m.predecessors, 1) + m.free / (m.n_types + 1)

    def _cold(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
        rows = rows[v[rows] < self.m.n_types]
        for part, own in split(np.searchsorted(self.starts, v[rows], "right") - 1):
            f = self.triples.get(part)
            if f is None or "v" not in f:
                continue
            r = rows[own]
            at = np.searchsorted(f["v"], v[r].astype(f["v"].dtype))
            hit = found(f["v"], at, len(f["v"]), v[r])
            r, at = r[hit], at[hit]
            for k, name in enumerate(STATS):
                c[r, 6 + k] = values(f, f"v.{name}", at)
            low, high = slices(f["v>pair"], at, len(f["pair.w"]))
            x = lower_bound(f["pair.w"], low, high, w[r])
            hit = found(f["pair.w"], x, high, w[r])
            c[r[hit], 1] = values(f, "pair.n", x[hit])
            low, high = slices(f["v>ctx"], at, len(f["u"]))
            x = lower_bound(f["u"], low, high, u[r])
            hit = found(f["u"], x, high, u[r])
            r, x = r[hit], x[hit]
            for k, name in enumerate(STATS):
                c[r, 2 + k] = values(f, f"ctx.{name}", x)
            low, high = slices(f["ctx>triple"], x, len(f["w"]))
            x = lower_bound(f["w"], low, high, w[r])
            hit = found(f["w"], x, high, w[r])
            c[r[hit], 0] = values(f, "c", x[hit])

    def _spread(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
        parts = self.m.parts

        def look(files: Files, key: np.ndarray, keys: str, names: tuple[str, ...], column: int) -> None:
            for part, own in split(place(key, parts)):
                f = files.get(part)
                if f is None or keys not in f:
                    continue
                own = own[np.argsort(key[own])]
                at = np.searchsorted(f[keys], key[own])
                hit = found(f[keys], at, len(f[keys]), key[own])
                for k, name in enumerate(names):
                    c[rows[own[hit]], column + k] = values(f, name, at[hit])

        if not len(rows):
            return
        u, v, w = u[rows], v[rows], w[rows]
        look(self.triples, _key(u, v, w), "hot", ("hot.c",), 0)
        look(self.hot, _key(v, w), "pair", ("pair.n",), 1)
        look(self.hot, _key(u, v), "ctx", tuple(f"ctx.{x}" for x in STATS), 2)
        own, back = np.unique(v, return_inverse=True)
        stats = np.zeros((len(own), 4), np.int64)
        for part, r in split(np.searchsorted(self.starts[:-1], own, "right") - 1):
            f = self.before.get(part)
            if f is not None:
                at = np.searchsorted(f["hot"], own[r].astype(f["hot"].dtype))
                hit = found(f["hot"], at, len(f["hot"]), own[r])
                stats[r[hit]] = np.column_stack([f[x][at[hit]] for x in STATS])
        c[rows, 6:] = stats[back]


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(model: Model, docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, its token counts, add-one unigram score and model score (log10 probabilities)."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        scale = (model.n_tokens + model.n_types + 1) or 1
        for part in pieces(batches, text, SCORE_BYTES):
            w, size = tokens(part.column(text))
            forget_powers(2 * SCORE_BYTES)
            count, logs = scorer(w, size)
            first = np.cumsum(size) - size
            base = np.log10((count + 1) / scale)
            sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), base, logs)]
            n = len(size)
            yield pa.record_batch(
                [*(part.column(c) for c in keep), pa.array(size, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(np.full(n, model.n_tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, {SCORES}")


def forget(spark: SparkSession, model: Model) -> None:
    shared.drop(spark, model.uri)


#: Which documents are held out: the remainder of their id's CRC-32.
FOLDS, HELD_OUT = 7, 2


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (fold == HELD_OUT).alias("held_out"))
    model = train(spark, docs.where("not held_out"))
    # Scores are small; with them written, the model can go.
    scores = shared.table(spark, score(model, docs, keep=("doc_id", "held_out")), shared.scratch(spark, "scores"))
    forget(spark, model)
    return scores


QUERIES = {"op4_lm_scores": op4_lm_scores}
ORACLES: dict[str, str] = {}
