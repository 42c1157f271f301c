"""Quality classifier: positive-unlabelled learning with non-negative risk, from sums over all rows.

A document is described by its whole text: shares and sizes that tell its shape, and hashed counts of
its words and of its byte trigrams.  Trusted positives are all rows labelled good; unlabelled are all
rows, their labels unseen.  With the squared loss the unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

depends on the data only through counts, means and products of features, which are summed over all
rows in one pass.  The driver minimises it by steps on those sums, taken back on the negative part
where it falls below zero.  Rows are in two halves by the hash of their id: a model is learnt on
each, and rows of the other half are scored by it.  From histograms of those scores come the share
of positives among the unlabelled (best bin estimation, with a first classifier) and a calibration,
the monotone ratio of both samples' densities; the result is the mean model, so calibrated.

Defined cases: a null or empty text has zero features and gets a score like any other; a text of any
length is described whole; without positives, or without rows to learn from, every score is 0.5 (and
predicted 0); repeated rows count each and score alike; a null id is never trusted; an empty table has
no scores; other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.llm.textbytes import LOWER, NONSPACE, flat, forget_powers, pieces, word_bounds, word_hashes
from tamis.tables import read

PIECE_BYTES = 1 << 20
#: Rows described at once, and bytes whose trigrams are counted at once.
SLICE, STRETCH = 1 << 12, 1 << 20
STEPS, RATE, DECAY = 200, 0.6, 1e-3
BINS, REACH = 2048, 3.0
CUT = 0.7


def _class(test) -> np.ndarray:
    return np.array([bool(test(i)) for i in range(256)])


UPPER = _class(lambda i: 0x41 <= i <= 0x5A)
LETTER = _class(lambda i: 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A or i >= 0x80)
DIGIT = _class(lambda i: 0x30 <= i <= 0x39)
STOP = _class(lambda i: chr(i) in ".,;:!?")
SYMBOL = _class(lambda i: 0x21 <= i <= 0x7E and not LETTER[i] and not DIGIT[i] and not STOP[i])
SHAPE, WORDS, GRAMS = 20, 128, 128
FEATURES = SHAPE + WORDS + GRAMS


def shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, SHAPE): shares and log sizes that describe the shape of each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, first = word_bounds(data, offsets, NONSPACE)
    h = word_hashes(data, starts, ends)
    words = np.diff(first).astype(float)

    def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return x / np.maximum(of, 1)

    row = np.repeat(np.arange(n), np.diff(first))
    tail = data[ends - 1] if len(ends) else data[:0]
    head = data[starts] if len(starts) else data[:0]
    length = (ends - starts).astype(float)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    breaks = (data == 10) if len(data) else np.zeros(0, dtype=bool)
    lines = per_row(breaks, offsets) + 1
    # Lines, and those that stand earlier in the row.
    cut = np.ones(256, dtype=bool)
    cut[10] = False
    ls, le, lf = word_bounds(data, offsets, cut)
    lh = word_hashes(data, ls, le)
    lrow = np.repeat(np.arange(n), np.diff(lf))
    lorder = np.lexsort((lh, lrow))
    lnew = np.ones(len(lh), dtype=bool)
    lnew[1:] = (lh[lorder][1:] != lh[lorder][:-1]) | (lrow[lorder][1:] != lrow[lorder][:-1])
    letters = per_row(LETTER[data], offsets)
    upper_word = UPPER[head] & UPPER[tail] if len(head) else np.zeros(0, dtype=bool)
    distinct = per_row(new, first)
    out = np.column_stack(
        [
            np.log1p(size) / 10,
            np.log1p(words) / 10,
            share(per_row(length, first), words) / 10,
            share(per_row(length * length, first), words) / 100,
            share(per_row(UPPER[data], offsets), letters),
            share(letters, size),
            share(per_row(DIGIT[data], offsets), size),
            share(per_row(STOP[data], offsets), size) * 5,
            share(per_row(SYMBOL[data], offsets), size) * 5,
            share(per_row(SYMBOL[tail], first), words),
            share(per_row(STOP[tail], first), words),
            share(per_row(upper_word, first), words),
            share(per_row(length == 1, first), words),
            share(per_row(again, first), words),
            share(distinct, words),
            share(distinct, words**0.7) / 5,
            share(lines, words),
            1 - share(per_row(lnew, lf), np.diff(lf)),
            share(per_row(data == 124, offsets), words),
            (words < 20).astype(float),
        ]
    )
    return out


def hashed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, WORDS + GRAMS): square roots of the shares of hashed words and byte trigrams, lower-cased."""
    n, low = len(offsets) - 1, LOWER[data]
    starts, ends, first = word_bounds(low, offsets, NONSPACE)
    row = np.repeat(np.arange(n), np.diff(first))
    words = np.bincount(row * WORDS + (word_hashes(low, starts, ends) >> np.uint64(64 - 7)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    grams = np.zeros(n * GRAMS, np.int64)
    for at in range(0, len(low) - 2, STRETCH):
        a, b, c = (low[at + k : min(at + STRETCH, len(low) - 2) + k].astype(np.uint32) for k in range(3))
        key = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 7)
        own = np.repeat(np.arange(n), np.diff(np.clip(offsets, at, at + len(a))))
        inside = offsets[own + 1] - np.arange(at, at + len(a)) >= 3
        grams += np.bincount((own * GRAMS + key)[inside], minlength=n * GRAMS)
    grams = grams.reshape(n, GRAMS)
    return np.sqrt(np.hstack([x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (words, grams)]))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.hstack([shape(data, offsets), hashed(data, offsets)])


def feature_table(spark: SparkSession, docs: DataFrame, text: str, keep: list[str], uri: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, text, PIECE_BYTES):
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                x = features(*flat(part.column(text)))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.record_batch([*(part.column(c) for c in keep), values], names=[*keep, "x"])
            forget_powers(4 * PIECE_BYTES)

    return shared.table(spark, docs.select(*keep, text).mapInArrow(run, f"{kinds}, x array<float>"), uri)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=float).reshape(-1, FEATURES)


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A constant, standardised features, bounded, and squares of those that tell the shape."""
    z = np.clip((x - mean) / scale, -6, 6)
    z[:, SHAPE:] *= 0.5
    return np.hstack([np.ones((len(z), 1)), z[:, :SHAPE], z[:, :SHAPE] ** 2 / 6, z[:, SHAPE:]])


SIZE = 1 + 2 * SHAPE + WORDS + GRAMS


@dataclass(frozen=True)
class Sums:
    """Of a sample: how many rows, their mean, and the mean product of their features."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(a: np.ndarray) -> Sums:
        return Sums(len(a), a.mean(axis=0), a.T @ a / len(a))


def _ridge(n: float) -> np.ndarray:
    out = np.full(SIZE, DECAY + SIZE / n)
    out[0] = 1e-6
    return np.diag(out)


def telling(p: Sums, u: Sums) -> np.ndarray:
    """Labelled against unlabelled, each half the weight: the classifier from which the prior is estimated."""
    return np.linalg.solve((p.products + u.products) / 2 + _ridge(p.n), (p.mean - u.mean) / 2)


def least_risk(p: Sums, u: Sums, prior: float, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights that minimise the non-negative risk with the squared loss (1 - y f)^2 / 4."""
    ridge = _ridge(p.n)
    inverse = np.linalg.inv(u.products + ridge)
    w = np.zeros(SIZE)
    for _ in range(steps):
        up, uu = p.products @ w, u.products @ w
        minus = (1 + 2 * u.mean @ w + w @ uu) / 4 - prior * (1 + 2 * p.mean @ w + w @ up) / 4
        down = (u.mean + uu) / 2 - prior * (p.mean + up) / 2
        # Overfitted: the negative part is taken back.
        gradient = prior * (up - p.mean) / 2 + down if minus >= 0 else -down
        w = w - rate * inverse @ (gradient + ridge @ w / 2)
    return w


def bin_of(f: np.ndarray) -> np.ndarray:
    return np.clip(((f + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)


def best_bin_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u: the least ratio of both samples' shares above a score, with its error bound.  p, u: histograms."""
    above_p, above_u = (np.cumsum(h[::-1])[::-1] / h.sum() for h in (p, u))
    cuts = np.flatnonzero(above_p >= 0.05)
    error = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(p.sum()) + 1 / np.sqrt(u.sum()))
    k = cuts[np.argmin((above_u[cuts] + error) / above_p[cuts])]
    return float(np.clip(above_u[k] / above_p[k], 0.01, 0.99))


def calibration(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """For each bin of scores the share of positives there: prior * p / u, pooled until it rises with the score."""
    blocks: list[list[float]] = []
    for a, b in zip(prior * p / p.sum(), u / u.sum(), strict=True):
        blocks.append([a, b + 1e-12, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            x, y, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x, blocks[-1][1] + y, blocks[-1][2] + k]
    return np.concatenate([np.full(k, min(a / b, 1.0)) for a, b, k in blocks])


@dataclass(frozen=True)
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    #: None: nothing could be learnt.
    weights: np.ndarray | None
    shares: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return self.shares[bin_of(expand(x, self.mean, self.scale) @ self.weights)]


NOTHING = Model(0.5, np.zeros(FEATURES), np.ones(FEATURES), None, np.zeros(0))
_PARTS = "key string, vector binary"


def _summed(rows: DataFrame, per_batch) -> dict[str, np.ndarray]:
    """Sums over all rows of what ``per_batch`` makes of each batch (vectors by key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for key, v in per_batch(batch.slice(at, SLICE)).items():
                    total[key] = total[key] + v if key in total else v
        if total:
            yield shared.vectors(total)

    return shared.add_up(rows.mapInArrow(run, _PARTS))


def train(table: DataFrame, trusted: DataFrame, *, doc_id: str, learn: Column) -> Model:
    """Fit on ``table`` (doc_id, x): positives are rows that ``trusted`` names; both samples obey ``learn``."""
    good = trusted.select(F.col(doc_id).alias("trusted_id")).where("trusted_id is not null").distinct()
    rows = table.where(learn).join(shared.broadcast_if_small(good), F.col(doc_id) == F.col("trusted_id"), "left")
    rows = rows.select("x", F.col("trusted_id").isNotNull().alias("good"), (F.xxhash64(doc_id).bitwiseAND(F.lit(1)) == 1).alias("half"))

    def moments(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = _matrix(batch)
        return {"n": np.array([len(x), float(batch.column("good").true_count)]), "sum": x.sum(axis=0), "square": (x * x).sum(axis=0)}

    m = _summed(rows, moments)
    if not m or m["n"][1] == 0:
        return NOTHING
    mean = m["sum"] / m["n"][0]
    scale = np.sqrt(np.maximum(m["square"] / m["n"][0] - mean * mean, 0)) + 1e-3

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        a = expand(_matrix(batch), mean, scale)
        good_, half = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("good", "half"))
        for h in (0, 1):
            yield f"u{h}", a[half == h]
            yield f"p{h}", a[(half == h) & good_]

    def products(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for key, a in groups(batch):
            out[f"n:{key}"] = np.array([float(len(a))])
            for i, row in enumerate(a.T @ a):  # the first row is the sum: its feature is constant
                out[f"{key}:{i}"] = row
        return out

    got = _summed(rows, products)
    sums = {}
    for key in ("p0", "p1", "u0", "u1"):
        n = float(got[f"n:{key}"][0])
        whole = np.array([got[f"{key}:{i}"] for i in range(SIZE)])
        sums[key] = Sums(n, whole[0] / max(n, 1), whole / max(n, 1))
    # A half without positives borrows the other's.
    for kind in "pu":
        for h in (0, 1):
            if not sums[f"{kind}{h}"].n:
                sums[f"{kind}{h}"] = sums[f"{kind}{1 - h}"]

    def histograms(w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of positives and unlabelled, each row scored by the model of the other half."""

        def count(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = {"p": np.zeros(BINS), "u": np.zeros(BINS)}
            for key, a in groups(batch):
                out[key[0]] += np.bincount(bin_of(a @ w[1 - int(key[1])]), minlength=BINS)
            return out

        h = _summed(rows, count)
        return h["p"], h["u"]

    prior = best_bin_prior(*histograms([telling(sums[f"p{h}"], sums[f"u{h}"]) for h in (0, 1)]))
    w = [least_risk(sums[f"p{h}"], sums[f"u{h}"], prior) for h in (0, 1)]
    return Model(prior, mean, scale, (w[0] + w[1]) / 2, calibration(*histograms(w), prior))


def apply(model: Model, table: DataFrame, keep: list[str], cut: float = CUT) -> DataFrame:
    kinds = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                s = model(_matrix(batch))
                yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    return table.mapInArrow(run, f"{kinds}, score double, predicted int")


#: Rows whose labels are never looked at: the remainder of their id's CRC-32.
FOLDS, HELD_OUT = 4, 2


def remainder(doc_id: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % folds


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = shared.mark()
    docs = read(spark, sf_dir, "documents")
    table = feature_table(spark, docs, "text", ["doc_id"], shared.scratch(spark, "features"))
    learn = remainder("doc_id", FOLDS) != HELD_OUT
    trusted = read(spark, sf_dir, "labels").where(learn).where("quality = 1")
    model = train(table, trusted, doc_id="doc_id", learn=learn)
    scored = apply(model, table, ["doc_id"]).select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
    # Scores are small; with them written, the features can go.
    return shared.finish(spark, scored, "quality", mark)


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
