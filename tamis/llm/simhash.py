"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

1. Fingerprints: one pass over whole texts; a bit is the majority of the shingles' hashes.
2. Equal fingerprints become one node, so thousands of copies cost what one text costs.
3. Fingerprints within the radius share some blocks of bits whole (pigeonhole), so each node goes
   to the tables of all block choices; a table's bucket is compared on bit planes.  A bucket of
   more than TILE nodes is split into tiles, each pair of tiles being a task's work; nothing is
   capped.
4. A task returns each bucket's spanning stars, never all pairs; components are found from them.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; a
text of fewer words than a shingle is one shingle, one of any length is read whole; repeated rows stay
and get the same group; a null id is never a group's representative unless all ids of the group are
null; an empty table has no groups; other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.llm.bitslice import forest
from tamis.llm.components import components
from tamis.llm.textbytes import LOWER, pieces
from tamis.tables import read

SEED = 42
SHINGLE = 3
RADIUS = 3
PIECE_BYTES = 2 << 20
TILE = 1 << 12

_TABLE = LOWER.tobytes()
#: For each byte a word of eight byte-wide counters, one a bit.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of the whole text if it has fewer words."""
    words = (text or "").encode().translate(_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = max(len(words) - width, 0)
    starts = [0, *(gaps[:last] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, last + 1)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out
    size = counts[full]
    # Byte-wide counters hold 255 hashes; longer runs are cut and their parts added.
    parts = -(-size // 255)
    first = np.cumsum(size) - size
    cut = np.repeat(first, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * 255
    lanes = np.add.reduceat(_SPREAD[hashes.astype("<u8").view(np.uint8)].reshape(-1, 8), cut, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, bits long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text, PIECE_BYTES):
            each = [shingle_hashes(t, width) for t in part.column(text).to_pylist()]
            bits = majorities(np.concatenate(each), np.array([len(x) for x in each], np.int64))
            yield pa.record_batch([part.column(doc_id), pa.array(bits.view(np.int64))], names=[doc_id, "bits"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, bits long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - radius blocks: two values within the radius agree under one of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - radius)]


def spread(keyed: DataFrame, payload: list[str], name: str, tile: int) -> DataFrame:
    """``payload`` and a job number, for work inside buckets (t, key) of at least two rows.

    A bucket of more than ``tile`` rows is cut into tiles by the hash of ``name``; rows of two tiles
    of a bucket meet in one job, and every pair of its tiles has one."""
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("rows_there")).where("rows_there > 1")
    sizes = sizes.withColumn("tiles", F.ceil(F.col("rows_there") / tile).cast("int")).drop("rows_there")
    placed = keyed.join(sizes, ["t", "key"]).withColumn("tile", F.pmod(F.xxhash64(name, "t"), F.col("tiles")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("lo"), F.greatest("tile", o).alias("hi")))
    work = placed.select(*payload, "t", "key", F.explode(every).alias("pair"))
    return work.select(*payload, F.xxhash64("t", "key", "pair.lo", "pair.hi").alias("job"))


def links(spark: SparkSession, nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Edges (a, b) that connect all values of ``nodes.bits`` within the radius: stars, not all pairs."""
    masks = block_masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    tasks = spread(keyed, ["bits"], "bits", TILE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        bits = np.concatenate([b.column(0).to_numpy() for b in got]).view(np.uint64)
        job = np.concatenate([b.column(1).to_numpy() for b in got])
        order = np.lexsort((bits, job))
        bits, job = bits[order], job[order]
        root = forest(bits, job, radius)
        own = np.flatnonzero(root != np.arange(len(bits)))
        yield pa.record_batch([pa.array(bits[own].view(np.int64)), pa.array(bits[root[own]].view(np.int64))], names=["a", "b"])

    return tasks.repartition("job").mapInArrow(compare, "a long, b long")


def groups(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, bits, component_id) of every row; component_id: the least doc_id reachable by links."""
    prints = shared.scratch(spark, "prints")
    marks = shared.table(spark, fingerprints(docs, doc_id=doc_id, text=text, width=width), prints)
    nodes = marks.groupBy("bits").agg(F.min(doc_id).alias("least"))
    edges = links(spark, nodes, radius, blocks=radius + 2)
    star, made = components(spark, edges)
    joined = nodes.join(star, nodes.bits == star.node, "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    tops = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    kept = shared.scratch(spark, "groups")
    known = shared.table(spark, joined.join(tops, "component").select("bits", "component_id"), kept)
    shared.drop(spark, *made)
    return marks.join(known, "bits").select(doc_id, "bits", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
