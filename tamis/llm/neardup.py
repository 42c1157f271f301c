"""Near-duplicate documents: SimHash fingerprints compared on bit planes, then exact similarity of word shingles.

1. Sketch: one pass gives each text a SimHash fingerprint of BITS bits, MINS minima of its shingle
   hashes under different orders, and a hash of its words; equal texts become one node.  All are taken
   of the set of shingles, as the similarity is: how often one stands in a text changes nothing.
2. At a similarity of 0.8 fingerprints differ in too many bits for tables of whole blocks of bits.
   So texts meet in the buckets of their minima (for one pair in 400,000 these all differ), where
   fingerprints are compared bit-sliced, within RADIUS.  Stars of such pairs give coarse groups.
3. Inside coarse groups pairs within RADIUS are compared by their shingle sets; pairs that are already
   connected are not compared again.  Groups beyond TILE texts are cut into tiles.
4. Components of the verified links are the groups.

Every row has a number of its own by which it is linked and removed; ids only choose who represents.

Defined cases: a null text is empty; texts without words are one group; a text of fewer words than a
shingle is one shingle; texts of any length are compared whole; of a group one row stays, that of
least id (a null id last), and among rows of one id that of least hash of its words, of equal rows
the first; an empty table has no groups; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.llm.bitslice import forest, pairs
from tamis.llm.components import components
from tamis.llm.simhash import majorities, shingle_hashes, spread
from tamis.llm.textbytes import mix, pieces

WIDTH = 5
SIMILARITY = 0.8
#: Texts meet where one of so many minima is alike.
MINS = 8
WORDS = 2
BITS = 64 * WORDS
#: A bit differs with a probability of 0.15 at the wanted similarity, of 0.19 between sets of four and five.  By the
#: binomial tails one pair in six million, of those smallest sets one in 20,000, lies beyond this radius; of unlike
#: pairs one in 16,000 lies within it, and is then told apart by its shingles.
RADIUS = 42
TILE = 1 << 11
PIECE_BYTES = 1 << 19
_ORDERS = mix(np.arange(1, MINS + 1, dtype=np.uint64)) | np.uint64(1)
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, WORDS) fingerprints and (texts, MINS) least hashes of shingle sets; zero where there are none."""
    size = np.array([len(x) for x in sets], np.int64)
    h = np.concatenate(sets)
    bits = np.column_stack([majorities(h, size), majorities(mix(h ^ _SECOND), size)])
    mins = np.zeros((len(sets), MINS), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        first = (np.cumsum(size) - size)[full]
        for k, order in enumerate(_ORDERS):
            mins[full, k] = np.minimum.reduceat(mix(h ^ order), first)
    return bits, mins


def _binary(bits: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in bits], pa.binary())


def _unpacked(batches: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64) for b in batches]).reshape(-1, WORDS)


def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t, width)) for t in texts]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(row, id, whole, bits, keys) of every row of docs (row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", PIECE_BYTES):
            texts = part.column("text").to_pylist()
            bits, mins = prints(_sets(texts, width))
            whole = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            low = (mins & np.uint64(0xFFFFFFFF)).astype(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(low.ravel()), MINS).cast(pa.list_(pa.int64()))
            yield pa.record_batch([part.column("row"), part.column("id"), pa.array(whole, pa.binary()), _binary(bits), keys], names=["row", "id", "whole", "bits", "keys"])

    return docs.select("row", "id", "text").mapInArrow(run, "row long, id long, whole binary, bits binary, keys array<long>")


def _coarse(nodes: DataFrame) -> DataFrame:
    """Star edges between nodes that share a minimum and have fingerprints within the radius."""
    keyed = nodes.select("node", "bits", F.posexplode("keys").alias("t", "key"))
    tasks = spread(keyed, ["node", "bits"], "node", TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        node, job = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in ("node", "job"))
        order = np.lexsort((node, job))
        node, job, bits = node[order], job[order], _unpacked(got)[order]
        root = forest(bits, job, RADIUS)
        own = np.flatnonzero(root != np.arange(len(node)))
        yield pa.record_batch([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])

    return tasks.repartition("job").mapInArrow(run, "a long, b long")


GRAMS = "node long, t int, key long, bits binary, n int, grams binary"


def _shingled(members: DataFrame, width: int) -> DataFrame:
    """Texts (node, part, bits, text) as shingle sets, in a bucket for each part."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", PIECE_BYTES):
            sets = _sets(part.column("text").to_pylist(), width)
            zero = np.zeros(len(sets), np.int32)
            yield pa.record_batch(
                [part.column("node"), pa.array(zero), part.column("part"), part.column("bits"), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["node", "t", "key", "bits", "n", "grams"],
            )

    return members.select("node", "part", "bits", "text").mapInArrow(shingle, GRAMS)


def _views(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of a binary column as arrays that share its memory."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.frombuffer(data, np.uint64, (b - a) // 8, a) if b > a else np.zeros(0, np.uint64)


def _verified(shingled: DataFrame, similarity: float) -> DataFrame:
    """Star edges of texts whose shingle sets are similar, inside each part."""
    tasks = spread(shingled, ["node", "bits", "n", "grams"], "node", TILE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        node, size, job = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in ("node", "n", "job"))
        sets = [x for b in got for x in _views(b.column("grams"))]
        order = np.lexsort((node, job))
        node, size, job, bits = node[order], size[order], job[order], _unpacked(got)[order]
        root = np.arange(len(node))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in pairs(bits, job, RADIUS, root):
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            near = small >= similarity * large
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = find(i), find(j)
                if x == y:
                    continue
                common = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                if common >= similarity * (size[i] + size[j] - common):
                    root[max(x, y)] = min(x, y)
        top = np.array([find(i) for i in range(len(node))])
        own = np.flatnonzero(top != np.arange(len(node)))
        yield pa.record_batch([pa.array(node[own]), pa.array(node[top[own]])], names=["a", "b"])

    return tasks.repartition("job").mapInArrow(compare, "a long, b long")


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written down with a number for each row, the same in every pass; and the name of that column."""
    name = shared.fresh(docs, "row_number")
    return shared.table(spark, docs.withColumn(name, F.monotonically_increasing_id()), shared.scratch(spark, "rows")), name


def _groups(spark: SparkSession, rows: DataFrame, number: str, doc_id: str, text: str, width: int, similarity: float) -> DataFrame:
    """(row, id, component_id, first) of every row; first: the row that represents its group, component_id: the id of that.

    Two texts link if their sets of ``width``-word shingles have at least this Jaccard similarity."""
    folder = shared.scratch(spark, "neardup")
    own = rows.select(F.col(number).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    marks = shared.table(spark, sketches(own, width), f"{folder}/marks")
    # A null id stands last, so that it represents no other.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "whole", "row"))
    nodes = marks.groupBy("whole").agg(F.min("row").alias("node"), least.alias("least"), F.any_value("bits").alias("bits"), F.any_value("keys").alias("keys"))
    nodes = shared.table(spark, nodes, f"{folder}/nodes")
    star, made = components(spark, _coarse(nodes))
    tops = star.select(F.col("component").alias("node"), F.col("component").alias("part")).distinct()
    members = star.select("node", F.col("component").alias("part")).union(tops).join(nodes.select("node", "bits"), "node")
    members = shared.table(spark, members, f"{folder}/members")
    texts = own.join(shared.broadcast_if_small(members), F.col("row") == F.col("node")).select("node", "part", "bits", "text")
    sets = shared.table(spark, _shingled(texts, width), f"{folder}/sets")
    links = shared.table(spark, _verified(sets, similarity), f"{folder}/links")
    shared.release(spark)
    final, more = components(spark, links)
    joined = nodes.join(final, "node", "left").select("whole", "least", F.coalesce("component", nodes.node).alias("component"))
    heads = joined.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    heads = shared.table(spark, heads, f"{folder}/heads")
    known = joined.join(shared.broadcast_if_small(heads), "component", "left").select("whole", F.coalesce("head", "least").alias("head"))
    found = marks.select("row", "id", "whole").join(known, "whole").select("row", "id", F.col("head.id").alias("component_id"), F.col("head.row").alias("first"))
    groups = shared.table(spark, found, f"{folder}/groups")
    shared.drop(spark, *made, *more, *[f"{folder}/{x}" for x in ("nodes", "marks", "links", "sets", "members", "heads")])
    return groups


def near_groups(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row, integer ids; component_id: the least doc_id of the group."""
    rows, number = _numbered(spark, docs.select(doc_id, text))
    found = _groups(spark, rows, number, doc_id, text, width, similarity)
    return found.select(F.col("id").alias(doc_id), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with its own columns; of each group of near copies the row of least id stays."""
    rows, number = _numbered(spark, docs)
    found = _groups(spark, rows, number, doc_id, text, width, similarity)
    losers = shared.table(spark, found.where("row <> first").select(F.col("row").alias(number)), shared.scratch(spark, "losers"))
    return rows.join(shared.broadcast_if_small(losers), number, "left_anti").drop(number)


QUERIES: dict = {}
