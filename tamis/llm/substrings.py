"""Exact removal of repeated substrings, with logarithmic families of suffix arrays.

A byte goes if a string of 100 bytes that covers it also starts earlier: in a document of smaller
id, or earlier in the same one.

1. Whole texts are cut into runs (see suffixes.py): about one suffix for thirty bytes, shipped as two
   symbols, the picked block and the run's content (64 bits of either).  A task merges its batches
   first, so copies inside it leave one entry.  Buckets of blocks take the batches one after another
   into a family of levels; a merge scan reports runs that also stand earlier as a whole.  What
   remains are blocks that stand in different runs, where repeats begin or end: their first places
   are asked for.
2. The texts give the bytes of those runs.  A batch of them gets the array of its suffixes, sorted by
   their bytes, and is scanned along the levels of a second family, which compares bytes as well: a
   match is a window of 100 equal bytes.  A block with more than HOT different runs is spread by window.
3. Ranges are gathered by document and cut out.

A part of the shuffle holds many buckets, in order; one bucket's family is held at a time.  Nothing is
capped, nothing is held by the driver, and each pass ends in a table of the shared folder.

Defined cases: a null text is empty; a text below 100 bytes is kept whole; a text of any length is
compared whole; rows of one id and one text share their places (none is earlier than the other), rows of
one id and different texts stand in the order of the texts' digests; null ids are one id that stands
after all others; ids are integers; an empty table gives no rows; other columns, whatever their names,
are kept by ``remove_repeats`` and do not matter otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.llm.suffixes import BLOCK, LENGTH, Family, Level, level, run_keys, runs, symbols, windows
from tamis.llm.textbytes import flat, forget_powers, pieces
from tamis.tables import read

PIECE_BYTES = 1 << 19
#: Runs that a task sorts together; input bytes of a bucket, whose family is held at once, and of a part, a task's work.
BATCH_RUNS = 1 << 19
BUCKET_BYTES = 2 << 20
PART_BYTES = 32 << 20
#: Different runs of one block from which on its windows are spread over buckets.
HOT = 512
LAST_ID = np.iinfo(np.int64).max

ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("tag", "<u2")])


def layout(docs: DataFrame, text: str) -> tuple[int, int]:
    """Parts, and buckets in each, by the size of the input."""
    buckets = max(-(-shared.input_bytes(docs, text) // BUCKET_BYTES), 1)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-buckets * BUCKET_BYTES // PART_BYTES), min(buckets, 4 * cores))
    return int(parts), int(-(-buckets // parts))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Each part's rows in one task, bucket after bucket."""
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "bucket")


def _bucket_rows(entries: Level, buckets: int) -> tuple[list[int], list[bytes]]:
    """Entries split by their block's place among the buckets; they stay sorted inside."""
    out = np.empty(len(entries), ENTRY)
    out["a"], out["b"] = np.frombuffer(entries.key.tobytes(), ">u8").reshape(-1, 2).T
    for k in ("doc", "at", "tag"):
        out[k] = getattr(entries, k)
    b = ((out["a"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the key
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
    ends = np.append(first[1:], len(b))
    return [int(b[x]) for x in first], [out[x:y].tobytes() for x, y in zip(first, ends, strict=True)]


def _verdicts(doc: np.ndarray, first: np.ndarray, last: np.ndarray, tag: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch(
        [pa.array(doc.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.full(n, -1, np.int32) if tag is None else tag.astype(np.int32))],
        names=["doc", "first", "last", "tag"],
    )


VERDICT = "doc long, first int, last int, tag int"


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges of each document, those that touch or overlap made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order].astype(np.int64), last[order].astype(np.int64)
    same = doc[1:] == doc[:-1]
    # Ranges of one document come in order; their ends rise but for ranges inside others.
    group = np.concatenate([[0], np.cumsum(~same)])
    reach = np.maximum.accumulate(last + group * (1 << 33)) - group * (1 << 33)
    new = np.flatnonzero(np.append(True, ~same | (first[1:] > reach[:-1] + 1)))
    return doc[new], first[new], np.append(reach[new[1:] - 1], reach[-1])


def _sample(docs: DataFrame, key: Column, text: str, parts: int, each: int, length: int, block: int) -> DataFrame:
    """Pass 1, tasks: sorted runs by bucket; and, in rows of bucket -1, runs repeated inside the task."""
    batch_runs = BATCH_RUNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[tuple]) -> pa.RecordBatch:
            a, b, doc, at, tag = (np.concatenate(x) for x in zip(*held, strict=True))
            entries, (d, f, t) = level(symbols(a, b), doc, at, tag)
            names, blobs = _bucket_rows(entries, parts * each)
            places = [x // each for x in names]
            if len(d):
                told = np.column_stack(_joined(d, f, f.astype(np.int64) + (t & 0xFF)))
                for part in np.array_split(told, max(1, len(told) // 4096)):
                    places.append(int(part[0, 0] % parts))
                    names.append(-1)
                    blobs.append(part.tobytes())
            return pa.record_batch([pa.array(places, pa.int32()), pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "bucket", "blob"])

        held, size = [], 0
        for part in pieces(batches, "text", PIECE_BYTES):
            data, offsets = flat(part.column("text"))
            first, last, picked, prefix = runs(data, offsets, length, block)
            if not len(first):
                continue
            a, b = run_keys(prefix, first, last, picked, length, block)
            row = np.searchsorted(offsets, first, "right") - 1
            ids = part.column("doc").to_numpy()
            held.append((a, b, ids[row], (first - offsets[row]).astype(np.uint32), ((last - first) | (picked - first) << 8).astype(np.uint16)))
            size += len(first)
            forget_powers(2 * PIECE_BYTES)
            if size >= batch_runs:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return docs.select(key.alias("doc"), F.col(text).alias("text")).mapInArrow(run, "part int, bucket int, blob binary")


def _settle(sampled: DataFrame, parts: int) -> DataFrame:
    """Pass 1, buckets: runs that also stand earlier (tag -1), and first places of runs whose block stands in others too."""
    hot = HOT

    def told(found) -> Iterator[pa.RecordBatch]:
        for d, f, t in found:
            if len(d):
                yield _verdicts(d, f, f.astype(np.int64) + (t & 0xFF))

    def asked(entries: Level) -> Iterator[pa.RecordBatch]:
        a = np.frombuffer(entries.key.tobytes(), ">u8").reshape(-1, 2)[:, 0]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        sizes = np.diff(np.append(start, len(entries)))
        each = np.repeat(sizes, sizes)
        ask = np.flatnonzero(each > 1)
        if len(ask):
            f = entries.at[ask].astype(np.int64)
            t = entries.tag[ask].astype(np.int64)
            yield _verdicts(entries.doc[ask], f, f + (t & 0xFF), (t >> 8) | (each[ask] > hot).astype(np.int64) << 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family = None, Family()

        def close() -> Iterator[pa.RecordBatch]:
            entries, found = family.close()
            yield from told(found)
            if entries is not None:
                yield from asked(entries)

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                raw = blob.as_buffer()
                if bucket < 0:
                    x = np.frombuffer(raw, np.int64).reshape(-1, 3)
                    yield _verdicts(x[:, 0], x[:, 1], x[:, 2])
                    continue
                if bucket != now:
                    yield from close()
                    now, family = bucket, Family()
                e = np.frombuffer(raw, ENTRY)
                yield from told(family.add(symbols(e["a"], e["b"]), e["doc"], e["at"], e["tag"]))
        yield from close()

    return _dealt(sampled, parts).mapInArrow(run, VERDICT)


def _contexts(docs: DataFrame, asked: DataFrame, key: Column, text: str, parts: int, each: int, length: int, block: int) -> DataFrame:
    """Pass 2, texts: the bytes of asked runs, by bucket of their block; of hot blocks by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            bucket, ids, firsts, blobs = [], [], [], []
            for doc, raw, list_ in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                data = raw.encode()
                for x in list_:
                    first, last, tag = x["first"], x["last"], x["tag"]
                    if tag >> 8:
                        cut = [(p, p, data[p : p + length]) for p in range(first, last + 1)]
                    else:
                        at = first + (tag & 0xFF)
                        cut = [(first, last, data[at : at + block])]
                    for p, q, what in cut:
                        bucket.append(int.from_bytes(hashlib.blake2b(what, digest_size=4).digest(), "little") % (parts * each))
                        ids.append(doc)
                        firsts.append(p)
                        blobs.append(data[p : q + length])
            places = [x // each for x in bucket]
            yield pa.record_batch([pa.array(places, pa.int32()), pa.array(bucket, pa.int32()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "bucket", "doc", "first", "bytes"])

    lists = asked.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("first", "last", "tag")).alias("asked"))
    texts = docs.select(key.alias("doc"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    return texts.join(lists, F.col("doc") == F.col("__doc")).select("doc", "text", "asked").mapInArrow(run, "part int, bucket int, doc long, first int, bytes binary")


#: Contexts whose suffixes are sorted at once.
CONTEXTS = 1 << 13


def _windows(contexts: DataFrame, parts: int, length: int) -> DataFrame:
    """Pass 2, buckets: windows that also stand earlier, compared byte by byte."""

    def told(found) -> Iterator[pa.RecordBatch]:
        for d, f, _ in found:
            if len(d):
                yield _verdicts(*_joined(d, f, f))

    def suffixes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = part.column("bytes")
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        many = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(many)), many)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        place = (part.column("first").to_numpy()[row] + inner).astype(np.uint32)
        return windows(data, (offsets[:-1] - offsets[0])[row] + inner, length), part.column("doc").to_numpy()[row], place, np.zeros(len(row), np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family = None, Family()
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
            at = 0
            for end in ends.tolist():
                if at < end and bucket[at] != now:
                    yield from told(family.close()[1])
                    now, family = bucket[at], Family()
                for x in range(at, end, CONTEXTS):
                    yield from told(family.add(*suffixes(batch.slice(x, min(CONTEXTS, end - x)))))
                at = end
        yield from told(family.close()[1])

    return _dealt(contexts, parts).mapInArrow(run, VERDICT)


def _keyed(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """``docs`` and, in the column ``name``, the place of each row's text: equal for rows of one id and one text, different for all others, in order."""
    plain = F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST_ID)))
    if docs.groupBy(plain.alias("k")).count().where("count > 1").isEmpty():
        return docs.withColumn(name, plain)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    places = docs.select(F.col(doc_id).cast("long").alias("i"), digest.alias("d")).distinct().orderBy(F.col("i").asc_nulls_last(), "d")
    # Numbers rise along the sorted partitions, with gaps between them.
    places = shared.table(spark, places.select(F.struct("i", "d").alias(name), F.monotonically_increasing_id().alias(name + "_place")), shared.scratch(spark, "places"))
    marked = docs.withColumn(name, F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST_ID))).alias("i"), digest.alias("d"), F.col(doc_id).isNull().alias("n")))
    places = places.select(F.struct(F.coalesce(f"{name}.i", F.lit(int(LAST_ID))).alias("i"), F.col(f"{name}.d").alias("d"), F.col(f"{name}.i").isNull().alias("n")).alias(name), name + "_place")
    return marked.join(shared.broadcast_if_small(places), name).drop(name).withColumnRenamed(name + "_place", name)


def repeated(spark: SparkSession, docs: DataFrame, key: str, parts: int, each: int, *, text: str = "text", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc, spans): for each key the starts, first to last, of windows that also stand earlier.  Rows of one key have one text."""
    place = F.col(key)
    folder = shared.scratch(spark, "suffixes")
    settled = shared.table(spark, _settle(_sample(docs, place, text, parts, each, length, block), parts), f"{folder}/runs")
    shared.release(spark)
    contexts = _contexts(docs, settled.where("tag >= 0"), place, text, parts, each, length, block)
    seams = shared.table(spark, _windows(contexts, parts, length), f"{folder}/seams")
    shared.release(spark)
    every = settled.where("tag < 0").select("doc", "first", "last").union(seams.select("doc", "first", "last"))
    return every.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def cut(raw: bytes, spans: list[dict] | None, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed byte ranges, and the bytes that stay."""
    if not spans:
        return [], raw
    pairs = np.array([(x["first"], x["last"] + length) for x in spans], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    ranges = list(zip(pairs[new, 0].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist(), strict=True))
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return ranges, b"".join(kept)


def _with_spans(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, length: int) -> tuple[DataFrame, str]:
    """``docs`` and a column of spans, whose name is given back."""
    key, name = shared.fresh(docs, "text_place"), shared.fresh(docs, "repeated_spans")
    keyed = _keyed(spark, docs, doc_id, text, key)
    # Of the input itself: the optimizer takes a join to be as large as a product.
    parts, each = layout(docs.select(doc_id, text), text)
    spans = repeated(spark, keyed, key, parts, each, text=text, length=length).select(F.col("doc").alias(key), F.col("spans").alias(name))
    return keyed.join(spans, key, "left").drop(key), name


def removed(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (byte ranges), kept (bytes that stay), kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text, PIECE_BYTES):
            size, gone, spans, kept, digest = [], [], [], [], []
            for t, s in zip(part.column(text).to_pylist(), part.column(name).to_pylist(), strict=True):
                raw = (t or "").encode()
                ranges, rest = cut(raw, s, length)
                size.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans.append([{"first": a, "last": b} for a, b in ranges])
                kept.append(rest)
                digest.append(hashlib.sha256(rest).hexdigest())
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.record_batch(
                [part.column(doc_id), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(digest, pa.string())],
                names=[doc_id, "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"],
            )

    own, name = _with_spans(spark, docs.select(doc_id, text), doc_id, text, length)
    kind = docs.schema[doc_id].dataType.simpleString()
    return own.mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,last:long>>, kept binary, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, length_col: str | None = None) -> DataFrame:
    """``docs`` with its own columns and repeats cut from its texts; characters cut in part go whole.  A text that was nothing else goes."""
    from tamis.llm.decontaminate import replace_text

    names = docs.columns
    whole, name = _with_spans(spark, docs, doc_id, text, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text, PIECE_BYTES):
            texts = part.column(text).to_pylist()
            spans = part.column(name).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for i, s in enumerate(spans):
                if s:
                    rest = cut(texts[i].encode(), s, length)[1].decode(errors="ignore")
                    keep[i] = bool(rest.strip())
                    texts[i] = rest
            yield replace_text(part.select(names), text, texts, length_col).filter(pa.array(keep))

    return whole.mapInArrow(run, docs.schema)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = shared.mark()
    found = removed(spark, read(spark, sf_dir, "documents"))
    return shared.finish(spark, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), "repeats", mark)


QUERIES = {"op2_substrings": op2_substrings}
ORACLES: dict[str, str] = {}
