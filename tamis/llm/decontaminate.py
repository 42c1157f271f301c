"""Benchmark decontamination with an FM-index per shard of training text.

Each task cuts its rows into shards of bounded size, maps words to the alphabet of the benchmark
(any other word is a separator, which no phrase can contain), builds a suffix array, its
Burrows-Wheeler transform as a wavelet matrix and sampled suffix positions, and searches all
benchmark phrases backwards together.  Occurrences give word spans, which are merged.  No row is
shuffled; phrases are cut by a job of their own and come in blocks of bounded size from the shared
folder, so neither the benchmark nor the corpus has to fit anywhere.  A shard has one index, over the
words of all blocks.

Defined cases: a null text has no words; a text of any length is a shard of its own or part of one; an
item without words has no phrase; an item shorter than the window is one phrase; an item id that occurs
twice counts once per document; a null item id still marks words but is not listed; repeated documents
are judged each for themselves; an empty benchmark hits nothing, an empty table has no reports; other
columns, whatever their names, are kept by ``remove_contamination`` and do not matter otherwise.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.llm.fmindex import FMIndex
from tamis.llm.textbytes import ALNUM, LOWER, flat, forget_powers, pieces, word_bounds, word_hashes
from tamis.tables import read

WINDOW = 10
#: Bytes of text in a shard, and phrases in a block.
SHARD_BYTES = 3 << 19
BLOCK_PHRASES = 1 << 16


def item_words(text: str | None) -> np.ndarray:
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), ALNUM)
    return word_hashes(raw, starts, ends)


@dataclass(frozen=True)
class Phrases:
    """A benchmark cut into windows: the names of its blocks (one for so many phrases), and the length of the shortest phrase."""

    uri: str
    blocks: tuple[str, ...]
    least: int


def write_phrases(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Phrases:
    """Phrases of the benchmark in blocks of the shared folder, and the sorted array of their words."""
    uri = shared.scratch(spark, "phrases")
    most = BLOCK_PHRASES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str | None] = []
        phrases: list[np.ndarray] = []
        owners: list[int] = []

        def close() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            lengths = np.array([len(p) for p in phrases], np.int64)
            wide = np.zeros((len(phrases), window), np.uint64)
            for i, p in enumerate(phrases):
                wide[i, window - len(p) :] = p
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.string())])) as w:
                w.write_batch(pa.record_batch([pa.array(ids, pa.string())], names=["id"]))
            shared.put_bytes(f"{uri}/{name}.ids", sink.getvalue().to_pybytes())
            shared.put_arrays(f"{uri}/{name}", {"words": [wide.ravel()], "lengths": [lengths], "owners": [np.array(owners, np.int64)]})
            words = np.unique(np.concatenate(phrases)).view(np.int64)
            last = ids[-1]
            ids.clear(), phrases.clear(), owners.clear()
            ids.append(last)  # its phrases may go on in the next block
            return pa.record_batch([pa.array([name] + [None] * len(words), pa.string()), pa.array([int(lengths.min())] + [None] * len(words), pa.int64()), pa.array([None, *words.tolist()], pa.int64())], names=["block", "least", "word"])

        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                h = item_words(t)
                if not len(h):
                    continue
                ids.append(i)
                width = min(window, len(h))
                for at in range(len(h) - width + 1):
                    phrases.append(h[at : at + width])
                    owners.append(len(ids) - 1)
                    if len(phrases) >= most:
                        yield close()
        if phrases:
            yield close()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("word").to_numpy().view(np.uint64) for b in batches]
        words = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        shared.put_arrays(f"{uri}/alphabet", {"words": [words]})
        yield pa.record_batch([pa.array([len(words)], pa.int64())], names=["n"])

    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    made = shared.table(spark, items.mapInArrow(cut, "block string, least long, word long"), f"{uri}/made")
    blocks = made.where("block is not null").select("block", "least").orderBy("block").collect()  # one for so many phrases
    # One task sorts the different words: the benchmark's vocabulary.
    made.where("word is not null").select("word").distinct().coalesce(1).mapInArrow(sort, "n long").collect()
    return Phrases(uri, tuple(r.block for r in blocks), min((r.least for r in blocks), default=0))


class Block:
    """Phrases of one block in symbols of the alphabet."""

    def __init__(self, uri: str, name: str, alphabet: np.ndarray):
        with shared.open_read(f"{uri}/{name}.ids") as f:
            self.ids = pa.ipc.open_stream(pa.py_buffer(f.read())).read_all().column(0).to_pylist()
        got = shared.get_arrays(f"{uri}/{name}")
        lengths, owners = np.array(got["lengths"]), np.array(got["owners"])
        words = got["words"].reshape(len(lengths), -1)
        phrases = np.searchsorted(alphabet, words) + 1
        phrases[np.arange(words.shape[1]) < words.shape[1] - lengths[:, None]] = 0
        unique, inverse = np.unique(np.column_stack([lengths, phrases]), axis=0, return_inverse=True)
        self.lengths, self.phrases = unique[:, 0], unique[:, 1:]
        order = np.argsort(inverse.ravel(), kind="stable")
        self.owners = owners[order]
        self.first_owner = np.searchsorted(inverse.ravel()[order], np.arange(len(unique) + 1))


class Searcher:
    """The benchmark's words and blocks, as a task reads them."""

    def __init__(self, phrases: Phrases):
        self.told = phrases
        self.alphabet = shared.get_arrays(f"{phrases.uri}/alphabet")["words"] if phrases.blocks else np.zeros(0, np.uint64)
        self.cache: dict[str, Block] = {}
        # Most words fall out by one bit of a small table before the binary search.
        self.seen = np.zeros(1 << 18, dtype=bool)
        self.seen[(self.alphabet >> np.uint64(46)).astype(np.int64)] = True

    def blocks(self) -> Iterator[Block]:
        for name in self.told.blocks:
            block = self.cache.get(name) or Block(self.told.uri, name, self.alphabet)
            if len(self.told.blocks) <= 4:  # more of them are read again for each shard
                self.cache[name] = block
            yield block

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the alphabet, from 1; 0 is what no phrase contains."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(46)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.alphabet, hashes[maybe]), len(self.alphabet) - 1)
            out[maybe] = np.where(self.alphabet[at] == hashes[maybe], at + 1, 0)
        return out

    def index(self, hashes: np.ndarray, first: np.ndarray) -> tuple[FMIndex, np.ndarray] | None:
        """An index of a shard's words and where its symbols come from; first: rows' first words.  None if no phrase can be there."""
        if not self.told.blocks:
            return None
        symbol = self.symbols(hashes)
        # Runs of alphabet words inside a row; those too short for any phrase need no index.
        inside = symbol > 0
        edge = np.zeros(len(hashes) + 1, dtype=bool)
        edge[first] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        long = ends - starts >= self.told.least
        starts, sizes = starts[long], (ends - starts)[long]
        if not len(starts):
            return None
        heads = np.cumsum(sizes + 1) - sizes - 1  # each run, then a separator
        origin = np.repeat(starts - heads, sizes + 1) + np.arange(int((sizes + 1).sum()))
        text = symbol[np.minimum(origin, len(symbol) - 1)]
        text[heads + sizes] = 0
        return FMIndex(text, len(self.alphabet) + 1), origin


def occurrences(index: FMIndex, origin: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Every (phrase, word index) where a phrase of the block stands in a row."""
    low, high = index.search(block.phrases, block.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = (high - low)[found]
    rows = np.repeat(low[found] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return np.repeat(found, count), origin[index.locate(rows)]


class Hits:
    """What a shard's rows share with the benchmark."""

    def __init__(self, column: pa.Array, searcher: Searcher):
        self.raw, self.offsets = flat(column)
        low = LOWER[self.raw]
        self.starts, self.ends, self.first = word_bounds(low, self.offsets, ALNUM)
        hashes = word_hashes(low, self.starts, self.ends)
        n = len(self.offsets) - 1
        self.items: list[set[str]] = [set() for _ in range(n)]
        cover = np.zeros(len(hashes) + 1, np.int64)
        made = searcher.index(hashes, self.first) if len(hashes) else None
        for block in searcher.blocks() if made else ():
            phrase, word = occurrences(*made, block)
            if not len(phrase):
                continue
            np.add.at(cover, word, 1)
            np.add.at(cover, word + block.lengths[phrase], -1)
            row = np.searchsorted(self.first, word, "right") - 1
            for r, p in np.unique(np.column_stack([row, phrase]), axis=0):
                owners = block.owners[block.first_owner[p] : block.first_owner[p + 1]]
                self.items[r].update(x for x in (block.ids[o] for o in owners) if x is not None)
        self.hit = np.cumsum(cover[:-1]) > 0
        self.n_words = np.diff(self.first)
        total = np.concatenate([[0], np.cumsum(self.hit)])
        self.n_hit = total[self.first[1:]] - total[self.first[:-1]]

    def spans(self, row: int) -> list[tuple[int, int]]:
        """Merged byte ranges of a row, from the first hit word to the last of each run."""
        a, b = self.first[row], self.first[row + 1]
        hit = self.hit[a:b]
        if not hit.any():
            return []
        change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        base = self.offsets[row]
        return [(int(self.starts[a + s] - base), int(self.ends[a + e - 1] - base)) for s, e in change.reshape(-1, 2)]


def _shards(batches: Iterator[pa.RecordBatch], text_col: str, phrases: Phrases) -> Iterator[tuple[pa.RecordBatch, Hits]]:
    searcher = Searcher(phrases)
    for part in pieces(batches, text_col, SHARD_BYTES):
        yield part, Hits(part.column(text_col), searcher)
        forget_powers(2 * SHARD_BYTES)


REPORT = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<first:long,last:long>>"


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its id, words, words inside benchmark phrases, the items, and the byte spans to remove."""
    phrases = write_phrases(spark, benchmark, item_id, item_text, window)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hits in _shards(batches, text, phrases):
            items = [sorted(x) for x in hits.items]
            spans = [[{"first": a, "last": b} for a, b in hits.spans(i)] if c else [] for i, c in enumerate(hits.n_hit)]
            yield pa.record_batch(
                [
                    part.column(doc_id),
                    pa.array(hits.n_words, pa.int64()),
                    pa.array(hits.n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                    pa.array(hits.n_hit > 0),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                ],
                names=[doc_id, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(report, f"`{doc_id}` {kind}, {REPORT}")


def remove_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, length: str | None = None) -> DataFrame:
    """``docs`` with its own columns, the benchmark passages cut from its texts; a text that was nothing else goes.

    ``length``: a column that holds the texts' lengths in characters, set anew where a text changes."""
    phrases = write_phrases(spark, benchmark, item_id, item_text, window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hits in _shards(batches, text, phrases):
            if not (hits.n_hit > 0).any():
                yield part
                continue
            texts = part.column(text).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for i in np.flatnonzero(hits.n_hit):
                raw, at, kept = texts[i].encode(), 0, []
                for a, b in hits.spans(i):
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                texts[i] = b"".join(kept).decode(errors="ignore")
                keep[i] = hits.n_words[i] > hits.n_hit[i]
            yield replace_text(part, text, texts, length).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def replace_text(part: pa.RecordBatch, text: str, texts: list[str | None], length: str | None) -> pa.RecordBatch:
    columns = dict(zip(part.schema.names, part.columns, strict=True))
    columns[text] = pa.array(texts, part.schema.field(text).type)
    if length:
        old, new = part.column(text), columns[text]
        changed = [a != b for a, b in zip(old.to_pylist(), texts, strict=True)]
        given = part.column(length).to_pylist()
        columns[length] = pa.array([len(t or "") if c else g for t, c, g in zip(new.to_pylist(), changed, given, strict=True)], part.schema.field(length).type)
    return pa.record_batch(list(columns.values()), schema=part.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = shared.mark()
    found = decontaminate(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return shared.finish(spark, found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), "hits", mark)


QUERIES = {"op1_decontaminate": op1_decontaminate}

ORACLES = {
    "op1_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM phrases),
windows AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM dw, sizes, unnest(generate_series(1, len(w) - k + 1)) AS s(i) WHERE len(w) >= k),
found AS (SELECT doc_id, i, k, item FROM windows JOIN phrases USING (k, phrase)),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM found), unnest(generate_series(i, i + k - 1)) AS s(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
