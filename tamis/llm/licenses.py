"""License scans: base phrases, and templates with optional and replaceable regions as token automata.

A template is license wording with SPDX-style markup: ``<<beginOptional>> .. <<endOptional>>`` may
be missing, ``<<var;words=a-b>>`` stands for a to b words of any kind.  It compiles to an automaton
over hashed words whose states are the places in the wording; a text is accepted where a run of its
words leads from the first word to the end, so all mandatory wording must be there exactly.  Runs
start only where a template's first two words stand, which are always mandatory.

Defined cases: a null text has no words; a text of any length is read whole; labels are distinct,
sorted and joined by commas, and empty where there are none; without a base place its first and last
word are null; repeated rows are reported each; an empty table has no reports; other columns of the
input, whatever their names, do not matter.  The score is the share of literal wording in the best
accepted span, 0.5 with base phrases alone, else 0; a span is the longest one from its first word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tamis.llm.license_texts import NOTICES, TEXTS
from tamis.llm.textbytes import ALNUM, LOWER, flat, forget_powers, pieces, word_bounds, word_hashes
from tamis.tables import read

PIECE_BYTES = 1 << 20

# The contract's phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

TEMPLATES = TEXTS + NOTICES

MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")


def hashes_of(words: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(words.encode(), np.uint8)]
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), ALNUM)
    return word_hashes(raw, starts, ends)


class Automaton:
    """States are places in the wording; ``steps[s]``: (hash or None for any word, next state); ``free[s]``: states reached without a word."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.steps: list[list[tuple[int | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for m in [*MARK.finditer(template), None]:
            for h in hashes_of(template[at : m.start() if m else len(template)]):
                self._step(int(h))
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(len(self.steps) - 1)
            elif m[1] == "endOptional":
                self.free[opened.pop()].append(len(self.steps) - 1)
            else:
                least, most = int(m[2]), int(m[3])
                places = [len(self.steps) - 1]
                for _ in range(most):
                    self._step(None)
                    places.append(len(self.steps) - 1)
                for p in places[least:-1]:
                    self.free[p].append(places[-1])
        if opened:
            raise ValueError(f"{label}: an optional region does not end")
        self.last = len(self.steps) - 1
        head = [self.steps[i][0][0] if self.steps[i] and not self.free[i] else None for i in (0, 1)]
        if None in head:
            raise ValueError(f"{label}: the first two words must be mandatory")
        self.head = np.array(head, np.uint64)

    def _step(self, h: int | None) -> None:
        self.steps[-1].append((h, len(self.steps)))
        self.steps.append([])
        self.free.append([])

    def _closed(self, states: dict[int, int]) -> dict[int, int]:
        """With what is reached without a word; values: literal words so far, the most of all ways."""
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.free[s]:
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def accept(self, words: np.ndarray) -> tuple[int, int] | None:
        """The longest accepted start of ``words``: its length, and how much of it is literal."""
        states, best = self._closed({0: 0}), None
        for n, w in enumerate(words.tolist(), 1):
            after: dict[int, int] = {}
            for s, literal in states.items():
                for h, t in self.steps[s]:
                    if h is None or h == w:
                        after[t] = max(after.get(t, -1), literal + (h is not None))
            if not after:
                break
            states = self._closed(after)
            if self.last in states:
                best = n, states[self.last]
        return best


REPORT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long>>"


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: its id, base places and labels, all labels, score, and the spans of accepted templates."""
    phrases = [(hashes_of(p), name) for p, name in (BASE if base is None else base).items()]
    automata = [Automaton(*t) for t in (TEMPLATES if templates is None else templates)]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text, PIECE_BYTES):
            data, offsets = flat(part.column(text))
            data = LOWER[data]
            starts, ends, first = word_bounds(data, offsets, ALNUM)
            h = word_hashes(data, starts, ends)
            forget_powers(4 * PIECE_BYTES)
            n = len(offsets) - 1
            row_of = np.repeat(np.arange(n), np.diff(first))
            count = np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_names: list[set[str]] = [set() for _ in range(n)]
            names: list[set[str]] = [set() for _ in range(n)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            score = np.zeros(n)

            def places(what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.flatnonzero(h == what[0])
                for k in range(1, len(what)):
                    at = at[at + k < len(h)]
                    at = at[h[at + k] == what[k]]
                at = at[row_of[at] == row_of[at + len(what) - 1]] if len(at) else at
                return at, row_of[at] if len(at) else at

            for what, name in phrases:
                at, row = places(what)
                np.add.at(count, row, 1)
                np.minimum.at(low, row, at - first[row])
                np.maximum.at(high, row, at - first[row])
                for r in set(row.tolist()):
                    base_names[r].add(name)
                    score[r] = max(score[r], 0.5)
            for a in automata:
                at, row = places(a.head)
                for i, r in zip(at.tolist(), row.tolist(), strict=True):
                    found = a.accept(h[i : min(first[r + 1], i + a.last)])  # no run is longer than its states
                    if found:
                        names[r].add(a.label)
                        spans[r].append({"label": a.label, "first": i - int(first[r]), "words": found[0]})
                        score[r] = max(score[r], found[1] / found[0])
            none = count == 0
            yield pa.record_batch(
                [
                    part.column(doc_id),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(np.where(none, 0, low), pa.int64(), mask=none),
                    pa.array(np.where(none, 0, high), pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in base_names]),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base_names, names, strict=True)]),
                    pa.array(score),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))),
                ],
                names=[doc_id, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, {REPORT}")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op6_licenses": op6_licenses}
ORACLES: dict[str, str] = {}
