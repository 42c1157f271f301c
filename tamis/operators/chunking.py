"""Chunks of documents: a recursive splitter, title chunks, ids, and replacing a scope's rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import normalize

SIZE, OVERLAP = 120, 16
# Breaks from the widest to none; a break stays at the end of its piece.
BREAKS = ("\n\n", "\n", ". ", "؟ ", "! ", "؛ ", "، ", " ", "")
DEFAULT_TITLE = "(untitled)"

Length = Callable[[str], int]


def words(text: str) -> int:
    return len(text.split())


def _cut(word: str, size: int, length: Length) -> list[str]:
    """A word longer than a chunk, between characters: stretches that fit, of one character at least."""
    out = []
    while word:
        n = len(word)
        while n > 1 and length(word[:n]) > size:
            n = max(1, min(n - 1, n * size // max(length(word[:n]), 1)))
        out.append(word[:n])
        word = word[n:]
    return out


def _pieces(text: str, size: int, length: Length, breaks: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size``, cut at the widest break that makes them fit; joined they are the text."""
    if length(text) <= size or not breaks:
        return [text]
    mark, rest = breaks[0], breaks[1:]
    if mark == "":
        return _cut(text, size, length)
    parts = text.split(mark)
    out: list[str] = []
    for i, p in enumerate(parts):
        whole = p + (mark if i < len(parts) - 1 else "")
        if whole:
            out += _pieces(whole, size, length, rest)
    return out


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, length: Length = words) -> list[str]:
    """Chunks that are stretches of the text, none blank; neighbours share up to ``overlap``."""
    if not text or not text.strip():
        return []
    pieces = _pieces(text, size, length, BREAKS)
    weight = [length(p) for p in pieces]
    chunks, start, end = [], 0, 0
    while end < len(pieces):
        total = 0
        end = start
        while end < len(pieces) and (end == start or total + weight[end] <= size):
            total += weight[end]
            end += 1
        chunk = "".join(pieces[start:end]).strip()
        if chunk:
            chunks.append(chunk)
        if end == len(pieces):
            break
        back, shared = end, 0
        while back - 1 > start and shared + weight[back - 1] <= overlap and shared + weight[back - 1] + weight[end] <= size:
            back -= 1
            shared += weight[back]
        start = back
    return chunks


def splitter(size: int = SIZE, overlap: int = OVERLAP, length: Length = words):
    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_text(t or "", size, overlap, length))

    return run


def with_title(chunks: Column, title: Column, default: str = DEFAULT_TITLE) -> Column:
    """The normalized title as the first chunk, unless it says nothing new."""
    own = normalize(title)
    new = own.isNotNull() & (own != "") & (own != default) & ~F.array_contains(chunks, own)
    return F.when(new, F.concat(F.array(own), chunks)).otherwise(chunks)


def chunk_id(url: Column, ord_: Column, text: Column) -> Column:
    """SHA-256 of url|ord|text; a missing url is the word None."""
    return F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("None")), ord_.cast("string"), text), 256)


def chunk(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, length: Length = words) -> DataFrame:
    """documents (url, title, content) to (chunk_id, scope, ord, text); ords count the title chunk."""
    lists = documents.select("url", with_title(splitter(size, overlap, length)(normalize(F.col("content"))), F.col("title")).alias("chunks"))
    rows = lists.select(F.col("url").alias("scope"), F.posexplode("chunks").alias("ord", "text"))
    return rows.select(chunk_id(F.col("scope"), F.col("ord"), F.col("text")).alias("chunk_id"), "scope", F.col("ord").cast("long").alias("ord"), "text")


def replace_scopes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of the scopes that ``incoming`` has give way to it; a scope that comes empty keeps its old rows."""
    mine = incoming.select(F.col("scope").alias("__s")).distinct()
    kept = existing.join(mine, existing.scope.eqNullSafe(F.col("__s")), "left_anti")
    return kept.unionByName(incoming)
