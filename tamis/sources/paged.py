"""Paged documents (such as PDF): decoded by a reader of one's choice, rebuilt from positioned text here.

A reader takes a file's bytes and gives a dict: ``encrypted`` (true if it cannot be opened without a
password), ``title``, ``pages`` (number, width, height), ``spans`` (page, block, line, span, type,
text, x0, y0, x1, y1, size, flags, font) and ``tables`` (page, y0, y1, rows of nullable cells).  If it
raises, the file cannot be opened.  Files that are refused are rows with a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import document_notes, other_letters, render, render_table, rtl_count, title_of_metadata, title_of_name
from tamis.operators import layout

Reader = Callable[[bytes], dict]

PAGE = "page int, width double, height double"
SPAN = "page int, block int, line int, span int, type int, text string, x0 double, y0 double, x1 double, y1 double, size double, flags int, font string"
TABLE = "page int, y0 double, y1 double, rows array<array<string>>"
DECODED = f"path string, reason string, title string, pages array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, tables array<struct<{TABLE.replace(' ', ':').replace(',:', ',')}>>"


def decode(files: DataFrame, reader: Reader) -> DataFrame:
    """One row for each file (path, content): reason, or title, pages, spans and tables."""
    names = {k: [x.split()[0] for x in schema.split(", ")] for k, schema in (("pages", PAGE), ("spans", SPAN), ("tables", TABLE))}

    def one(path: str, content: bytes) -> dict:
        out = {"path": path, "reason": None, "title": None, "pages": None, "spans": None, "tables": None}
        try:
            got = reader(bytes(content))
        except Exception as e:  # whatever a decoder raises says that the file cannot be read
            return out | {"reason": f"cannot be opened: {e}"}
        if got.get("encrypted"):
            return out | {"reason": "encrypted"}
        if not got.get("pages"):
            return out | {"reason": "no pages"}
        return out | {"title": got.get("title")} | {k: [{n: x.get(n) for n in own} for x in got.get(k, [])] for k, own in names.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(p, c) for p, c in zip(part["path"], part["content"], strict=True)], columns=["path", "reason", "title", "pages", "spans", "tables"])

    return files.select("path", "content").mapInPandas(run, DECODED)


def from_decoded(decoded: DataFrame) -> DataFrame:
    """Documents of decoded files that were not refused."""
    good = decoded.where("reason IS NULL").withColumn("doc", F.col("path"))
    spans = good.select("doc", F.inline("spans"))
    pages = good.select("doc", F.inline("pages"))
    bands = good.select("doc", F.inline("tables"))
    order = Window.partitionBy("doc", "page").orderBy("y0", "y1")
    bands = bands.where(F.size("rows") > 0).withColumn("band", F.row_number().over(order) - 1)
    meta = good.select("doc", F.element_at(F.split("path", "/"), -1).alias("name"), "title")
    text = spans.where("type = 0").select("doc", F.col("text"))
    lines = layout.span_lines(spans.join(directions(text, meta), "doc"), F.col("rtl"))
    # Lines of a page are numbered over its blocks.
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy("doc", "page").orderBy("block", "line"))).select(*layout.LINE)
    return documents(numbered, pages, meta, bands)


def directions(lines: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(doc, rtl): whether most letters of a document run from right to left.  ``every``: documents that must be there."""
    sums = lines.groupBy("doc").agg(F.sum(rtl_count(F.coalesce("text", F.lit("")))).alias("r"), F.sum(other_letters(F.coalesce("text", F.lit("")))).alias("o"))
    found = sums.select("doc", (F.col("r") > F.col("o")).alias("rtl"))
    return found if every is None else every.select("doc").join(found, "doc", "left").select("doc", F.coalesce("rtl", F.lit(False)).alias("rtl"))


#: A page has fewer tables.
TABLES = 1000


def _read(lines: DataFrame, bands: DataFrame | None, rtl: bool) -> DataFrame:
    """(doc, seq, page, text, kind) of clean lines of one direction: order first, then the stretches between tables."""
    ordered = layout.in_reading_order(lines, rtl)
    if bands is None:
        return layout.merge_pages(layout.paragraphs(ordered, rtl))
    split = layout.split_by_bands(ordered, bands)
    key = (F.col("page") * TABLES + F.col("part")).alias("page")
    read = layout.paragraphs(split.select("doc", key, "seq", *[c for c in layout.LINE if c not in ("doc", "page")]), rtl)
    parts = read.select("doc", F.floor(F.col("page") / TABLES).cast("int").alias("page"), (F.col("page") % TABLES).cast("int").alias("part"), "seq", "text", "kind")
    return layout.merge_pages(layout.splice_tables(parts, bands.select("doc", "page", "band", "lines")))


def documents(lines: DataFrame, pages: DataFrame, meta: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Documents (title, content, source_id, kind, notes).

    lines and pages as in layout.py; meta (doc, name, title); bands (doc, page, band, y0, y1, rows), tables
    numbered from 0 on each page."""
    clean = layout.drop_repeated(layout.drop_furniture(lines, pages, layout.furniture(lines, pages))).select(*layout.LINE)
    facing = directions(lines, meta)
    tables = None
    if bands is not None:
        drawn = bands.join(facing, "doc").withColumn("lines", render_table(F.col("rows"), F.col("rtl")))
        tables = drawn.where(F.size("lines") > 0).drop("rows")
        # A band without text still cuts the page.
        bands = drawn.drop("rows")
    marked = clean.join(facing, "doc")
    body = None
    for rtl in (False, True):
        mine = None if bands is None else bands.where(F.col("rtl") == rtl).drop("rtl")
        part = _read(marked.where(F.col("rtl") == rtl).select(*layout.LINE), mine, rtl)
        body = part if body is None else body.unionByName(part)
    ordered = body.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    content = ordered.select("doc", render(F.transform("p", lambda x: x["text"])).alias("content"))
    counts = pages.groupBy("doc").agg(F.countDistinct("page").alias("n"))
    empty = layout.empty_pages(pages, lines).groupBy("doc").agg(F.array_sort(F.collect_list(F.col("page").cast("int"))).alias("empty"))
    many = (tables if tables is not None else lines.limit(0)).groupBy("doc").agg(F.count("*").alias("tables"))
    joined = meta.select("doc", "name", F.col("title").alias("given")).join(content, "doc", "left").join(counts, "doc", "left").join(empty, "doc", "left").join(many, "doc", "left").join(layout.first_page_title(lines), "doc", "left")
    title = F.coalesce(title_of_metadata(F.col("given")), F.nullif(F.col("title"), F.lit("")), title_of_name(F.col("name")))
    notes = document_notes(F.coalesce("n", F.lit(0)), F.coalesce("empty", F.array().cast("array<int>")), F.coalesce("tables", F.lit(0)))
    return joined.select(title.alias("title"), F.coalesce("content", F.lit("")).alias("content"), F.col("doc").alias("source_id"), F.lit("pdf").alias("kind"), notes.alias("notes"))
