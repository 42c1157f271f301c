"""From positioned text to paragraphs: spans, lines, furniture, reading order, paragraphs, titles.

Tables: spans (doc, page, block, line, span, text, x0, x1, y0, y1, size, flags, font), lines (doc,
page, line, text, x0, y0, x1, y1, size, bold), pages (doc, page, height).  Everything that looks
one line back is a window; only reading order, which is recursive, runs in Python, page by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import bare_title, furniture_key, is_junk_title, is_list_item, join_lines, join_spans, rtl_ratio, strip, word_continues, word_count

BOLD_FLAG = 16
# Thresholds of layout, and the marks that end a sentence or a quotation.
ZONE = 0.12
HEADING_WORDS, HEADING_RATIO, BOLD_SHARE = 16, 1.15, 0.3
SIZE_JUMP, SHORT, VERY_SHORT, INDENT, LEAST_INDENT = 0.15, 0.72, 0.5, 0.02, 6.0
SENTENCE_END = ".؟!?:؛;…"
CLOSING = '»")'
NO_HEADING_END = ".،؛,"
LINE = ["doc", "page", "line", "text", "x0", "y0", "x1", "y1", "size", "bold"]


def is_bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(F.lit(BOLD_FLAG)) != 0) | F.coalesce(F.lower(font).rlike("bold|black"), F.lit(False))


def span_lines(spans: DataFrame, rtl: Column | None = None) -> DataFrame:
    """Lines of spans: the union of their boxes, the largest size, bold if all spans are, empty ones too.

    ``rtl``: a column of ``spans`` or a constant.  Where spans have a block type, only text (0) counts."""
    own = spans.where("type = 0") if "type" in spans.columns else spans
    grouped = own.withColumn("__rtl", F.lit(False) if rtl is None else rtl).groupBy("doc", "page", "block", "line").agg(
        F.array_sort(F.collect_list(F.struct("span", "text", "x0", "x1"))).alias("s"), F.first("__rtl").alias("__rtl"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.coalesce(F.max(F.when(F.col("size") > 0, F.col("size"))), F.lit(0.0)).alias("size"), F.bool_and(F.coalesce(is_bold(F.col("flags"), F.col("font")), F.lit(False))).alias("bold"),
    )
    text = join_spans(F.transform("s", lambda s: F.struct(s["text"].alias("text"), s["x0"].alias("x0"), s["x1"].alias("x1"))), F.col("__rtl"))
    return grouped.select("doc", "page", "block", "line", text.alias("text"), "x0", "y0", "x1", "y1", "size", "bold").where("text != ''")


def _in_zone(zone: float) -> Column:
    return (F.col("height") > 0) & ((F.col("y1") <= zone * F.col("height")) | (F.col("y0") >= (1 - zone) * F.col("height")))


def furniture(lines: DataFrame, pages: DataFrame, zone: float = ZONE, share: float = 0.5, compose: bool = True) -> DataFrame:
    """(doc, key): texts at the top or bottom of at least half the pages (two at least) of documents of three pages or more."""
    n = pages.groupBy("doc").agg(F.count("*").alias("n")).where("n >= 3")
    placed = lines.join(pages.select("doc", "page", "height"), ["doc", "page"]).where(_in_zone(zone))
    keyed = placed.select("doc", "page", furniture_key(F.col("text"), compose).alias("key")).where("key != ''")
    seen = keyed.groupBy("doc", "key").agg(F.countDistinct("page").alias("on"))
    return seen.join(n, "doc").where(F.col("on") >= F.greatest(F.lit(2), F.bround(F.col("n") * share))).select("doc", "key")


def drop_furniture(lines: DataFrame, pages: DataFrame, found: DataFrame, zone: float = ZONE, compose: bool = True) -> DataFrame:
    placed = lines.join(pages.select("doc", "page", "height"), ["doc", "page"]).withColumn("__key", F.when(_in_zone(zone), furniture_key(F.col("text"), compose)))
    keys = found.select(F.col("doc").alias("__doc"), F.col("key").alias("__k"))
    return placed.join(keys, (F.col("doc") == F.col("__doc")) & (F.col("__key") == F.col("__k")), "left_anti").drop("height", "__key")


def drop_repeated(lines: DataFrame, compose: bool = True) -> DataFrame:
    """The first of lines that print the same text at the same place of a page."""
    same = Window.partitionBy("doc", "page", "__k", "__x", "__y").orderBy("line")
    keyed = lines.withColumn("__k", furniture_key(F.col("text"), compose)).withColumn("__x", F.bround("x0")).withColumn("__y", F.bround("y0"))
    return keyed.withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__k", "__x", "__y", "__r")


def by_position(lines: DataFrame, rtl: bool = False) -> DataFrame:
    """``seq``: place of a line on its page, from the top, then from the side where reading begins."""
    w = Window.partitionBy("doc", "page").orderBy(F.bround("y0", 1), -F.col("x1") if rtl else F.col("x0"), "line")
    return lines.withColumn("seq", F.row_number().over(w))


# ---- reading order ----

CELLS, QUIET, CORE, GUTTER_SHARE, LEAST_GUTTER = 240, 0.25, 0.2, 0.05, 8.0
COLUMN_LINES, COLUMN_HEIGHT, DEPTH, WIDE = 3, 0.4, 3, 0.6


def gutter(x0: np.ndarray, x1: np.ndarray) -> float | None:
    """The middle of the widest nearly empty stripe in the core of the lines' extent, if it is wide enough."""
    n = len(x0)
    if n < 2 * COLUMN_LINES:
        return None
    left, span = float(x0.min()), float(x1.max() - x0.min())
    if span <= 0:
        return None
    step = span / CELLS
    steps = np.zeros(CELLS + 1, np.int64)
    np.add.at(steps, np.clip(((x0 - left) / step).astype(int), 0, CELLS - 1), 1)
    np.add.at(steps, np.clip(((x1 - left) / step).astype(int), 0, CELLS - 1) + 1, -1)
    quiet = np.concatenate([[False], np.cumsum(steps)[:CELLS] <= int(n * QUIET), [False]])
    edge = np.flatnonzero(quiet[1:] != quiet[:-1]).reshape(-1, 2)  # runs as [from, to)
    middle = left + edge.mean(axis=1) * step
    width = (edge[:, 1] - edge[:, 0]) * step
    width = np.where((middle >= left + CORE * span) & (middle <= left + (1 - CORE) * span), width, 0.0)
    if not len(width) or width.max() <= 0 or width.max() < max(span * GUTTER_SHARE, LEAST_GUTTER):
        return None
    return float(middle[int(width.argmax())])


def reading_order(box: np.ndarray, rtl: bool) -> list[int]:
    """Order of lines (rows x0, y0, x1, y1): wide lines cut the page into bands, gutters cut bands into columns."""

    def placed(rows: np.ndarray) -> np.ndarray:
        x = -box[rows, 2] if rtl else box[rows, 0]
        return rows[np.lexsort((x, np.round(box[rows, 1], 1)))]

    def bands(rows: np.ndarray, cuts: np.ndarray, depth: int) -> list[int]:
        """Rows in order; each cutting line stands alone between the groups around it."""
        rows = placed(rows)
        is_cut = np.isin(rows, cuts)
        out: list[int] = []
        for group in np.split(rows, np.flatnonzero(is_cut | np.concatenate([[False], is_cut[:-1]]))):
            if len(group):
                out += group.tolist() if np.isin(group[0], cuts) else columns(group, depth)
        return out

    def columns(rows: np.ndarray, depth: int) -> list[int]:
        x0, y0, x1, y1 = box[rows].T
        middle = gutter(x0, x1) if depth < DEPTH else None
        if middle is None:
            return placed(rows).tolist()
        crossing = (x0 < middle) & (x1 > middle)
        if crossing.any():
            return bands(rows, rows[crossing], depth + 1)
        sides = [rows[x1 <= middle], rows[x0 >= middle]]
        tall = (y1.max() - y0.min()) * COLUMN_HEIGHT
        fits = all(len(s) >= COLUMN_LINES and box[s, 3].max() - box[s, 1].min() >= tall for s in sides)
        if tall <= 0 or not fits or len(sides[0]) + len(sides[1]) != len(rows):
            return placed(rows).tolist()
        return [i for s in (sides[::-1] if rtl else sides) for i in columns(s, depth + 1)]

    every = np.arange(len(box))
    if not len(every):
        return []
    content = box[:, 2].max() - box[:, 0].min()
    wide = every[box[:, 2] - box[:, 0] >= WIDE * content]
    return bands(every, wide, 0)


def _page_starts(table: pa.Table) -> np.ndarray:
    """Rows that begin a page, in a table sorted by doc and page."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in ("doc", "page"):
        c = table.column(name).combine_chunks()
        differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(c).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(new)


def in_reading_order(lines: DataFrame, rtl: bool = False) -> DataFrame:
    """``seq``: place of each line when its page is read column by column.  Pages come as a stream, one or many a batch."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in lines.schema)}, seq int"

    def ordered(table: pa.Table, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        box = np.column_stack([table.column(k).to_numpy().astype(float) for k in ("x0", "y0", "x1", "y1")])
        seq = np.zeros(end, np.int32)
        for a, b in zip(starts, np.append(starts, end)[1:], strict=True):
            seq[a:b][reading_order(box[a:b], rtl)] = np.arange(1, b - a + 1)
        yield from table.slice(0, end).append_column("seq", pa.array(seq)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = _page_starts(table)
            if len(starts) > 1:  # the last page may go on in the next batch
                yield from ordered(table, starts[:-1], int(starts[-1]))
            held = table.slice(int(starts[-1])) if len(starts) else None
        if held is not None and held.num_rows:
            yield from ordered(held, np.array([0]), held.num_rows)

    return lines.repartition("doc", "page").sortWithinPartitions("doc", "page", "line").mapInArrow(run, schema)


# ---- paragraphs ----


def is_heading(text: Column, size: Column, bold: Column, body: Column, bold_matters: Column) -> Column:
    """Few words without an ending mark that are large, or bold where bold is rare, or Latin capitals."""
    own = strip(text)
    capitals = (rtl_ratio(own) < 0.5) & (F.length(F.regexp_replace(own, "[^A-Z]", "")) >= 4) & ~own.rlike("[a-z]") & (F.length(own) <= 80)
    few = (own != "") & (word_count(own) <= HEADING_WORDS) & ~own.rlike(f"[{NO_HEADING_END}]$")
    large = (body > 0) & ((size >= HEADING_RATIO * body) | (bold_matters & bold & (size >= body)))
    return few & (large | capitals)


def _measure(lines: DataFrame) -> DataFrame:
    """Measures of each page beside its lines."""
    page = Window.partitionBy("doc", "page")
    back = Window.partitionBy("doc", "page").orderBy("seq")
    positive = lambda v: F.median(F.when(v > 0, v)).over(page)
    gap = F.greatest(F.lit(0.0), F.col("y0") - F.lag("y1").over(back))
    one = lines.withColumn("__gap", F.when(F.lag("y1").over(back).isNotNull(), gap))
    return (
        one.withColumn("__body", F.coalesce(positive(F.col("size")), F.lit(0.0)))
        .withColumn("__height", F.coalesce(positive(F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))), F.lit(10.0)))
        .withColumn("__width", F.max(F.greatest(F.lit(0.0), F.col("x1") - F.col("x0"))).over(page))
        .withColumn("__width", F.when(F.col("__width") > 0, F.col("__width")).otherwise(1.0))
        .withColumn("__left", F.min("x0").over(page))
        .withColumn("__right", F.max("x1").over(page))
        .withColumn("__bold", F.avg(F.col("bold").cast("double")).over(page) < BOLD_SHARE)
        .withColumn("__lead", F.coalesce(F.median("__gap").over(page), F.lit(0.0)))
    )


def paragraphs(lines: DataFrame, rtl: bool = False) -> DataFrame:
    """(doc, page, seq, text, kind) of lines with ``seq``: a break is decided from a line and the one before it.

    A page without lines has no paragraphs, and a paragraph without text is left out."""
    m = _measure(lines)
    back = Window.partitionBy("doc", "page").orderBy("seq")
    head = is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("__body"), F.col("__bold"))
    m = m.withColumn("__head", head).withColumn("__list", is_list_item(F.col("text")))
    was = lambda c: F.lag(c).over(back)
    open_word = word_continues(was(F.col("text")))
    indent = F.greatest(INDENT * F.col("__width"), F.lit(LEAST_INDENT))
    near = 0.1 * F.col("__width")
    if rtl:
        indented = (F.col("__right") - F.col("x1") > indent) & (F.col("x0") <= F.col("__left") + near)
    else:
        indented = (F.col("x0") - F.col("__left") > indent) & (F.col("x1") >= F.col("__right") - near)
    before = was(F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")))
    jump = (F.col("__body") > 0) & (was("size") > 0) & (F.col("size") > 0) & (F.abs(F.col("size") - was("size")) / F.col("__body") > SIZE_JUMP)
    limit = F.col("__lead") + F.greatest(F.col("__height") * 0.5, F.lit(1.5))
    ended = strip(was("text")).rlike(f"[{SENTENCE_END}]$")
    starts = (
        was("text").isNull() | F.col("__head") | F.col("__list") | was("__head") | jump
        | (~open_word & indented)
        | (F.col("y0") - was("y1") > limit)
        | (~open_word & (before < VERY_SHORT * F.col("__width")))
        | (~open_word & (before < SHORT * F.col("__width")) & ended)
    )
    marked = m.withColumn("__new", F.coalesce(starts, F.lit(True)))
    numbered = marked.withColumn("__p", F.sum(F.col("__new").cast("int")).over(back))
    kind = F.when(F.col("__head"), "heading").when(F.col("__list"), "list").otherwise("body")
    grouped = numbered.withColumn("__kind", kind).groupBy("doc", "page", "__p").agg(F.array_sort(F.collect_list(F.struct("seq", "text", F.col("__kind").alias("kind")))).alias("l"))
    text = join_lines(F.transform("l", lambda x: x["text"]))
    return grouped.select("doc", "page", F.col("__p").cast("int").alias("seq"), text.alias("text"), F.get("l", F.lit(0))["kind"].alias("kind")).where("text != ''")


def merge_pages(parts: DataFrame) -> DataFrame:
    """(doc, seq, page, text, kind): a page's first paragraph joins the last one before it where a sentence runs on."""
    line = Window.partitionBy("doc").orderBy("page", "seq")
    p = parts.withColumn("__r", F.row_number().over(line))
    was = lambda c: F.lag(c).over(line)
    runs_on = (
        (was("page") != F.col("page")) & (was("kind") == "body") & (F.col("kind") == "body")
        & ~strip(was("text")).rlike(f"[{SENTENCE_END}{CLOSING}]$") & ~F.col("text").rlike(r"^\p{Lu}")
    )
    numbered = p.withColumn("__n", F.sum(F.when(F.coalesce(runs_on, F.lit(False)), 0).otherwise(1)).over(line))
    grouped = numbered.groupBy("doc", "__n").agg(F.array_sort(F.collect_list(F.struct("__r", "page", "text", "kind"))).alias("l"))
    text = join_lines(F.transform("l", lambda x: x["text"]))
    first = F.get("l", F.lit(0))
    return grouped.select("doc", F.col("__n").cast("int").alias("seq"), first["page"].alias("page"), text.alias("text"), first["kind"].alias("kind"))


def document_paragraphs(lines: DataFrame, pages: DataFrame, rtl: bool = False) -> DataFrame:
    """Furniture and repeats dropped, pages read in order, paragraphs built and joined over pages."""
    clean = drop_repeated(drop_furniture(lines, pages, furniture(lines, pages)))
    return merge_pages(paragraphs(in_reading_order(clean.select(*LINE), rtl), rtl))


# ---- tables and titles ----


def split_by_bands(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """``part``: how many table bands (doc, page, band, y0, y1) lie above a line; lines inside a band are dropped."""
    b = bands.select(F.col("doc").alias("__d"), F.col("page").alias("__p"), F.col("y0").alias("__y0"), F.col("y1").alias("__y1"))
    pair = lines.join(b, (F.col("doc") == F.col("__d")) & (F.col("page") == F.col("__p")), "left")
    inside = (F.col("y1") > F.col("__y0")) & (F.col("y0") < F.col("__y1"))
    per = pair.groupBy(*[c for c in lines.columns]).agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("__in"), F.count_if(F.col("__y1") <= F.col("y0")).cast("int").alias("part"))
    return per.where("not __in").drop("__in")


def splice_tables(parts: DataFrame, tables: DataFrame) -> DataFrame:
    """Paragraphs (doc, page, part, seq, text, kind) and the lines of tables (doc, page, band, lines) in the order of the page."""
    rows = tables.select("doc", "page", "band", F.posexplode("lines").alias("at", "text"))
    t = rows.select("doc", "page", F.col("band").alias("part"), (F.col("at") + (1 << 30)).alias("seq"), "text", F.lit("table").alias("kind"))
    order = Window.partitionBy("doc", "page").orderBy("part", "seq")
    return parts.select("doc", "page", "part", "seq", "text", "kind").unionByName(t).withColumn("seq", F.row_number().over(order)).drop("part")


def first_page_title(lines: DataFrame) -> DataFrame:
    """(doc, title): the largest line near the top of the first page, if it is larger than the text and no junk."""
    first = lines.where("page = 1")
    top = Window.partitionBy("doc").orderBy("y0", "line")
    page = Window.partitionBy("doc")
    ranked = first.withColumn("__r", F.row_number().over(top)).withColumn("__n", F.count("*").over(page)).withColumn("__body", F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))).over(page), F.lit(0.0)))
    good = (
        (F.col("__r") <= F.greatest(F.lit(12), F.floor(F.col("__n") / 4))) & (F.col("size") > HEADING_RATIO * F.col("__body"))
        & (word_count(F.col("text")).between(1, HEADING_WORDS)) & ~is_junk_title(F.col("text"))
    )
    return ranked.where(good).groupBy("doc").agg(F.max_by(bare_title(F.col("text")), F.struct("size", -F.col("y0"), -F.col("line"))).alias("title"))


def empty_pages(pages: DataFrame, lines: DataFrame, least: int = 40) -> DataFrame:
    """(doc, page) of pages with fewer than ``least`` characters, those without any line too."""
    chars = lines.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("c"))
    return pages.join(chars, ["doc", "page"], "left").where(F.coalesce("c", F.lit(0)) < least).select("doc", "page")
