import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import layout
from tamis.sources import files, store, web

LONG = "this paragraph is long enough to be kept"


@pytest.mark.parametrize(
    ("html", "title", "paragraphs"),
    [
        (f"<title> T </title><article><p>{LONG}<p>{LONG} two</article><p>{LONG} outside", "T", [LONG, LONG + " two"]),
        (f"<meta property='og:title' content='OG'><title>T</title><nav><p>{LONG}</p></nav><p>{LONG} a</p>", "OG", [LONG + " a"]),
        (f"<article><p>short</p></article><div class='x content'><p><b>{LONG}</b> tail &amp; more</p></div>", web.UNTITLED, [LONG + " tail & more"]),
        (f"<script>var t='<p>{LONG}</p>'</script><header><title>inside</title></header><p>{LONG}</p>", "inside", [LONG]),
        ("", web.UNTITLED, []),
    ],
)
def test_html(html, title, paragraphs):
    assert web.read_html(html) == {"title": title, "paragraphs": paragraphs}


def test_articles_and_fetch(spark):
    pages = spark.createDataFrame([("u", f"<title>ي</title><p>{LONG}</p><p>{LONG}"), ("v", None)], "url string, html string")
    got = {r.source_id: (r.title, r.content) for r in web.articles(pages).collect()}
    assert got["u"] == ("ی", f"{LONG}\n\n{LONG}") and got["v"][1] == ""

    def fetcher(u):
        if u == "v":
            raise OSError("no")
        return "page"

    rows = {r.url: (r.html, r.error) for r in web.fetch(pages, fetcher).collect()}
    assert rows == {"u": ("page", None), "v": (None, "OSError: no")}


def test_files(spark, tmp_path):
    (tmp_path / "My_file.TXT").write_bytes("one\r\n\r\n two  ي\n\n\n".encode())
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    assert files.suffixes() == [".markdown", ".md", ".pdf", ".txt"]
    docs, refused = files.load(spark, str(tmp_path))
    assert {r.title: r.content for r in docs.collect()} == {"My file": "one\n\ntwo ی", "a": "# x"}
    assert {r.path.rsplit("/", 1)[1]: r.reason.split(";")[0] for r in refused.collect()} == {"bad.txt": "not UTF-8", "b.exe": "unknown suffix", "p.pdf": "no reader of paged files is given"}
    base = files.baseline(docs)
    assert files.baseline_diff(base, base).count() == 0
    assert files.baseline_diff(base, base.withColumn("title", F.lit("z"))).count() == 2


def test_baseline_file(spark, tmp_path):
    path = f"file://{tmp_path}/baseline"
    docs = spark.createDataFrame([("u", "T", "one\n\ntwo"), ("v", "T", "")], "source_id string, title string, content string")
    assert files.update_baseline(spark, docs, path).count() == 2  # not written
    assert files.update_baseline(spark, docs, path, write=True).count() == 2
    assert files.update_baseline(spark, docs, path).count() == 0
    assert {r.name: r.paragraphs for r in spark.read.json(path).collect()} == {"u": 2, "v": 0}
    assert [r.name for r in files.update_baseline(spark, docs.withColumn("title", F.when(F.col("source_id") == "u", "new").otherwise("T")), path, write=True).collect()] == ["u"]
    assert files.update_baseline(spark, docs, path).count() == 1


def test_paged_files(spark, tmp_path):
    for name in ("good_one.pdf", "locked.pdf", "none.PDF", "broken.pdf"):
        (tmp_path / name).write_bytes(name.encode())

    def reader(content):
        if content.startswith(b"broken"):
            raise ValueError("bad xref")
        if content.startswith(b"locked"):
            return {"encrypted": True, "pages": [{"page": 1}]}
        if content.startswith(b"none"):
            return {"pages": []}
        line = lambda page, k, text, y, kind=0: {"page": page, "block": k, "line": 0, "span": 0, "type": kind, "text": text, "x0": 40.0, "x1": 400.0, "y0": y, "y1": y + 10, "size": 10.0, "flags": 0, "font": "F"}
        spans = [line(p, k, f"ﬁne words of page {p} line {k} that go on", 60.0 + 12 * k) for p in (1, 2) for k in range(3)]
        spans += [line(2, 3, "inside the table", 130.0), line(2, 4, "after the table all ends.", 160.0), line(2, 5, "image", 200.0, 1)]
        return {"title": "untitled", "pages": [{"page": p, "width": 500.0, "height": 700.0} for p in (1, 2)], "spans": spans, "tables": [{"page": 2, "y0": 120.0, "y1": 150.0, "rows": [["n", "v"], ["x", None], ["y", "2"]]}]}

    docs, refused = files.load(spark, str(tmp_path), reader)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in refused.collect()} == {"locked.pdf": "encrypted", "none.PDF": "no pages", "broken.pdf": "cannot be opened: bad xref"}
    (got,) = docs.collect()
    assert (got.title, got.kind, got.notes) == ("good one", "pdf", ["tables: 1"])
    parts = got.content.split("\n\n")
    assert parts[1:] == ["n | v", "n: x", "n: y | v: 2", "after the table all ends."]
    assert parts[0].startswith("fine words of page 1 line 0") and "page 2 line 2" in parts[0]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    rows = lambda *x: spark.createDataFrame(list(x), "scope string, ord long, text string")
    store.upsert(spark, path, rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")))
    store.upsert(spark, path, rows(("a", 0, "new")))
    store.upsert(spark, path, rows().limit(0))
    assert [(r.ord, r.text) for r in store.read_scope(spark, path, "a").collect()] == [(0, "new")]
    assert store.read_scope(spark, path).count() == 2
    # Many scopes in few parts; a reader keeps what it began with while another state is written.
    store.upsert(spark, path, rows(*[(f"s{i}", i, "t") for i in range(100)]), parts=7)
    before = store.read_scope(spark, path)
    store.upsert(spark, path, rows(("s3", 0, "n"), ("zz", 1, "m")))
    assert store.read_scope(spark, path).count() == 103 and store.read_scope(spark, path, "s3").first().text == "n"
    assert store.read_scope(spark, path, "absent").count() == 0 and before.columns == ["scope", "ord", "text"]
    # Rows that come from the store itself go back into it.
    store.upsert(spark, path, store.read_scope(spark, path).withColumn("text", F.upper("text")))
    assert store.read_scope(spark, path).where("text <> upper(text)").count() == 0 and store.read_scope(spark, path).count() == 103


def frame(spark, rows):
    return spark.createDataFrame([("d", 1, i, *r) for i, r in enumerate(rows)], "doc string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean")


def test_columns_are_read_one_after_the_other(spark):
    rows = [("head", 40.0, 0.0, 560.0, 10.0, 10.0, False)]
    rows += [(f"{side}{i}", x, 20.0 + 12 * i, x + 230, 30.0 + 12 * i, 10.0, False) for i in range(8) for side, x in (("L", 40.0), ("R", 330.0))]
    left = [f"L{i}" for i in range(8)]
    right = [f"R{i}" for i in range(8)]
    for rtl, want in ((False, ["head", *left, *right]), (True, ["head", *right, *left])):
        got = layout.in_reading_order(frame(spark, rows), rtl).orderBy("seq").collect()
        assert [r.text for r in got] == want


def test_pages_in_a_stream(spark):
    """Pages of several documents, one of them larger than a batch, in the order of each page alone."""
    rng = np.random.default_rng(4)
    rows = []
    for doc in ("a", "b", None):
        for page, n in ((1, 30), (2, 1), (None, 40), (3, 7)):
            x0 = rng.choice([40.0, 330.0], n)
            y0 = rng.integers(0, 300, n).astype(float)
            rows += [(doc, page, i, "t", float(x), float(y), float(x + w), float(y + 10), 10.0, False) for i, (x, y, w) in enumerate(zip(x0, y0, rng.integers(50, 240, n), strict=True))]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
        got = {(r.doc, r.page, r.line): r.seq for r in layout.in_reading_order(lines, False).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows) and layout.in_reading_order(lines.limit(0)).count() == 0
    pages = {(r[0], r[1]) for r in rows}
    for doc, page in pages:
        own = [r for r in rows if r[:2] == (doc, page)]
        order = layout.reading_order(np.array([r[4:8] for r in own]), False)
        assert [got[doc, page, own[i][2]] for i in order] == list(range(1, len(own) + 1))


def test_gutter():
    assert layout.gutter(np.array([0.0] * 5), np.array([10.0] * 5)) is None
    x0 = np.array([0.0, 0, 0, 60, 60, 60])
    assert layout.gutter(x0, x0 + 40) == pytest.approx(50, abs=1)


def test_furniture(spark):
    rows = []
    for p in range(1, 5):
        rows += [("d", p, 0, f"Page {p}", 0.0, 2.0, 50.0, 10.0, 10.0, False), ("d", p, 1, f"body {p}", 0.0, 200.0, 50.0, 210.0, 10.0, False), ("d", p, 2, f"body {p}", 0.2, 200.3, 50.0, 210.0, 10.0, False)]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean")
    pages = spark.createDataFrame([("d", p, 400.0) for p in range(1, 5)], "doc string, page int, height double")
    found = layout.furniture(lines, pages)
    assert [r.key for r in found.collect()] == ["page #"]
    rest = layout.drop_furniture(lines, pages, found)
    assert rest.count() == 8 and layout.drop_repeated(rest).count() == 4
    assert layout.furniture(lines.where("page < 3"), pages.where("page < 3")).count() == 0


def test_paragraphs_over_pages(spark):
    line = lambda t, y, x1=500.0, size=10.0: (t, 40.0, y, x1, y + 10, size, False)
    one = frame(spark, [line("A Heading", 0.0, 200.0, 16.0), line("first line of a para-", 20.0), line("graph that ends.", 32.0, 200.0), line("second one runs over the", 44.0)])
    two = frame(spark, [line("page and ends here.", 0.0, 300.0), line("- an item", 30.0)]).withColumn("page", F.lit(2))
    parts = layout.paragraphs(layout.by_position(one.union(two)))
    got = layout.merge_pages(parts).orderBy("seq").collect()
    assert [(r.text, r.kind) for r in got] == [("A Heading", "heading"), ("first line of a paragraph that ends.", "body"), ("second one runs over the page and ends here.", "body"), ("- an item", "list")]


def test_spans_bands_titles(spark):
    spans = spark.createDataFrame(
        [("d", 1, 0, 0, 0, "Bold", 0.0, 20.0, 0.0, 9.0, 12.0, 16, "F"), ("d", 1, 0, 0, 1, "title", 25.0, 50.0, 0.0, 10.0, 20.0, 0, "X-Black"), ("d", 1, 0, 1, 0, " ", 0.0, 1.0, 0.0, 1.0, 9.0, 0, "F")],
        "doc string, page int, block int, line int, span int, text string, x0 double, x1 double, y0 double, y1 double, size double, flags int, font string",
    )
    r = layout.span_lines(spans).collect()
    assert [(x.text, x.size, x.bold, x.y1) for x in r] == [("Bold title", 20.0, True, 10.0)]
    lines = frame(spark, [("Great Title", 0.0, 0.0, 50.0, 10.0, 20.0, False), ("in", 0.0, 105.0, 50.0, 115.0, 10.0, False), ("after", 0.0, 160.0, 50.0, 170.0, 10.0, False)])
    bands = spark.createDataFrame([("d", 1, 1, 100.0, 150.0)], "doc string, page int, band int, y0 double, y1 double")
    parts = layout.split_by_bands(lines, bands)
    assert {(x.text, x.part) for x in parts.collect()} == {("Great Title", 0), ("after", 1)}
    assert [x.title for x in layout.first_page_title(lines).collect()] == ["Great Title"]
    tables = spark.createDataFrame([("d", 1, 0, ["table", "row"])], "doc string, page int, band int, lines array<string>")
    body = parts.select("doc", "page", "part", F.lit(1).alias("seq"), "text", F.lit("body").alias("kind"))
    assert [x.text for x in layout.splice_tables(body, tables).orderBy("seq").collect()] == ["Great Title", "table", "row", "after"]
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    assert [x.page for x in layout.empty_pages(pages, lines, 10).collect()] == [2]


def test_paged_documents(spark):
    from tamis.sources import paged

    rows, pages = [], []
    for doc, words in (("en", "plain words of a line that goes on and on,"), ("fa", "این یک خط از متن است و ادامه دارد،")):
        for p in range(1, 4):
            pages.append((doc, p, 400.0))
            rows.append((doc, p, 0, f"running head {p}", 40.0, 2.0, 300.0, 12.0, 10.0, False))
            rows += [(doc, p, i, f"{words} {p} {i}", 40.0, 60.0 + 12 * i, 500.0, 70.0 + 12 * i, 10.0, False) for i in range(1, 4)]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean")
    page = spark.createDataFrame(pages, "doc string, page int, height double")
    meta = spark.createDataFrame([("en", "a_b.pdf", "Untitled"), ("fa", "c.pdf", "The Title")], "doc string, name string, title string")
    bands = spark.createDataFrame([("en", 2, 0, 150.0, 160.0, [["m", "n"], [None, "1"]])], "doc string, page int, band int, y0 double, y1 double, rows array<array<string>>")
    assert {r.doc: r.rtl for r in paged.directions(lines).collect()} == {"en": False, "fa": True}
    got = {r.source_id: r for r in paged.documents(lines, page, meta, bands).collect()}
    assert got["en"].title == "a b" and got["fa"].title == "The Title" and got["en"].kind == "pdf"
    assert "running head" not in got["en"].content and "n: 1" in got["en"].content
    assert [i for i in range(1, 4) if f"{i} 3" in got["en"].content] == [1, 2, 3]
    assert got["en"].content.index("2 3") < got["en"].content.index("n: 1") < got["en"].content.index("3 1")
    assert got["en"].notes == ["tables: 1"] and got["fa"].notes == []


def test_headings(spark):
    rows = [("متن فارسی با یک حرف X", 10.0, False), ("ANNUAL REPORT", 10.0, False), ("ÄÖÜ ABC", 10.0, False), ("ABCD efgh", 10.0, False), ("Bold line", 10.0, True), ("Large line", 11.5, False), ("ends, ", 20.0, False), ("ABC 1234", 10.0, False), ("ABCD 1234", 10.0, False)]
    f = spark.createDataFrame(rows, "text string, size double, bold boolean")
    got = f.select("text", layout.is_heading(F.col("text"), F.col("size"), F.col("bold"), F.lit(10.0), F.lit(True)).alias("h")).collect()
    assert [r.text for r in got if r.h] == ["ANNUAL REPORT", "Bold line", "Large line", "ABCD 1234"]
    none = f.select("text", layout.is_heading(F.col("text"), F.lit(0.0), F.col("bold"), F.lit(0.0), F.lit(True)).alias("h")).collect()
    assert [r.text for r in none if r.h] == ["ANNUAL REPORT", "ABCD 1234"]  # without sizes bold says nothing


def test_indents_and_semicolons(spark):
    line = lambda t, y, x0=40.0, x1=540.0: (t, x0, y, x1, y + 10, 10.0, False)
    one = frame(spark, [line("first runs on", 0.0), line("indented by three percent", 12.0, 55.0), line("short end;", 24.0, 40.0, 380.0), line("next begins", 36.0), line("last one;", 48.0, 40.0, 500.0)])
    two = frame(spark, [line("lower case after a semicolon", 0.0)]).withColumn("page", F.lit(2))
    got = layout.merge_pages(layout.paragraphs(layout.by_position(one.union(two)))).orderBy("seq").collect()
    assert [r.text for r in got] == ["first runs on", "indented by three percent short end;", "next begins last one;", "lower case after a semicolon"]
