import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import text as T


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def plain_normalize(s):
    s = s.translate(str.maketrans(T.FOLD_FROM, T.FOLD_TO))
    s = re.sub(r"[^\S\n]+", " ", s)
    s = re.sub(r" ?\n ?", "\n", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def test_normalize_matches_plain_python(spark):
    alphabet = "aB é\t\n\r\x0b\x1c" + chr(0xA0) + chr(0x2003) + chr(0x3000) + "يكةأإؤئ" + "۰۹٠٩" + T.ZWNJ + "."
    texts = []

    @settings(max_examples=150, derandomize=True, database=None)
    @given(st.text(alphabet=alphabet, max_size=30))
    def collect(t):
        texts.append(t)

    collect()
    got = apply(spark, T.normalize, *texts)
    assert got == [plain_normalize(t) for t in texts]
    assert apply(spark, T.normalize, *got) == got


def test_tokenize(spark):
    got = apply(spark, T.tokenize, "The كتاب و the a ۱۲ می" + T.ZWNJ + "روم!", "", None)
    assert got == [["the", "کتاب", "the", "12", "می" + T.ZWNJ + "روم"], [], None]


def test_clean_visible(spark):
    t = " " + chr(0xA0) + "ﬁ" + chr(0x200E) + "x" + chr(0xAD) + "y" + T.ZWNJ + "z\r\nمتن12\r"
    assert apply(spark, T.clean_visible, t) == [unicodedata.normalize("NFKC", "ﬁ") + "xy" + T.ZWNJ + "z\nمتن 12"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("سال۱۴۰۱بود", "سال ۱۴۰۱ بود"), ("متن٣متن", "متن ٣ متن"), ("abcمتن9", "abc متن 9"), ("ٱ1", "ٱ 1"), ("ؠa", "ؠ a"), ("۱۲٪a", "۱۲٪a"), ("1،2", "1،2"), ("۱۲", "۱۲"), ("س1س", "س 1 س")],
)
def test_split_bidi(spark, text, want):
    assert apply(spark, T.split_bidi, text) == [want]
    assert apply(spark, T.clean_visible, text) == [want]


@pytest.mark.parametrize(("text", "want"), [("سلام", True), ("hello", False), ("", False), ("سلام abcd", False), ("سلامت abcd", True), ("123", False)])
def test_direction(spark, text, want):
    assert apply(spark, T.is_rtl, text) == [want]


@pytest.mark.parametrize(
    ("text", "want"), [("- a", True), ("• a", True), ("12) a", True), ("(3) a", True), ("1234) a", False), ("a. b", True), ("ب) x", True), ("ab. c", False), ("-a", False), ("۱۲. x", True)]
)
def test_list_items(spark, text, want):
    assert apply(spark, T.is_list_item, text) == [want]


@pytest.mark.parametrize(("text", "want"), [("exam-", True), ("exam- ", True), ("1401-", False), ("exam", False), ("می" + chr(0x200C), True), ("exam" + chr(0x2010), True)])
def test_word_continues(spark, text, want):
    assert apply(spark, T.word_continues, text) == [want]


def test_join_lines(spark):
    rows = spark.createDataFrame([(["exam-", "ple two", "", " three", "Pre-", "Fix", "می" + T.ZWNJ, "روم"],), ([],)], "l array<string>")
    assert [r[0] for r in rows.select(T.join_lines(F.col("l"))).collect()] == ["example two three Pre- Fix می" + T.ZWNJ + "روم", ""]


def test_join_spans(spark):
    s = spark.createDataFrame([([("b", 20.0, 30.0), ("a", 0.0, 10.0), ("c", 30.5, 40.0), (" ", 50.0, 60.0)],)], "s array<struct<text:string,x0:double,x1:double>>")
    assert s.select(T.join_spans(F.col("s"), F.lit(False))).first()[0] == "a bc"
    assert s.select(T.join_spans(F.col("s"), F.lit(True))).first()[0] == "cb a"
    s = spark.createDataFrame([([("a" + chr(0xAD) + "ﬁ", 0.0, 10.0), (chr(0x200E), 11.0, 12.0), ("سال۱۴", 30.0, 40.0), ("lost", None, None)],)], "s array<struct<text:string,x0:double,x1:double>>")
    assert s.select(T.join_spans(F.col("s"), F.lit(False))).first()[0] == "afi سال ۱۴"


def test_render(spark):
    rows = spark.createDataFrame([(["a", " ", "b"],)], "p array<string>")
    assert rows.select(T.render(F.col("p"))).first()[0] == "a\n\nb"
    tables = [[["n", "v"], ["x", None], [None, ""], ["y", " 2 "]], [["n", None], ["x", "1"]], [["only", "row"]], [["ﬁ", "سال۱۴"], ["a" + chr(0xAD) + "b", chr(0x200E)], ["c", "d", "more"]], [[None, " "]], []]
    rows = spark.createDataFrame([(t,) for t in tables], "t array<array<string>>")
    got = [r[0] for r in rows.select(T.render_table(F.col("t"), F.lit(False))).collect()]
    assert got == [["n | v", "n: x", "n: y | v: 2"], ["n", "x | 1"], ["only | row"], ["fi | سال ۱۴", "fi: ab", "fi: c | سال ۱۴: d"], [], []]
    assert rows.select(T.render_table(F.col("t"), F.lit(True))).first()[0] == ["v | n", "n: x", "v: 2 | n: y"]


def test_titles(spark):
    assert apply(spark, T.title_of_name, "my_report-2.final.pdf", "a.txt", "__.md", "plain") == ["my report 2.final", "a", "__.md", "plain"]
    assert apply(spark, T.is_junk_title, "Untitled 1", "Microsoft Word - x", "«بسمه تعالی»", "A real title") == [True, True, True, False]
    assert apply(spark, T.title_of_metadata, "ab", "Good title", "untitled") == [None, "Good title", None]


def test_counts_and_reports(spark):
    assert apply(spark, T.word_count, "", " a  b\nc ", "x") == [0, 3, 1]
    report = apply(spark, lambda x: T.extraction_report(F.lit("t"), x, F.lit("web"), F.array(F.lit("note"))), "word " * 100)[0]
    assert "words: 100" in report and "…" in report and "warning" in report and report.endswith("note")
    one = spark.range(1)
    notes = lambda p, e, t: one.select(T.document_notes(F.lit(p), F.array(*map(F.lit, e)).cast("array<int>"), F.lit(t))).first()[0]
    assert notes(4, [1, 2], 0) == ["most pages have no text; the document may be scanned"]
    assert notes(250, [3], 2) == ["pages without text: 3", "tables: 2", "a long document: 250 pages"]
    assert notes(5, [], 0) == []
