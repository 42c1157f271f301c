"""Text scalars as Column expressions: normalization, tokens, direction, line classes.

Patterns use explicit classes: Java's short classes are ASCII-only, and texts here are Persian,
Arabic and Latin mixed.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def _ranges(*codes: int | tuple[int, int]) -> str:
    """The body of a character class, in escapes that Java and RE2 both read."""
    return "".join(f"\\x{{{c:X}}}" if isinstance(c, int) else f"\\x{{{c[0]:X}}}-\\x{{{c[1]:X}}}" for c in codes)


# Horizontal white space.
HORIZONTAL = _ranges(0x09, (0x0B, 0x0D), (0x1C, 0x20), 0x85, 0xA0, 0x1680, (0x2000, 0x200A), (0x2028, 0x2029), 0x202F, 0x205F, 0x3000)
_NOT_SPACE = _ranges(0x09, (0x0B, 0x0D), (0x1C, 0x1F), 0x85, 0xA0, 0x1680, (0x2000, 0x200A), (0x2028, 0x2029), 0x202F, 0x205F, 0x3000)
#: Runs that are not a single plain space already.
SPACES = f"[{_NOT_SPACE}][{HORIZONTAL}]*| [{HORIZONTAL}]+"
EDGES = rf"^[{HORIZONTAL}\n]+|[{HORIZONTAL}\n]+$"
WORD = r"[\p{L}\p{N}_]"

# Digits and letters that are written in several ways, and what they fold to.
FOLD_FROM = "۰۱۲۳۴۵۶۷۸۹" + "٠١٢٣٤٥٦٧٨٩" + "يكةأإؤ"
FOLD_TO = "0123456789" + "0123456789" + "یکهااو"

# Function words that carry no content (Persian).
STOPWORDS = tuple(
    "و در به از که این آن را با برای تا بر هم یا اما اگر نیز پس هر چه چرا کجا کی چند است بود شد شده می های ها تر ترین"
    " یک دو خود ما شما او آنها ایشان من تو نه بی باید شاید همه هیچ دیگر باز وقتی چون زیرا بلکه ولی روی زیر بین پیش".split()
)

# Invisible marks that are deleted, besides the no-break space that becomes a space.
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), 0xFEFF)))
ZWNJ = chr(0x200C)
NO_BREAK = chr(0xA0)
HYPHENS = "-" + chr(0x2010)

# Ranges of right-to-left characters.
RTL = _ranges((0x590, 0x5FF), (0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF))

# Arabic letters, and what is set apart from them: Latin letters and digits of any script in use.
ARABIC_LETTER = _ranges((0x620, 0x64A), (0x671, 0x6D3))
LATIN_OR_DIGIT = "0-9A-Za-z" + _ranges((0x660, 0x669), (0x6F0, 0x6F9))

# Bullets, the digits of list numbers, and the letters of lettered items.
BULLETS = r"\-*•▪◦‣–—"
ITEM_DIGITS = "0-9٠-٩۰-۹"
ITEM_LETTERS = "A-Za-zا-ی"

THIN_WORDS = {"web": 120, "pdf": 40, "text": 40}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def normalize(text: Column) -> Column:
    """Fold digits and letters, collapse spaces around and between words, keep at most one blank line."""
    folded = F.translate(text, FOLD_FROM, FOLD_TO)
    spaced = F.regexp_replace(F.regexp_replace(folded, SPACES, " "), " ?\n ?", "\n")
    return strip(F.regexp_replace(spaced, "\n{3,}", "\n\n"))


def tokenize(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased words of two characters or more that are no stopwords, in order, repeats kept."""
    # Of what normalizing does only the folds can change a word.
    found = F.regexp_extract_all(F.lower(F.translate(text, FOLD_FROM, FOLD_TO)), F.lit(rf"[\p{{L}}\p{{N}}_{ZWNJ}]+"), F.lit(0))
    # A long list of literals becomes a hash set.
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords) if stopwords else F.length(w) > 1)


def _composed(value):
    """NFKC of a text, or of every text in nested lists."""
    if value is None:
        return None
    return unicodedata.normalize("NFKC", value) if isinstance(value, str) else [_composed(x) for x in value]


def nfkc(text: Column, kind: str = "string") -> Column:
    """Compatibility composition, which has no built-in: an Arrow UDF, on texts or (nested) arrays of them."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(_composed)

    return run(text)


def split_bidi(text: Column) -> Column:
    """A space where an Arabic letter touches a Latin letter or digit."""
    one = F.regexp_replace(text, f"(?<=[{ARABIC_LETTER}])(?=[{LATIN_OR_DIGIT}])", " ")
    return F.regexp_replace(one, f"(?<=[{LATIN_OR_DIGIT}])(?=[{ARABIC_LETTER}])", " ")


def _shown(text: Column) -> Column:
    return F.translate(text, NO_BREAK + INVISIBLE, " ")


def _tidy(text: Column) -> Column:
    return strip(split_bidi(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), SPACES, " ")))


def clean_visible(text: Column, compose: bool = True) -> Column:
    """Delete invisible marks, unify line ends and spaces, separate scripts.  ``compose``: NFKC as well."""
    shown = _shown(text)
    return _tidy(nfkc(shown) if compose else shown)


def clean_each(texts: Column, compose: bool = True) -> Column:
    """The same for every text of an array."""
    shown = F.transform(texts, _shown)
    return F.transform(nfkc(shown, "array<string>") if compose else shown, _tidy)


def rtl_count(text: Column) -> Column:
    """Right-to-left characters, digits and marks too."""
    return F.length(F.regexp_replace(text, f"[^{RTL}]", "")).cast("double")


def other_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"[^\p{{L}}]|[{RTL}]", "")).cast("double")


def rtl_ratio(text: Column) -> Column:
    """Right-to-left characters among these and other letters; 0 without any."""
    rtl, other = rtl_count(text), other_letters(text)
    return F.when(rtl + other > 0, rtl / (rtl + other)).otherwise(F.lit(0.0))


def is_rtl(text: Column) -> Column:
    return rtl_ratio(text) > 0.5


def furniture_key(text: Column, compose: bool = True) -> Column:
    """What repeated headers and footers have in common: page numbers are all alike."""
    return strip(F.regexp_replace(F.lower(clean_visible(text, compose)), r"\p{Nd}+", "#"))


def word_continues(text: Column) -> Column:
    """The line's last word goes on in the next line."""
    return F.regexp_replace(text, f"[{HORIZONTAL}\n]+$", "").rlike(f"[A-Za-z][{HYPHENS}]$|{ZWNJ}$")


def is_list_item(text: Column) -> Column:
    """Begins with a bullet, a short number or a single letter with its mark, and a space."""
    marks = (f"[{BULLETS}]", rf"\(?[{ITEM_DIGITS}]{{1,3}}[.)\-]", f"[{ITEM_LETTERS}][.)]")
    space = rf"[{HORIZONTAL}\n]"
    return text.rlike(f"^{space}*({'|'.join(marks)}){space}")


def join_lines(lines: Column) -> Column:
    """One text of a paragraph's lines: hyphenated Latin words and words that end in ZWNJ are glued."""

    def add(done: Column, line: Column) -> Column:
        hyphen = done.rlike(f"[A-Za-z][{HYPHENS}]$") & line.rlike("^[a-z]")
        return (
            F.when(line == "", done)
            .when(done == "", line)
            .when(hyphen, F.concat(F.regexp_replace(done, ".$", ""), line))
            .when(done.endswith(ZWNJ), F.concat(done, line))
            .otherwise(F.concat(done, F.lit(" "), line))
        )

    return F.aggregate(F.transform(lines, strip), F.lit(""), add)


def join_spans(spans: Column, rtl: Column, share: float = 0.25, compose: bool = True) -> Column:
    """Text of a line from spans struct(text, x0, x1), cleaned: a space where the gap exceeds ``share`` of a character.

    Spans without a place are left out."""
    texts = clean_each(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), compose)
    whole = F.zip_with(spans, texts, lambda s, t: F.struct(t.alias("text"), s["x0"].alias("x0"), s["x1"].alias("x1")))
    kept = F.filter(whole, lambda s: (s["text"] != "") & s["x0"].isNotNull() & s["x1"].isNotNull())
    keyed = F.array_sort(F.transform(kept, lambda s, i: F.struct(F.when(rtl, -s["x0"]).otherwise(s["x0"]).alias("k"), i.alias("i"), s.alias("s"))))

    def text(o: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.get(o, i - 1)["s"]
            now = x["s"]
            gap = F.when(rtl, before["x0"] - now["x1"]).otherwise(now["x0"] - before["x1"])
            width = (before["x1"] - before["x0"]) / F.greatest(F.lit(1), F.length(before["text"]))
            return F.when((i > 0) & (gap > share * width), F.concat(F.lit(" "), now["text"])).otherwise(now["text"])

        return strip(F.regexp_replace(F.array_join(F.transform(o, piece), ""), SPACES, " "))

    return F.get(F.transform(F.array(keyed), text), F.lit(0))


def render(paragraphs: Column) -> Column:
    return F.array_join(F.filter(paragraphs, lambda p: strip(p) != ""), "\n\n")


def render_table(rows: Column, rtl: Column, compose: bool = True) -> Column:
    """The lines of a table of nullable cells: with a full first row that header, then 'name: value' lines.

    Cells are cleaned; rows and values that are empty then are left out."""
    shown = F.transform(rows, lambda r: F.transform(r, lambda c: _shown(F.coalesce(c, F.lit("")))))
    clean = F.transform(nfkc(shown, "array<array<string>>") if compose else shown, lambda r: F.transform(r, _tidy))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    turned = F.when(rtl, F.transform(full, F.reverse)).otherwise(full)

    def lines(t: Column) -> Column:
        head = F.get(t, F.lit(0))
        headed = (F.size(t) > 1) & F.forall(head, lambda c: c != "")
        pair = lambda h, c: F.when(h.isNotNull() & (c != ""), F.concat(h, F.lit(": "), c))
        pairs = lambda r: F.array_join(F.filter(F.zip_with(head, r, pair), lambda x: x.isNotNull()), " | ")
        body = F.filter(F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), pairs), lambda x: x != "")
        plain = F.transform(t, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | "))
        return F.when(headed, F.concat(F.array(F.array_join(head, " | ")), body)).otherwise(plain)

    return F.get(F.transform(F.array(turned), lines), F.lit(0))


# Parts of titles that programs set by themselves, and customary openings that are no titles.
JUNK_TITLE = r"untitled|microsoft word|document1|\.doc|\.pdf|\.tex"
OPENINGS = "بسمه تعالی|باسمه تعالی|بسم الله|به نام خدا|بنام خدا|هو الحق|هوالحق"


def bare_title(title: Column) -> Column:
    return strip(F.regexp_replace(strip(title), "^[\"'«» ]+|[\"'«» ]+$", ""))


def is_junk_title(title: Column) -> Column:
    bare = bare_title(title)
    compact = F.regexp_replace(F.translate(bare, ZWNJ, " "), rf"[{HORIZONTAL}\n]+", " ")
    return F.lower(bare).rlike(JUNK_TITLE) | compact.rlike(f"^({OPENINGS})")


def title_of_metadata(title: Column) -> Column:
    bare = strip(title)
    return F.when((F.length(bare) >= 3) & ~is_junk_title(bare), bare)


def title_of_name(name: Column) -> Column:
    """A file's name without its suffix, its marks turned to spaces; the name itself if nothing is left."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    spaced = strip(F.regexp_replace(F.translate(stem, "_-", "  "), " +", " "))
    return F.when(spaced != "", spaced).otherwise(name)


def word_count(text: Column) -> Column:
    inner = strip(text)
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, rf"[{HORIZONTAL}\n]+"))).cast("long")


def is_thin(text: Column, kind: Column) -> Column:
    """Fewer words than a document of its kind should have."""
    return word_count(text) < F.when(kind == "web", THIN_WORDS["web"]).otherwise(THIN_WORDS["text"])


def preview(text: Column, n: int = 240) -> Column:
    one = strip(F.regexp_replace(text, rf"[{HORIZONTAL}\n]+", " "))
    return F.when(F.length(one) > n, F.concat(F.left(one, F.lit(n)), F.lit("…"))).otherwise(one)


def extraction_report(title: Column, text: Column, kind: Column, notes: Column) -> Column:
    """What was extracted, in lines: title, words, a preview, a warning where it is thin, and notes."""
    words = word_count(text)
    warning = F.when(is_thin(text, kind), F.when(kind == "web", F.lit("warning: a short page; the article may not have been found")).otherwise(F.lit("warning: a short document")))
    return F.array_join(F.array_compact(F.concat(F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("words: "), words.cast("string")), preview(text), warning), F.coalesce(notes, F.array().cast("array<string>")))), "\n")


def document_notes(pages: Column, empty_pages: Column, tables: Column) -> Column:
    """Remarks on a paged document: scanned, empty pages (at most eight are named), tables, great length."""
    empty = F.size(empty_pages)
    listed = F.array_join(F.slice(F.transform(empty_pages, lambda p: p.cast("string")), 1, 8), ", ")
    return F.array_compact(
        F.array(
            F.when((pages > 0) & (empty >= 0.5 * pages), F.lit("most pages have no text; the document may be scanned")).when(empty > 0, F.concat(F.lit("pages without text: "), listed)),
            F.when(tables > 0, F.concat(F.lit("tables: "), tables.cast("string"))),
            F.when(pages >= 200, F.concat(F.lit("a long document: "), pages.cast("string"), F.lit(" pages"))),
        )
    )
