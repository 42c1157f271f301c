"""Registered queries of the document engine, each over its whole tables, and the SQL of each.

The tables hold no Persian text and no page geometry, so some queries build both from columns, the
same way on either side; whatever is built is derived from the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import dialog
from tamis.functions import text as T
from tamis.operators import chunking, dense, embed, evaluate, fusion, layout, lexical, policy
from tamis.sources import files, store, web
from tamis.tables import read as read_table
from tamis.tables import scratch, spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = read_table(spark, sf_dir, name)
    return spread(table) if name in ("documents", "pages") else table


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL of the text functions ----

# What the SQL says is written out here once more, and not taken from the functions it checks.
H = r"\x{9}\x{B}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGITS = "۰۱۲۳۴۵۶۷۸۹"
FOLDS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩يكةأإؤ", "01234567890123456789یکهااو")
ARABIC = r"\x{620}-\x{64A}\x{671}-\x{6D3}"
LEFT_TO_RIGHT = r"0-9A-Za-z\x{660}-\x{669}\x{6F0}-\x{6F9}"
RIGHT_TO_LEFT = r"\x{590}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
GONE = "".join(map(chr, (0xA0, 0xAD, 0x200B, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0xFEFF)))
CONTINUES = r"[A-Za-z][-\x{2010}]$|\x{200C}$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


def s_strip(x: str) -> str:
    return sub(x, rf"^[{H}\n]+|[{H}\n]+$")


def s_normalize(x: str) -> str:
    x = f"translate({x}, {q(FOLDS[0])}, {q(FOLDS[1])})"
    x = sub(sub(x, f"[{H}]+", "' '"), r" ?\n ?", "chr(10)")
    return s_strip(sub(x, r"\n{3,}", "chr(10) || chr(10)"))


def s_tokens(x: str) -> str:
    found = f"regexp_extract_all(lower({s_normalize(x)}), {q(r'[\p{L}\p{N}_\x{200C}]+')})"
    stop = "[" + ", ".join(q(w) for w in T.STOPWORDS) + "]"
    return f"list_filter({found}, lambda w: length(w) > 1 AND NOT list_contains({stop}, w))"


def s_bidi(x: str) -> str:
    one = sub(x, f"([{ARABIC}])([{LEFT_TO_RIGHT}])", r"'\1 \2'")
    return sub(one, f"([{LEFT_TO_RIGHT}])([{ARABIC}])", r"'\1 \2'")


def s_clean(x: str) -> str:
    x = f"translate({x}, {q(GONE)}, ' ')"
    return s_strip(s_bidi(sub(sub(x, r"\r\n?", "chr(10)"), f"[{H}]+", "' '")))


def s_words(x: str) -> str:
    return f"CAST(CASE WHEN {s_strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({s_strip(x)}, {q(rf'[{H}\n]+')})) END AS BIGINT)"


# ---- text ----

_PERSIAN = f"translate(CAST(doc_id AS VARCHAR), '0123456789', {q(DIGITS)}) || chr(9) || 'كتاب يك ة' || chr(10) || ' ' || text || chr(10) || chr(10) || chr(10) || ' ' || lang"


def _persian(docs: DataFrame) -> DataFrame:
    mixed = F.concat(F.translate(F.col("doc_id").cast("string"), "0123456789", DIGITS), F.lit("\tكتاب يك ة\n "), F.col("text"), F.lit("\n\n\n "), F.col("lang"))
    return docs.withColumn("mixed", mixed)


@query(f"SELECT doc_id, sha256({s_normalize(_PERSIAN)}) AS normalized, CAST(length({s_normalize(_PERSIAN)}) AS BIGINT) AS n FROM documents")
def normalize_text(spark, sf_dir):
    n = T.normalize(F.col("mixed"))
    return _persian(read(spark, sf_dir, "documents")).select("doc_id", F.sha2(n, 256).alias("normalized"), F.length(n).cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {s_tokens(_PERSIAN)} AS t FROM documents)")
def tokenize_counts(spark, sf_dir):
    t = _persian(read(spark, sf_dir, "documents")).select("doc_id", T.tokenize(F.col("mixed")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


# Letters touch digits of three scripts, Latin letters, and marks that separate nothing.
_MIXED = f"'سلام' || CAST(doc_id AS VARCHAR) || 'کتاب' || translate(CAST(doc_id AS VARCHAR), '0123456789', {q(DIGITS)}) || 'ٱۓ٤ؠ٪،' || lang || 'متن' || text"


def _script(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mixed", F.concat(F.lit("سلام"), F.col("doc_id").cast("string"), F.lit("کتاب"), F.translate(F.col("doc_id").cast("string"), "0123456789", DIGITS), F.lit("ٱۓ٤ؠ٪،"), F.col("lang"), F.lit("متن"), F.col("text")))


@query(f"SELECT doc_id, sha256({s_bidi(_MIXED)}) AS split FROM documents")
def bidi_split(spark, sf_dir):
    return _script(read(spark, sf_dir, "documents")).select("doc_id", F.sha2(T.split_bidi(F.col("mixed")), 256).alias("split"))


_RATIO = f"""SELECT doc_id, CASE WHEN r + o > 0 THEN round(r / (r + o), 6) ELSE 0 END AS ratio, CASE WHEN r + o > 0 THEN r / (r + o) > 0.5 ELSE false END AS is_rtl FROM (
SELECT doc_id, CAST(length({sub("m", f"[^{RIGHT_TO_LEFT}]")}) AS DOUBLE) AS r, CAST(length({sub("m", rf"[^\p{{L}}]|[{RIGHT_TO_LEFT}]")}) AS DOUBLE) AS o FROM (SELECT doc_id, {_MIXED} || repeat('سلام ', doc_id % 50) AS m FROM documents))"""


@query(_RATIO)
def rtl_ratio(spark, sf_dir):
    m = _script(read(spark, sf_dir, "documents")).withColumn("m", F.concat("mixed", F.repeat(F.lit("سلام "), (F.col("doc_id") % 50).cast("int"))))
    return m.select("doc_id", F.round(T.rtl_ratio(F.col("m")), 6).alias("ratio"), T.is_rtl(F.col("m")).alias("is_rtl"))


_MARKED = "'  ' || chr(160) || chr(8206) || 'ab' || chr(173) || 'c' || chr(8204) || chr(13) || chr(10) || text || chr(8203) || 'متنx۱۲متن' || chr(13)"


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("m", F.concat(F.lit("  " + chr(160) + chr(8206) + "ab" + chr(173) + "c" + chr(8204) + "\r\n"), F.col("text"), F.lit(chr(8203) + "متنx۱۲متن\r")))


@query(f"SELECT doc_id, sha256({s_clean(_MARKED)}) AS cleaned FROM documents")
def clean_unicode(spark, sf_dir):
    return _marked(read(spark, sf_dir, "documents")).select("doc_id", F.sha2(T.clean_visible(F.col("m"), compose=False), 256).alias("cleaned"))


@query()
def clean_unicode_nfkc(spark, sf_dir):
    return _marked(read(spark, sf_dir, "documents")).select("doc_id", F.sha2(T.clean_visible(F.col("m")), 256).alias("cleaned"))


_LINES = "SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(generate_series(1, len(ls))) AS s(i)"


def _doc_lines(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


_CLASS_TEXT = "CASE line % 5 WHEN 0 THEN '- ' || text WHEN 1 THEN CAST(line AS VARCHAR) || ') ' || text WHEN 2 THEN text || 'a-' WHEN 3 THEN 'a. ' || text ELSE text END"


@query(f"""SELECT doc_id, line, regexp_matches(t, {q(rf'^[{H}\n]*([-*•▪◦‣–—][{H}\n]|\(?[0-9٠-٩۰-۹]{{1,3}}[.)\-][{H}\n]|[A-Za-zا-ی][.)][{H}\n])')}) AS is_list,
regexp_matches({sub("t", rf'[{H}\n]+$')}, {q(CONTINUES)}) AS continues, {s_strip(sub("lower(" + s_clean("t") + ")", r"\p{Nd}+", "'#'"))} AS key FROM (SELECT doc_id, line, {_CLASS_TEXT} AS t FROM ({_LINES}))""")
def line_classes(spark, sf_dir):
    t = F.expr("CASE line % 5 WHEN 0 THEN concat('- ', text) WHEN 1 THEN concat(CAST(line AS STRING), ') ', text) WHEN 2 THEN concat(text, 'a-') WHEN 3 THEN concat('a. ', text) ELSE text END")
    own = _doc_lines(spark, sf_dir).withColumn("t", t)
    return own.select("doc_id", "line", T.is_list_item(F.col("t")).alias("is_list"), T.word_continues(F.col("t")).alias("continues"), T.furniture_key(F.col("t"), compose=False).alias("key"))


_FOLD = rf"""list_reduce(list_transform(ls, lambda l: {s_strip("l")}), lambda d, l: CASE WHEN l = '' THEN d WHEN d = '' THEN l
WHEN regexp_matches(d, {q(r"[A-Za-z][-\x{2010}]$")}) AND regexp_matches(l, '^[a-z]') THEN d[:length(d) - 1] || l ELSE d || ' ' || l END)"""


@query(f"SELECT doc_id, sha256({_FOLD}) AS joined FROM (SELECT doc_id, list_prepend('', list_concat(string_split(text, chr(10)), ['half-', 'word and', 'Pre-', 'Fix', ' '])) AS ls FROM documents)")
def join_lines(spark, sf_dir):
    lines = F.concat(F.split("text", "\n"), F.array(*[F.lit(x) for x in ("half-", "word and", "Pre-", "Fix", " ")]))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.join_lines(lines), 256).alias("joined"))


@query("""SELECT r_regionkey, 'nation | key' || chr(10) || string_agg('nation: ' || n_name || ' متن' || CASE WHEN n_nationkey % 2 = 0 THEN ' | key: ' || CAST(n_nationkey AS VARCHAR) ELSE '' END, chr(10) ORDER BY n_nationkey) AS rendered
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def table_render(spark, sf_dir):
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # Cells that need cleaning: a no-break space around, a soft hyphen inside, letters of two scripts.
    name = F.concat(F.lit(chr(0xA0)), F.col("n_name"), F.lit(chr(0xAD) + "متن"))
    cells = F.array(name, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")))
    rows = joined.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))).alias("l"))
    table = F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), F.transform("l", lambda x: x["c"]))
    return rows.select("r_regionkey", F.array_join(T.render_table(table, F.lit(False)), "\n").alias("rendered"))


@query(f"""SELECT doc_id, 'my report ' || source || ' ' || CAST(doc_id AS VARCHAR) AS title, lower(w) LIKE '%untitled%' AS junk
FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'Untitled ' ELSE '' END || text AS w FROM documents)""")
def titles(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("my_report--"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    return d.select("doc_id", T.title_of_name(name).alias("title"), T.is_junk_title(F.concat(F.when(F.col("doc_id") % 3 == 0, "Untitled ").otherwise(""), F.col("text"))).alias("junk"))


@query(f"""SELECT source, count(*) AS documents, CAST(sum(w) AS BIGINT) AS words, count(*) FILTER (w < CASE WHEN k = 'web' THEN 120 ELSE 40 END) AS thin
FROM (SELECT source, {s_words("text")} AS w, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE 'text' END AS k FROM documents) GROUP BY source""")
def thin_by_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("k", F.when(F.col("doc_id") % 2 == 0, "web").otherwise("text"))
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum(T.word_count(F.col("text"))).alias("words"), F.count_if(T.is_thin(F.col("text"), F.col("k"))).alias("thin"))


_FLAT = s_strip(sub("text", rf"[{H}\n]+", "' '"))


@query(f"SELECT doc_id, 'title: ' || source || chr(10) || 'words: ' || CAST({s_words('text')} AS VARCHAR) || chr(10) || CASE WHEN length({_FLAT}) > 240 THEN left({_FLAT}, 240) || '…' ELSE {_FLAT} END || CASE WHEN {s_words('text')} < 40 THEN chr(10) || 'warning: a short document' ELSE '' END AS report FROM documents")
def extraction_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.extraction_report(F.col("source"), F.col("text"), F.lit("text"), F.lit(None).cast("array<string>")).alias("report"))


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS content_chars, """ + s_words("text") + """ AS content_words, sha256(text) AS content_sha256, left(text, 160) AS content_head, right(text, 120) AS content_tail FROM documents""")
def file_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id"), F.lit("t").alias("title"), F.col("text").alias("content"))
    return files.baseline(d, "doc_id").select(F.col("name").alias("doc_id"), "content_chars", "content_words", "content_sha256", "content_head", "content_tail")


@query("SELECT doc_id FROM documents WHERE source = 'src3' OR lang = 'fr'")
def baseline_diff(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit("t").alias("title"), F.col("text").alias("content"))
    changed = d.where("source <> 'src3'").withColumn("content", F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return files.baseline_diff(files.baseline(d, "doc_id"), files.baseline(changed, "doc_id")).select(F.col("name").alias("doc_id"))


# ---- web ----

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_DECODED = f"replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


@query(f"SELECT page_id, {s_normalize(_DECODED)} AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.normalize(web.parse(F.col("html"))["title"]).alias("title"))


# A paragraph's text nodes, stripped and joined; it ends where it is closed or where the next one begins.
_PARAGRAPH = "array_to_string(list_filter(list_transform(string_split({}, chr(1)), lambda y: {}), lambda y: y <> ''), ' ')".format(
    "replace(replace(replace(replace(regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')", s_strip("y")
)


@query(f"""WITH a AS (SELECT url, {s_normalize(_DECODED)} AS title, list_filter(list_transform(string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:], lambda x: {_PARAGRAPH}), lambda x: length(x) > 20) AS ps FROM pages),
n AS (SELECT url, title, {s_normalize("array_to_string(ps, chr(10) || chr(10))")} AS content FROM a)
SELECT url AS source_id, title, {s_words("content")} AS words, sha256(content) AS content_sha256 FROM n""")
def html_article(spark, sf_dir):
    a = web.articles(read(spark, sf_dir, "pages"))
    return a.select("source_id", "title", T.word_count(F.col("content")).alias("words"), F.sha2("content", 256).alias("content_sha256"))


# ---- files, stores and words of a dialog ----

_SUFFIX = "['.TXT', '.md', '.markdown', '.pdf', '.exe'][doc_id % 5 + 1]"


@query(f"""WITH f AS (SELECT doc_id, 'file:///d/my__file-' || CAST(doc_id AS VARCHAR) || {_SUFFIX} AS path, doc_id % 5 AS kind, doc_id % 7 = 0 AS broken, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS t FROM documents),
r AS (SELECT *, CASE kind WHEN 4 THEN 'unknown suffix; known: .markdown, .md, .pdf, .txt' WHEN 3 THEN 'no reader of paged files is given' ELSE CASE WHEN broken THEN 'not UTF-8' END END AS reason FROM f)
SELECT path, reason, CASE WHEN reason IS NULL THEN 'my file ' || CAST(doc_id AS VARCHAR) END AS title,
CASE WHEN reason IS NULL THEN sha256(array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: {s_normalize("p")}), lambda p: p <> ''), chr(10) || chr(10))) END AS content FROM r""")
def read_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".TXT", ".md", ".markdown", ".pdf", ".exe")]), (F.col("doc_id") % 5 + 1).cast("int"))
    raw = F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n \r")), "UTF-8")
    made = d.select(F.concat(F.lit("file:///d/my__file-"), F.col("doc_id").cast("string"), suffix).alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat(raw, F.lit(b"\xff"))).otherwise(raw).alias("content"))
    docs, refused = files.dispatch(made.withColumn("length", F.length("content").cast("long")))
    good = docs.select(F.col("source_id").alias("path"), F.lit(None).cast("string").alias("reason"), "title", F.sha2("content", 256).alias("content"))
    return good.unionByName(refused.select("path", "reason", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content")))


@query("""WITH s AS (SELECT doc_id, source AS scope, 'old' AS version FROM documents WHERE lang <> 'en' AND source NOT IN (SELECT source FROM documents WHERE lang = 'es')
UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE lang = 'es')
SELECT *, 'all' AS asked FROM s UNION ALL SELECT *, 'src3' FROM s WHERE scope = 'src3'""")
def store_roundtrip(spark, sf_dir):
    """Two upserts into a store of files, the second into scopes of the first, and both ways of reading it."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope"), "lang")
    path = scratch(spark, "store")
    store.upsert(spark, path, d.where("lang <> 'en'").select("doc_id", "scope", F.lit("old").alias("version")))
    store.upsert(spark, path, d.where("lang = 'es'").select("doc_id", "scope", F.lit("new").alias("version")))
    every, one = store.read_scope(spark, path), store.read_scope(spark, path, "src3")
    return every.withColumn("asked", F.lit("all")).unionByName(one.withColumn("asked", F.lit("src3")))


_ANSWERED = [
    ("Yes", True, None, None), (" بله ", True, None, None), ("آري", True, None, None), ("n", False, None, None), ("۱", None, "strict", "file"), ("2", None, "open", "url"),
    ("سخت‌گیرانه", None, "strict", None), ("سختگیرانه", None, "strict", None), ("آزاد", None, "open", None), ("باز", None, "open", None), ("OPEN", None, "open", None), ("", None, "open", None),
    ("فایل محلي", None, None, "file"), ("لینک", None, None, "url"), ("سايت", None, None, "url"), ("what", None, None, None),
]


def _sql_value(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else q(x)


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _ANSWERED) + ") AS t(answer, agreed, policy, source)")
def dialog_answers(spark, sf_dir):
    rows = [(a, dialog.yes_or_no(a), dialog.choose_policy(a, "open"), dialog.choose_source(a)) for a, *_ in _ANSWERED]
    return spark.createDataFrame(rows, "answer string, agreed boolean, policy string, source string")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN p > 0 AND e >= 0.5 * p THEN 'most pages have no text; the document may be scanned' WHEN e > 0 THEN 'pages without text: ' || array_to_string(list_transform(range(1, least(e, 8) + 1), lambda x: CAST(x AS VARCHAR)), ', ') END,
CASE WHEN t > 0 THEN 'tables: ' || CAST(t AS VARCHAR) END, CASE WHEN p >= 200 THEN 'a long document: ' || CAST(p AS VARCHAR) || ' pages' END], lambda x: x IS NOT NULL), ' / ') AS notes
FROM (SELECT doc_id, doc_id % 300 AS p, doc_id % 12 AS e, doc_id % 3 AS t FROM documents)""")
def notes(spark, sf_dir):
    empty = F.when(F.col("doc_id") % 12 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 12).cast("int"))).otherwise(F.array().cast("array<int>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.document_notes(F.col("doc_id") % 300, empty, F.col("doc_id") % 3), " / ").alias("notes"))


@query(f"SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda l: {s_strip('l')} <> ''), chr(10) || chr(10))) AS rendered FROM documents")
def render_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.render(F.split("text", "\n")), 256).alias("rendered"))


# ---- chunks ----


@query()
def chunk_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    return chunking.chunk(d)


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex({s_normalize("text")}, '[ \\n]+')) AS w FROM documents)
SELECT doc_id, 'title ' || CAST(doc_id AS VARCHAR) AS first_chunk, true AS small, true AS verbatim, count(*) AS words FROM w WHERE w <> '' GROUP BY doc_id""")
def chunk_cover(spark, sf_dir):
    """What chunks promise, document by document: the title comes first, none is too long, each is a stretch of the text, every word is in one."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("content"))
    own = d.select(F.col("doc_id").cast("string").alias("url"), F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"), "content")
    found = chunking.chunk(own).join(d.withColumnRenamed("content", "whole"), F.col("scope") == F.col("doc_id").cast("string"))
    body = F.when(F.col("ord") > 0, F.split("text", r"[ \n]+"))
    per = found.groupBy("doc_id").agg(
        F.min_by("text", "ord").alias("first_chunk"), F.max(F.size(body)).alias("most"), F.bool_and((F.col("ord") == 0) | F.contains("whole", "text")).alias("verbatim"),
        F.size(F.array_distinct(F.flatten(F.collect_list(body)))).cast("long").alias("words"),
    )
    return per.where("most is not null").select("doc_id", "first_chunk", (F.col("most") <= chunking.SIZE).alias("small"), "verbatim", "words")


@query(f"SELECT doc_id, line, sha256(coalesce(CASE WHEN doc_id % 2 = 0 THEN 'u' || CAST(doc_id AS VARCHAR) END, 'None') || '|' || CAST(line AS VARCHAR) || '|' || text) AS chunk_id FROM ({_LINES})")
def chunk_ids(spark, sf_dir):
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    return _doc_lines(spark, sf_dir).select("doc_id", "line", chunking.chunk_id(url, F.col("line"), F.col("text")).alias("chunk_id"))


@query("""SELECT doc_id, source AS scope, 'old' AS version FROM documents WHERE lang <> 'en' AND source NOT IN (SELECT source FROM documents WHERE lang = 'es')
UNION ALL SELECT doc_id, source AS scope, 'new' AS version FROM documents WHERE lang = 'es'""")
def upsert_scope(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    old = d.where("lang <> 'en'").select("doc_id", F.col("source").alias("scope"), F.lit("old").alias("version"))
    return chunking.replace_scopes(old, d.where("lang = 'es'").select("doc_id", F.col("source").alias("scope"), F.lit("new").alias("version")))


# ---- lexical ----

_BM = f"""chunks AS (SELECT source AS scope, doc_id AS ord, text, {s_tokens("text")} AS t FROM documents),
questions AS (SELECT item_id AS question_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS scope, text AS question, {s_tokens("text")} AS t FROM benchmark),
scopes AS (SELECT scope, count(*) AS n, avg(len(t)) AS average, ln(1 + (count(*) + 0.5) / 0.5) AS max_idf FROM chunks GROUP BY scope),
postings AS (SELECT scope, ord, token, count(*) AS tf FROM (SELECT scope, ord, unnest(t) AS token FROM chunks) GROUP BY ALL),
tokens AS (SELECT scope, token, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings JOIN scopes USING (scope) GROUP BY scope, token),
asked AS (SELECT question_id, scope, token, count(*) AS times FROM (SELECT question_id, scope, unnest(t) AS token FROM questions) GROUP BY ALL),
scores AS (SELECT question_id, scope, ord, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c.t) / average))) AS score
  FROM asked JOIN tokens USING (scope, token) JOIN postings USING (scope, token) JOIN chunks c USING (scope, ord) JOIN scopes USING (scope) GROUP BY ALL),
weights AS (SELECT question_id, scope, token, coalesce(idf, max_idf) AS weight FROM asked LEFT JOIN tokens USING (scope, token) JOIN scopes USING (scope)),
coverage AS (SELECT question_id, scope, ord, sum(weight) / any_value(total) AS coverage FROM weights JOIN (SELECT question_id, scope, sum(weight) AS total FROM weights GROUP BY ALL) USING (question_id, scope)
  JOIN postings USING (scope, token) GROUP BY question_id, scope, ord),
strong AS (SELECT question_id, scope, ord, text, score, row_number() OVER (PARTITION BY question_id, text ORDER BY score DESC, ord) AS same
  FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS best FROM scores) JOIN coverage USING (question_id, scope, ord) JOIN chunks USING (scope, ord) WHERE score >= 0.35 * best AND coverage >= 0.35),
endorsed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS r FROM strong WHERE same = 1) WHERE r <= 3)"""


def _chunks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("ord"), "text")


def _questions(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"), F.col("text").alias("question"))


@query(f"WITH {_BM} SELECT scope, token, df, round(idf, 6) AS idf FROM tokens")
def bm25_idf(spark, sf_dir):
    return lexical.index(_chunks(spark, sf_dir), most_chunks=None).tokens.select("scope", "token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM} SELECT question_id, ord, round(score, 6) AS score FROM scores")
def bm25_scores(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    return lexical.scores(lexical.index(_chunks(spark, sf_dir), most_chunks=None, asked=lexical.question_tokens(asked)), asked).select("question_id", "ord", F.round("score", 6).alias("score"))


@query(f"WITH {_BM} SELECT question_id, ord, round(coverage, 6) AS coverage FROM coverage")
def bm25_coverage(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    return lexical.coverage(lexical.index(_chunks(spark, sf_dir), most_chunks=None, asked=lexical.question_tokens(asked)), asked).select("question_id", "ord", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_BM} SELECT question_id, ord, round(score, 6) AS score FROM endorsed")
def lexical_endorsements(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    e = lexical.endorsements(lexical.index(_chunks(spark, sf_dir), most_chunks=None, asked=lexical.question_tokens(asked)), asked)
    return e.select("question_id", "ord", F.round("score", 6).alias("score"))


# ---- dense ----

_DIST = "CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 1 ELSE 1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"
_NEAR = f"""v AS (SELECT vec_id, CAST(label AS VARCHAR) AS scope, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT * FROM (SELECT q.vec_id AS question_id, q.scope, c.vec_id AS ord, {_DIST.format(a="q.e", b="c.e")} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST.format(a="q.e", b="c.e")}, c.vec_id) AS r
  FROM v q JOIN v c ON q.scope = c.scope WHERE q.vec_id % 20 = 0) WHERE r <= 5)"""


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("scope"), F.lit("").alias("text"), F.col("embedding").cast("array<double>").alias("vector"))
    return v.where("ord % 20 = 0").select(F.col("ord").alias("question_id"), "scope", "vector"), v


@query(f"WITH {_NEAR} SELECT question_id, ord, abs(round(distance, 6)) AS distance FROM near")
def dense_topk(spark, sf_dir):
    asked, v = _vectors(spark, sf_dir)
    return dense.topk(spark, asked, v, 5).select("question_id", "ord", F.abs(F.round("distance", 6)).alias("distance"))


@query(f"WITH {_NEAR} SELECT question_id, ord, abs(round(distance, 6)) AS distance FROM near")
def dense_topk_by_join(spark, sf_dir):
    asked, v = _vectors(spark, sf_dir)
    return dense.topk_by_join(asked, v, 5).select("question_id", "ord", F.abs(F.round("distance", 6)).alias("distance"))


@query(f"WITH {_NEAR} SELECT question_id, count(*) AS candidates, count(*) FILTER (distance <= 0.63) AS kept FROM near GROUP BY question_id")
def dense_gate(spark, sf_dir):
    asked, v = _vectors(spark, sf_dir)
    return dense.gate(dense.topk(spark, asked, v, 5)).groupBy("question_id").agg(F.count("*").alias("candidates"), F.count_if("kept").alias("kept"))


# ---- hybrid: the built-in embedder on whole documents and all questions ----


def _s_vectors(table: str, keys: str, text: str) -> str:
    """(keys, dim, v): signed counts of words by the first hex digits of their digest."""
    words = f"SELECT {keys}, sha256(unnest(list_filter(string_split_regex(lower({s_normalize(text)}), '[ \\n]+'), lambda w: w <> ''))) AS h FROM {table}"
    return f"SELECT {keys}, substr(h, 1, 2) AS dim, CAST(sum(CASE WHEN substr(h, 3, 1) >= '8' THEN -1 ELSE 1 END) AS DOUBLE) AS v FROM ({words}) GROUP BY ALL HAVING v <> 0"


@query(f"""WITH chunks AS (SELECT doc_id AS ord, source AS scope, text FROM documents), cv AS ({_s_vectors("chunks", "scope, ord", "text")}),
cn AS (SELECT ord, sqrt(sum(v * v)) AS n FROM cv GROUP BY ord) SELECT ord AS doc_id, count(*) AS places, round(sum(v / n), 6) + 0 AS total, round(max(v / n), 6) + 0 AS most FROM cv JOIN cn USING (ord) GROUP BY ord""")
def embed_documents(spark, sf_dir):
    e = embed.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    per = e.select("doc_id", F.filter("vector", lambda v: v != 0).alias("v")).where(F.size("v") > 0)
    return per.select("doc_id", F.size("v").cast("long").alias("places"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6) + 0.0).alias("total"), (F.round(F.array_max("v"), 6) + 0.0).alias("most"))


_HY = f"""{_BM}, cv AS ({_s_vectors("chunks", "scope, ord", "text")}), qv AS ({_s_vectors("questions", "question_id, scope", "question")}),
cn AS (SELECT scope, ord, sqrt(sum(v * v)) AS n FROM cv GROUP BY ALL), qn AS (SELECT question_id, scope, sqrt(sum(v * v)) AS n FROM qv GROUP BY ALL),
dots AS (SELECT question_id, scope, ord, sum(qv.v * cv.v) AS dot FROM qv JOIN cv USING (scope, dim) GROUP BY ALL),
far AS (SELECT question_id, scope, ord, c.text, CASE WHEN qn.n IS NULL OR cn.n IS NULL THEN 1 ELSE round(1 - coalesce(dot, 0) / (qn.n * cn.n), 12) END AS distance
  FROM questions q JOIN chunks c USING (scope) LEFT JOIN qn USING (question_id, scope) LEFT JOIN cn USING (scope, ord) LEFT JOIN dots USING (question_id, scope, ord)),
hnear AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, ord) AS r FROM far) WHERE r <= 3),
guarded AS (SELECT n.question_id, n.scope, n.ord, n.text, distance, distance <= 0.63 AND NOT (s.scope IS NOT NULL AND a.question_id IS NOT NULL AND coalesce(coverage, 0) <= 0) AS kept
  FROM hnear n LEFT JOIN coverage c ON c.question_id = n.question_id AND c.ord = n.ord LEFT JOIN scopes s ON s.scope = n.scope LEFT JOIN (SELECT DISTINCT question_id FROM asked) a ON a.question_id = n.question_id),
merged AS (SELECT g.question_id, g.scope, g.ord, g.text, distance, kept OR e.score IS NOT NULL AS kept, CASE WHEN e.score IS NOT NULL THEN 'both' ELSE 'dense' END AS source, coalesce(e.score, 0) AS lexical_score FROM guarded g LEFT JOIN endorsed e ON e.question_id = g.question_id AND e.text = g.text),
every AS (SELECT * FROM merged UNION ALL SELECT e.question_id, e.scope, e.ord, e.text, distance, true, 'lexical', e.score FROM endorsed e JOIN far f ON f.question_id = e.question_id AND f.scope = e.scope AND f.ord = e.ord
  WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.question_id = e.question_id AND m.text = e.text)),
turns AS (SELECT *, 2 * row_number() OVER (PARTITION BY question_id, kept, source = 'lexical' ORDER BY CASE WHEN source = 'lexical' THEN -lexical_score ELSE distance END, scope, ord) - CASE WHEN source = 'lexical' THEN 0 ELSE 1 END AS turn FROM every),
cand AS (SELECT question_id, scope, ord, text, distance, kept, source, lexical_score, kept AND row_number() OVER (PARTITION BY question_id, kept ORDER BY turn) <= 4 AS in_prompt FROM turns)"""


def _embedded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All questions, and all documents as chunks, with their vectors; both written once."""
    chunks = written(spark, embed.embed(_chunks(spark, sf_dir), "text"), "chunks")
    return written(spark, embed.embed(_questions(spark, sf_dir), "question"), "questions"), chunks


def _hybrid(spark, sf_dir) -> DataFrame:
    questions, chunks = _embedded(spark, sf_dir)
    return fusion.retrieve(spark, questions, chunks, prompt_budget=4, most_chunks=None)


@query(f"WITH {_HY} SELECT question_id, ord, abs(round(distance, 6)) AS distance, kept, source, round(lexical_score, 6) AS lexical_score, in_prompt FROM cand")
def hybrid_retrieve(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("question_id", "ord", F.abs(F.round("distance", 6)).alias("distance"), "kept", "source", F.round("lexical_score", 6).alias("lexical_score"), "in_prompt")


@query(f"WITH {_HY} SELECT question_id, sha256(string_agg(text, chr(10) ORDER BY distance, scope, ord)) AS texts FROM cand WHERE in_prompt GROUP BY question_id")
def prompt_budget(spark, sf_dir):
    return fusion.prompt_texts(_hybrid(spark, sf_dir)).select("question_id", F.sha2(F.array_join("texts", "\n"), 256).alias("texts"))


@query(f"""WITH {_HY} SELECT question_id, ord, source, CASE WHEN in_prompt THEN 'accepted' WHEN kept THEN 'over budget' WHEN distance > 0.63 THEN 'too far' ELSE 'no shared words' END AS verdict,
CASE WHEN length(text) > 70 THEN left(replace(text, chr(10), ' '), 70) || '…' ELSE replace(text, chr(10), ' ') END AS preview FROM cand""")
def explain_retrieval(spark, sf_dir):
    return fusion.explain(_hybrid(spark, sf_dir)).select("question_id", "ord", "source", "verdict", "preview")


_POLICY_OF = "CASE WHEN question_id % 2 = 0 THEN 'strict' ELSE 'open' END"


@query(f"""WITH {_HY} SELECT question_id, count(*) AS candidates, count(*) FILTER (kept) AS kept, count(*) FILTER (in_prompt) AS in_prompt, count(*) FILTER (kept AND NOT in_prompt) AS trimmed,
count(*) FILTER (NOT kept AND distance <= 0.63) AS no_shared_words, round(CASE WHEN count(*) FILTER (kept) = 0 THEN min(CASE WHEN distance > 0.63 THEN distance - 0.63 END) END, 6) AS missed_by,
count(*) FILTER (kept) = 0 AND {_POLICY_OF} = 'open' AS ungrounded FROM cand GROUP BY question_id""")
def explain_summary(spark, sf_dir):
    policies = _questions(spark, sf_dir).select("question_id", F.when(F.col("question_id") % 2 == 0, "strict").otherwise("open").alias("policy"))
    return fusion.explain_summary(_hybrid(spark, sf_dir), policies=policies).withColumn("missed_by", F.round("missed_by", 6))


_STRICT, _OPEN, _UNSUPPORTED = policy.POLICIES["strict"][0], policy.POLICIES["open"][0], policy.POLICIES["open"][1]
_PROMPT = f"""WITH {_HY}, ctx AS (SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY distance, scope, ord) AS c FROM cand WHERE in_prompt GROUP BY question_id)
SELECT question_id, policy, sha256(CASE WHEN c IS NOT NULL THEN replace(replace(CASE WHEN policy = 'strict' THEN {q(_STRICT)} ELSE {q(_OPEN)} END, '{{question}}', question), '{{context}}', c) WHEN policy = 'open' THEN replace({q(_UNSUPPORTED)}, '{{question}}', question) END) AS prompt
FROM (SELECT question_id, question, CASE WHEN question_id % 2 = 0 THEN 'strict' ELSE 'open' END AS policy FROM questions) LEFT JOIN ctx USING (question_id)"""


@query(_PROMPT)
def build_prompt(spark, sf_dir):
    asked = _questions(spark, sf_dir).withColumn("policy", F.when(F.col("question_id") % 2 == 0, "strict").otherwise("open"))
    p = policy.prompts(spark, asked, fusion.prompt_texts(_hybrid(spark, sf_dir)))
    return p.select("question_id", "policy", F.sha2("prompt", 256).alias("prompt"))


_ANSWERS = f"""ctx AS (SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY distance, scope, ord) AS c FROM cand WHERE in_prompt GROUP BY question_id),
answered AS (SELECT question_id, 'strict' AS policy, CASE WHEN c IS NULL THEN {q(policy.NO_CONTEXT)}
  ELSE left(string_split({s_strip("(c || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:')")}, '. ')[1], 200) END AS answer FROM questions LEFT JOIN ctx USING (question_id))"""


@query(f"WITH {_HY}, {_ANSWERS} SELECT question_id, policy, answer FROM answered")
def answer_questions(spark, sf_dir):
    asked = _questions(spark, sf_dir).withColumn("policy", F.lit("strict"))
    return policy.answers(policy.prompts(spark, asked, fusion.prompt_texts(_hybrid(spark, sf_dir))))


# ---- evaluation: the key of a question is its third word ----

_KEYS = "keys AS (SELECT question_id, string_split(question, ' ')[3] AS answer_key FROM questions)"
_JUDGED = f"""{_HY}, {_KEYS}, per AS (SELECT question_id, coalesce(bool_or(kept AND contains(text, answer_key)), false) AS hit, coalesce(bool_or(in_prompt AND contains(text, answer_key)), false) AS prompt_hit,
coalesce(bool_or(NOT kept AND contains(text, answer_key)), false) AS gated, min(distance) AS nearest FROM keys LEFT JOIN cand USING (question_id) GROUP BY question_id)"""


def _keys(spark, sf_dir) -> DataFrame:
    return _questions(spark, sf_dir).select("question_id", F.get(F.split("question", " "), F.lit(2)).alias("answer_key"))


@query(f"WITH {_JUDGED} SELECT count(*) AS questions, count(*) FILTER (hit) AS hits, round(avg(CAST(hit AS DOUBLE)), 6) AS recall, count(*) FILTER (hit AND NOT prompt_hit) AS trimmed, count(*) FILTER (NOT hit AND gated) AS missed_by_gate, count(*) FILTER (NOT hit AND NOT gated) AS missed_by_rank FROM per")
def eval_recall(spark, sf_dir):
    r = evaluate.recall(evaluate.judged(_hybrid(spark, sf_dir), _keys(spark, sf_dir)))
    return r.withColumn("recall", F.round("recall", 6))


@query(f"WITH {_JUDGED} SELECT question_id, hit, CASE WHEN NOT hit THEN CASE WHEN gated THEN 'gate' ELSE 'rank' END END AS cause, abs(round(nearest, 6)) AS nearest FROM per")
def eval_miss_cause(spark, sf_dir):
    return evaluate.judged(_hybrid(spark, sf_dir), _keys(spark, sf_dir)).select("question_id", "hit", "cause", F.abs(F.round("nearest", 6)).alias("nearest"))


# Unrelated questions: every fourth item of the benchmark, put to every source.
_UNRELATED = _HY.replace(
    "questions AS (SELECT item_id AS question_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS scope,",
    "questions AS (SELECT item_id * 1000 + CAST(substr(s.source, 4) AS BIGINT) AS question_id, s.source AS scope,",
).replace("AS t FROM benchmark)", "AS t FROM (SELECT * FROM benchmark WHERE item_id % 4 = 0) AS b, (SELECT DISTINCT source FROM documents) AS s)")


@query(f"WITH {_UNRELATED} SELECT count(*) AS questions, count(*) FILTER (a) AS false_admits FROM (SELECT question_id, coalesce(bool_or(kept), false) AS a FROM questions LEFT JOIN cand USING (question_id) GROUP BY question_id)")
def eval_false_admit(spark, sf_dir):
    questions, chunks = _embedded(spark, sf_dir)
    put = evaluate.in_every_scope(questions.where("question_id % 4 = 0"), chunks.select("scope"))
    return evaluate.false_admits(fusion.retrieve(spark, put, chunks, prompt_budget=4, most_chunks=None), put)


_SETTINGS = [{}, {"threshold": 0.3}, {"threshold": 0.9, "pool": 6}, {"budget": 1}, {"coverage": 0.9, "dense_coverage": 0.5}]


def _s_sweep(given: dict) -> str:
    """One setting: the candidates as SQL has them, with other numbers in their places."""
    h = _HY.replace("<= 0.63", f"<= {given.get('threshold', 0.63)}").replace("WHERE r <= 3),\nguarded", f"WHERE r <= {given.get('pool', 3)}),\nguarded").replace("ORDER BY turn) <= 4", f"ORDER BY turn) <= {given.get('budget', 6)}")
    h = h.replace("coverage >= 0.35)", f"coverage >= {given.get('coverage', 0.35)})").replace("coalesce(coverage, 0) <= 0)", f"coalesce(coverage, 0) <= {given.get('dense_coverage', 0)})")
    judged = _JUDGED.replace(_HY, h)
    own = ", ".join(f"CAST({given.get(k, 'NULL')} AS DOUBLE) AS {k}" for k in evaluate.SETTINGS)
    return " UNION ALL ".join(
        f"(WITH {judged} SELECT '{name}' AS evalset, {own}, count(*) AS questions, count(*) FILTER (hit) AS hits, round(avg(CAST(hit AS DOUBLE)), 6) AS recall, count(*) FILTER (hit AND NOT prompt_hit) AS trimmed,"
        f" count(*) FILTER (NOT hit AND gated) AS missed_by_gate, count(*) FILTER (NOT hit AND NOT gated) AS missed_by_rank FROM per WHERE question_id % 2 = {odd})"
        for odd, name in enumerate(("even", "odd"))
    )


@query(" UNION ALL ".join(_s_sweep(x) for x in _SETTINGS))
def eval_sweep(spark, sf_dir):
    questions, chunks = _embedded(spark, sf_dir)
    keys = _keys(spark, sf_dir)
    sets = {name: (questions.where(f"question_id % 2 = {odd}"), keys.where(f"question_id % 2 = {odd}")) for odd, name in enumerate(("even", "odd"))}
    found = evaluate.sweep(lambda asked, **given: fusion.retrieve(spark, asked, chunks, most_chunks=None, **given), sets, _SETTINGS)
    return found.withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_JUDGED}, {_ANSWERS} SELECT outcome, count(*) AS answers FROM (SELECT CASE WHEN contains(answer, answer_key) THEN CASE WHEN contains(answer, 'not from the document') THEN 'ungrounded' ELSE 'correct' END
WHEN prompt_hit THEN 'generation' ELSE 'retrieval' END AS outcome FROM answered JOIN keys USING (question_id) JOIN per USING (question_id)) GROUP BY outcome""")
def eval_answer_faults(spark, sf_dir):
    c, keys = _hybrid(spark, sf_dir), _keys(spark, sf_dir)
    asked = _questions(spark, sf_dir).withColumn("policy", F.lit("strict"))
    a = policy.answers(policy.prompts(spark, asked, fusion.prompt_texts(c)))
    return evaluate.answer_faults(a, evaluate.judged(c, keys), keys, "not from the document")


# ---- layout: lines of documents on made-up pages of 24 lines ----

_GEO = f"""geo AS (SELECT doc_id AS doc, line // 24 + 1 AS page, line % 24 AS line, CASE WHEN line % 24 = 0 THEN CASE WHEN line // 24 % 2 = 0 THEN 'Report ' ELSE 'report ' END || CAST(line // 24 AS VARCHAR) WHEN line % 24 = 23 THEN text || ' part-' WHEN line % 24 IN (2, 12, 22) THEN text || ';'
    WHEN line % 24 = 7 THEN 'این یک خط است X' WHEN line % 24 = 9 THEN 'ANNUAL REPORT' WHEN line % 24 = 10 THEN 'ÄÖÜ ABC' ELSE text END AS text,
  CAST(CASE WHEN line % 7 = 3 THEN 60 WHEN line % 7 = 5 THEN 52 ELSE 40 END AS DOUBLE) AS x0, CAST(10 + 14 * (line % 24) + CASE WHEN line % 24 >= 12 THEN 20 ELSE 0 END AS DOUBLE) AS y0, CAST(CASE WHEN line % 5 = 4 THEN 200 WHEN line % 5 = 2 THEN 340 ELSE 500 END AS DOUBLE) AS x1,
  CAST(10 + 14 * (line % 24) + CASE WHEN line % 24 >= 12 THEN 20 ELSE 0 END + 11 AS DOUBLE) AS y1, CAST(CASE WHEN line % 24 = 5 THEN 16 ELSE 10 END AS DOUBLE) AS size, line % 24 = 5 AS bold FROM ({_LINES})),
pg AS (SELECT DISTINCT doc, page, CAST(400 AS DOUBLE) AS height FROM geo)"""


def _geometry(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = F.col("line") % 24
    page = F.floor(F.col("line") / 24)
    y = (10 + 14 * n + F.when(n >= 12, 20).otherwise(0)).cast("double")
    lines = _doc_lines(spark, sf_dir).select(
        F.col("doc_id").alias("doc"), (page + 1).alias("page"), n.alias("line"),
        F.when(n == 0, F.concat(F.when(page % 2 == 0, "Report ").otherwise("report "), page.cast("string"))).when(n == 23, F.concat("text", F.lit(" part-"))).when(n.isin(2, 12, 22), F.concat("text", F.lit(";")))
        .when(n == 7, "این یک خط است X").when(n == 9, "ANNUAL REPORT").when(n == 10, "ÄÖÜ ABC").otherwise(F.col("text")).alias("text"),
        F.when(F.col("line") % 7 == 3, 60.0).when(F.col("line") % 7 == 5, 52.0).otherwise(40.0).alias("x0"), y.alias("y0"), F.when(F.col("line") % 5 == 4, 200.0).when(F.col("line") % 5 == 2, 340.0).otherwise(500.0).alias("x1"), (y + 11).alias("y1"),
        F.when(n == 5, 16.0).otherwise(10.0).alias("size"), (n == 5).alias("bold"),
    )
    return lines, lines.select("doc", "page", F.lit(400.0).alias("height")).distinct()


_SPAN = "w || CASE WHEN i % 3 = 2 THEN chr(173) ELSE '' END"


@query(f"""WITH s AS (SELECT doc_id, line, CAST(i - 1 AS BIGINT) AS i, ws[i] AS w FROM (SELECT doc_id, line, string_split(text, ' ') AS ws FROM ({_LINES})), unnest(generate_series(1, len(ws))) AS g(i)),
c AS (SELECT *, {s_clean("(" + _SPAN + ")")} AS t, 100.0 * i AS x0, 100.0 * i + 10 * length(w) AS x1 FROM s),
k AS (SELECT *, lag(t) OVER o AS pt, lag(x0) OVER o AS px0, lag(x1) OVER o AS px1 FROM c WHERE t <> '' WINDOW o AS (PARTITION BY doc_id, line ORDER BY i)),
j AS (SELECT doc_id, line, string_agg(CASE WHEN pt IS NOT NULL AND x0 - px1 > 0.25 * ((px1 - px0) / greatest(1, length(pt))) THEN ' ' || t ELSE t END, '' ORDER BY i) AS text FROM k GROUP BY doc_id, line),
b AS (SELECT doc_id, line, min(x0) AS x0, max(x1) AS x1, CAST(max(8 + i % 3) AS DOUBLE) AS size, bool_and(line % 2 = 0 OR i = 0) AS bold FROM c GROUP BY doc_id, line)
SELECT doc_id AS doc, line, sha256({s_strip(sub("text", f"[{H}]+", "' '"))}) AS text, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, size, bold FROM j JOIN b USING (doc_id, line)""")
def span_lines(spark, sf_dir):
    """Every word of a line is a span; long ones reach into the next, and some hold a mark that is not seen."""
    words = _doc_lines(spark, sf_dir).select("doc_id", "line", F.posexplode(F.split("text", " ")).alias("i", "w"))
    x0 = 100.0 * F.col("i")
    spans = words.select(
        F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("block"), "line", F.col("i").alias("span"), F.lit(0).alias("type"), F.concat("w", F.when(F.col("i") % 3 == 2, chr(173)).otherwise("")).alias("text"),
        x0.alias("x0"), (x0 + 10 * F.length("w")).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), (8.0 + F.col("i") % 3).alias("size"),
        F.when(F.col("line") % 2 == 0, 16).otherwise(0).alias("flags"), F.when(F.col("i") == 0, "Some-BOLD").otherwise("Some").alias("font"),
    )
    return layout.span_lines(spans).select("doc", "line", F.sha2("text", 256).alias("text"), "x0", "x1", "size", "bold")


_KEY = s_strip(sub("lower(" + s_clean("text") + ")", r"\p{Nd}+", "'#'"))
_ZONE = "(y1 <= 0.12 * height OR y0 >= 0.88 * height)"
_FURN = f"""{_GEO}, n AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc HAVING count(*) >= 3),
furn AS (SELECT doc, key FROM (SELECT doc, page, {_KEY} AS key FROM geo JOIN pg USING (doc, page) WHERE {_ZONE}) JOIN n USING (doc) WHERE key <> '' GROUP BY doc, key HAVING count(DISTINCT page) >= greatest(2, round_even(any_value(n) * 0.5, 0)))"""


@query(f"WITH {_FURN} SELECT doc, key FROM furn")
def furniture(spark, sf_dir):
    lines, pages = _geometry(spark, sf_dir)
    return layout.furniture(lines, pages, compose=False)


@query(f"WITH {_FURN} SELECT g.doc, g.page, g.line FROM geo g JOIN pg USING (doc, page) WHERE NOT ({_ZONE} AND EXISTS (SELECT 1 FROM furn f WHERE f.doc = g.doc AND f.key = {_KEY.replace('text', 'g.text')}))")
def drop_furniture(spark, sf_dir):
    lines, pages = _geometry(spark, sf_dir)
    return layout.drop_furniture(lines, pages, layout.furniture(lines, pages, compose=False), compose=False).select("doc", "page", "line")


@query(f"WITH {_GEO} SELECT doc, page, line FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, {_KEY}, x0 ORDER BY line) AS r FROM geo) WHERE r = 1")
def dedupe_lines(spark, sf_dir):
    lines, _ = _geometry(spark, sf_dir)
    return layout.drop_repeated(lines.withColumn("y0", F.lit(0.0)), compose=False).select("doc", "page", "line")


_OPENW = f"regexp_matches({sub('pt', rf'[{H}\n]+$')}, {q(CONTINUES)})"
_LISTRE = q(rf"^[{H}\n]*([-*•▪◦‣–—][{H}\n]|\(?[0-9٠-٩۰-۹]{{1,3}}[.)\-][{H}\n]|[A-Za-zا-ی][.)][{H}\n])")
_STRIP = s_strip("text")
_LETTERS = sub("text", "[^A-Za-z]")
_R, _O = f"length({sub('text', f'[^{RIGHT_TO_LEFT}]')})", f"length({sub('text', rf'[^\p{{L}}]|[{RIGHT_TO_LEFT}]')})"
_HEADSQL = f"""({s_words("text")} <= 16 AND {_STRIP} <> '' AND NOT regexp_matches({_STRIP}, '[.،؛,]$') AND ((body > 0 AND size >= 1.15 * body) OR (boldm AND bold AND body > 0 AND size >= body)
OR (CASE WHEN {_R} + {_O} = 0 THEN 0 ELSE CAST({_R} AS DOUBLE) / ({_R} + {_O}) END < 0.5 AND length({_LETTERS}) >= 4 AND {_LETTERS} = upper({_LETTERS}) AND length({_STRIP}) <= 80)))"""
_PARA = f"""{_GEO}, seqd AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY round(y0, 1), x0, line) AS seq FROM geo),
gaps AS (SELECT *, greatest(0, y0 - lag(y1) OVER b) AS gap FROM seqd WINDOW b AS (PARTITION BY doc, page ORDER BY seq)),
meas AS (SELECT *, median(size) OVER p AS body, 11.0 AS lh, max(x1 - x0) OVER p AS width, min(x0) OVER p AS lft, max(x1) OVER p AS rgt, avg(CAST(bold AS DOUBLE)) OVER p < 0.3 AS boldm, coalesce(median(gap) OVER p, 0) AS lead_ FROM gaps WINDOW p AS (PARTITION BY doc, page)),
cls AS (SELECT *, {_HEADSQL} AS head, regexp_matches(text, {_LISTRE}) AS lst FROM meas),
prev AS (SELECT *, lag(text) OVER b AS pt, lag(y1) OVER b AS py1, lag(x1 - x0) OVER b AS pw, lag(size) OVER b AS ps, lag(head) OVER b AS ph FROM cls WINDOW b AS (PARTITION BY doc, page ORDER BY seq)),
brk AS (SELECT *, pt IS NULL OR head OR lst OR ph OR (body > 0 AND ps > 0 AND size > 0 AND abs(size - ps) / body > 0.15) OR (NOT {_OPENW} AND x0 - lft > greatest(0.02 * width, 6) AND x1 >= rgt - 0.1 * width)
  OR y0 - py1 > lead_ + greatest(lh * 0.5, 1.5) OR (NOT {_OPENW} AND pw < 0.5 * width) OR (NOT {_OPENW} AND pw < 0.72 * width AND regexp_matches({s_strip("pt")}, '[.؟!?:؛;…]$')) AS nw FROM prev),
num AS (SELECT *, CAST(sum(CAST(nw AS INTEGER)) OVER (PARTITION BY doc, page ORDER BY seq) AS INTEGER) AS p FROM brk),
grp AS (SELECT doc, page, p AS seq, list_prepend('', list(text ORDER BY seq)) AS ls, arg_min(CASE WHEN head THEN 'heading' WHEN lst THEN 'list' ELSE 'body' END, seq) AS kind FROM num GROUP BY doc, page, p),
par AS (SELECT doc, page, seq, {_FOLD} AS text, kind FROM grp)"""


@query(f"WITH {_PARA} SELECT doc, page, seq, sha256(text) AS text, kind FROM par WHERE text <> ''")
def paragraphs(spark, sf_dir):
    lines, _ = _geometry(spark, sf_dir)
    return layout.paragraphs(layout.by_position(lines)).withColumn("text", F.sha2("text", 256))


@query(f"""WITH {_PARA}, pp AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, seq) AS r FROM par WHERE text <> ''),
lp AS (SELECT *, lag(page) OVER w AS lpage, lag(kind) OVER w AS lkind, lag(text) OVER w AS ltext FROM pp WINDOW w AS (PARTITION BY doc ORDER BY r)),
mm AS (SELECT *, CAST(sum(CASE WHEN coalesce(lpage <> page AND lkind = 'body' AND kind = 'body' AND NOT regexp_matches({s_strip("ltext")}, '[.؟!?:؛;…»")]$') AND NOT regexp_matches(text, '^\\p{{Lu}}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY r) AS INTEGER) AS s FROM lp),
mg AS (SELECT doc, s AS seq, min(page) AS page, list_prepend('', list(text ORDER BY r)) AS ls, arg_min(kind, r) AS kind FROM mm GROUP BY doc, s)
SELECT doc, seq, page, sha256({_FOLD}) AS text, kind FROM mg""")
def merge_pages(spark, sf_dir):
    lines, _ = _geometry(spark, sf_dir)
    return layout.merge_pages(layout.paragraphs(layout.by_position(lines))).withColumn("text", F.sha2("text", 256))


@query()
def reading_order(spark, sf_dir):
    """The same lines in two columns: every other half page moves to the right."""
    lines, _ = _geometry(spark, sf_dir)
    right = F.col("line") >= 12
    two = lines.withColumn("x0", F.when(right, 320.0).otherwise(40.0)).withColumn("x1", F.when(right, 560.0).otherwise(280.0))
    y = 10 + 14 * (F.col("line") % 12)
    return layout.in_reading_order(two.withColumn("y0", y.cast("double")).withColumn("y1", (y + 11).cast("double"))).select("doc", "page", "line", "seq")


@query()
def document_paragraphs(spark, sf_dir):
    lines, pages = _geometry(spark, sf_dir)
    return layout.document_paragraphs(lines, pages).withColumn("text", F.sha2("text", 256))


@query(f"WITH {_GEO} SELECT doc, page FROM (SELECT doc, page, sum(length(text)) AS c FROM geo GROUP BY doc, page) WHERE c < 40")
def empty_pages(spark, sf_dir):
    lines, pages = _geometry(spark, sf_dir)
    return layout.empty_pages(pages, lines)


@query(f"WITH {_GEO} SELECT doc, page, line, CAST(CASE WHEN y0 >= 150 THEN 1 ELSE 0 END AS INTEGER) AS part FROM geo WHERE NOT (y1 > 100 AND y0 < 150)")
def split_bands(spark, sf_dir):
    lines, pages = _geometry(spark, sf_dir)
    bands = pages.select("doc", "page", F.lit(1).alias("band"), F.lit(100.0).alias("y0"), F.lit(150.0).alias("y1"))
    return layout.split_by_bands(lines, bands).select("doc", "page", "line", "part")


_BARE = s_strip(sub(s_strip("text"), """^["'«» ]+|["'«» ]+$"""))


@query(f"""WITH {_GEO}, top AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY y0, line) AS r, count(*) OVER (PARTITION BY doc) AS n, median(size) OVER (PARTITION BY doc) AS body FROM geo WHERE page = 1)
SELECT doc, title FROM (SELECT doc, arg_max({_BARE}, size * 1e9 - y0 * 1e3 - line) AS title FROM top WHERE r <= greatest(12, n // 4) AND size > 1.15 * body AND {s_words("text")} BETWEEN 1 AND 16
AND NOT regexp_matches(lower({_BARE}), 'untitled|microsoft word|document1|[.]doc|[.]pdf|[.]tex') GROUP BY doc) WHERE title <> ''""")
def first_page_title(spark, sf_dir):
    lines, _ = _geometry(spark, sf_dir)
    return layout.first_page_title(lines).where("title <> ''")


# ---- the flagship: documents to chunks to candidates, with the built-in embedder ----


@query()
def flagship_retrieve(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.col("text").alias("content"), "doc_id")
    lists = d.select(F.col("url").alias("scope"), F.posexplode(chunking.splitter()(T.normalize(F.col("content")))).alias("at", "text"), "doc_id")
    # A chunk's number in its scope: unique for 2**32 chunks of a document.
    chunks = embed.embed(lists.select("scope", (F.shiftleft(F.col("doc_id"), 32) + F.col("at")).alias("ord"), "text"), "text")
    questions = embed.embed(_questions(spark, sf_dir), "question")
    return fusion.retrieve(spark, written(spark, questions, "questions"), written(spark, chunks, "chunks"), most_chunks=None, threshold=0.8)
