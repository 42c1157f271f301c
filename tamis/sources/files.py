"""Documents from text files, and the baseline report over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import normalize, title_of_name, word_count
from tamis.sources import paged

MOST_BYTES = 32 << 20


def _text(files: DataFrame) -> DataFrame:
    """Documents of text and Markdown files (path, length, content); Markdown is plain text here."""
    raw = F.try_validate_utf8("content")
    lines = F.regexp_replace(raw, "\r\n?", "\n")
    parts = F.filter(F.transform(F.split(lines, r"\n\s*\n"), normalize), lambda p: p != "")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(title_of_name(name).alias("title"), F.array_join(parts, "\n\n").alias("content"), F.col("path").alias("source_id"), F.lit("text").alias("kind"), F.array().cast("array<string>").alias("notes"))


#: Readers by suffix; add one to read another format.  A paged format needs a reader of its bytes (see paged.py).
READERS = {".pdf": None, ".txt": _text, ".md": _text, ".markdown": _text}


def suffixes() -> list[str]:
    return sorted(READERS)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def load(spark: SparkSession, path: str, paged_reader: paged.Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of all files below a path, and the files that were refused (path, reason).

    ``paged_reader`` decodes the bytes of paged files; without one they are refused by that reason."""
    return dispatch(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), paged_reader)


def dispatch(files: DataFrame, paged_reader: paged.Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for files (path, length, content) that are read already."""
    known = ", ".join(suffixes())
    is_paged = suffix_of(F.col("path")).isin(*[s for s, r in READERS.items() if r is None])
    reason = (
        F.when(~suffix_of(F.col("path")).isin(*READERS), F.concat(F.lit("unknown suffix; known: "), F.lit(known)))
        .when(is_paged, F.lit(None if paged_reader else "no reader of paged files is given"))
        .when(F.col("length") > MOST_BYTES, F.lit("larger than 32 MiB"))
        .when(F.try_validate_utf8("content").isNull(), F.lit("not UTF-8"))
    )
    marked = files.withColumn("reason", reason)
    good = marked.where("reason is null")
    out = None
    for reader in filter(None, dict.fromkeys(READERS.values())):
        own = [s for s, r in READERS.items() if r is reader]
        part = reader(good.where(suffix_of(F.col("path")).isin(*own)))
        out = part if out is None else out.unionByName(part)
    refused = marked.where("reason is not null").select("path", "reason")
    if paged_reader:
        decoded = paged.decode(good.where(is_paged), paged_reader)
        out = out.unionByName(paged.from_decoded(decoded))
        refused = refused.union(decoded.where("reason is not null").select("path", "reason"))
    return out, refused


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def baseline(documents: DataFrame, key: str = "source_id") -> DataFrame:
    """What identifies each document's text: counts, digest, head and tail."""
    c = F.coalesce("content", F.lit(""))
    return documents.select(
        F.col(key).alias("name"), "title", F.length(c).cast("long").alias("content_chars"), word_count(c).alias("content_words"), F.sha2(c, 256).alias("content_sha256"),
        F.left(c, F.lit(160)).alias("content_head"), F.right(c, F.lit(120)).alias("content_tail"), F.when(c == "", 0).otherwise(F.size(F.split(c, "\n\n"))).cast("long").alias("paragraphs"),
    )


def baseline_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names whose title, words or digest differ, or that only one side has."""
    o = old.select("name", F.struct("title", "content_words", "content_sha256").alias("old"))
    n = new.select("name", F.struct("title", "content_words", "content_sha256").alias("new"))
    return o.join(n, "name", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def update_baseline(spark: SparkSession, documents: DataFrame, path: str, *, key: str = "source_id", write: bool = False) -> DataFrame:
    """Names that differ from the baseline stored at ``path`` (JSON rows), which is written anew only if asked for.

    Without a stored baseline every name differs."""
    fresh = baseline(documents, key)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    old = spark.read.schema(fresh.schema).json(path) if there else fresh.limit(0)
    # Read before the table it is read from is replaced.
    changed = spark.createDataFrame(baseline_diff(old, fresh).select("name").collect(), fresh.select("name").schema)  # one name a document that changed
    if write:
        fresh.write.mode("overwrite").json(path)
    return changed
