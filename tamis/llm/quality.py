"""Quality rules, native: countable rules and a hashed n-gram log-likelihood ratio.

Two multinomials over BUCKETS hashed n-grams (words, pairs of words, word endings of three
characters) are counted: one of a trusted target, one of the whole raw corpus.  A document's score
is the mean log ratio of its n-grams, so length does not count; a fixed threshold decides every
document.  Everything is DataFrame expressions on the JVM.  The driver holds the log ratios, one
whole number (in thousandths) for each bucket, and puts them into the scoring plan as a constant.

The trusted target are all rows labelled good; their ids are broadcast while they are few, by count,
and joined by a shuffle beyond.  Raw counts cover all documents.

Defined cases: a null or empty text has no words, zero counts and fails the base rules; a text of any
length is judged whole; without trusted rows all log ratios are zero and the base rules decide;
repeated rows are judged alike, and each row of a trusted id counts for the target; a null id is not
trusted; an empty table has no verdicts; other columns of the input, whatever their names, are kept
by ``keep_good`` and do not matter otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.tables import read

SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOL_OTHERS = r"[^#*$%&|<>]+"
WINDOW = 8
BUCKETS = 1 << 15
UNIT = 1000
#: Mean log ratio of an n-gram, below which a text is unlike the trusted target.
THRESHOLD = -0.25
MIN_WORDS = 20
REPEAT_PERCENT = 30


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def pair_hashes(hashes: Column, apart: int) -> Column:
    """Hash of each item with the one ``apart`` places on."""
    return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - apart, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + apart)))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column words) and: h1 and h2, hashes of words and pairs; grams, buckets of all n-grams."""
    mask = F.lit(BUCKETS - 1)
    hashed = docs.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    paired = hashed.withColumn("h2", pair_hashes(F.col("h1"), 1))
    return paired.withColumn(
        "grams",
        F.concat(
            F.transform("h1", lambda h: h.bitwiseAND(mask)),
            # A word said twice in a row is one n-gram, whatever the word.
            F.transform("h2", lambda h, i: F.when(F.get("h1", i) == F.get("h1", i + 1), F.lit(0).cast("long")).otherwise(h.bitwiseAND(mask))),
            F.transform("words", lambda w: F.xxhash64(F.right(w, F.lit(3)), F.lit(3)).bitwiseAND(mask)),
        ),
    )


def weights(spark: SparkSession, docs: DataFrame, trusted: DataFrame) -> list[int]:
    """The log ratio of each bucket in thousandths.  docs: doc_id, text.  trusted: doc_id."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    marked = docs.join(shared.broadcast_if_small(ids), F.col("doc_id") == F.col("trusted_id"), "left").select("trusted_id", words(F.col("text")).alias("words"))
    # An outer explode: a plain one infers a filter on the array's size, which is pushed down to the scan.
    grams = features(marked).select("trusted_id", F.explode_outer("grams").alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted_id").alias("target"))
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for row in counts.collect():  # at most BUCKETS rows
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if sum(target) == BUCKETS:
        return [0] * BUCKETS
    apart = math.log(sum(raw) / sum(target))
    return [round(UNIT * (math.log(t / r) + apart)) for t, r in zip(target, raw, strict=True)]


def repeat_words(h8: Column) -> Column:
    """Words inside windows that stand at least twice; h8: hashes of the windows."""

    def covered(s: Column) -> Column:
        same = lambda j, o: F.coalesce(F.get(s, j)["h"] == F.get(s, j + o)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, -1) | same(j, 1))
        places = F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))
        return let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x))

    ordered = F.array_sort(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h8)) < F.size(h8), let(ordered, covered)).otherwise(F.lit(0)).cast("long")


def judge(spark: SparkSession, docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _verdicts(spark, own, own, trusted, threshold).withColumnRenamed("doc_id", doc_id)


def _verdicts(spark: SparkSession, own: DataFrame, keyed: DataFrame, trusted: DataFrame, threshold: float) -> DataFrame:
    """Verdicts on ``keyed`` (text and one other column), learnt from ``own`` (doc_id, text)."""
    model = weights(spark, own, trusted)
    rest = [c for c in keyed.columns if c != "text"]
    # Plain counts of the text stand beside the words, so the text itself ends here.
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    first = keyed.select(
        *rest,
        words(F.col("text")).alias("words"),
        F.length(F.regexp_replace("text", SYMBOL_OTHERS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    second = features(first).withColumn("h4", pair_hashes(F.col("h2"), 2)).withColumn("h8", pair_hashes(F.col("h4"), 4))
    weight = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folded to one constant
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + F.get(weight, g.cast("int")))
    third = second.select(
        *rest,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeat_words(F.col("h8")).alias("n_repeat_words"),
        F.coalesce(F.try_divide(total, F.size("grams") * UNIT), F.lit(0.0)).alias("llr"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = third.withColumn("base_failed", failed)
    # A barrier, always true: the optimizer moves no filter below an expression that depends on the
    # row's place, where it would compute the arrays anew for every item of a condition.
    barrier = F.monotonically_increasing_id() >= 0
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & barrier)


def keep_good(spark: SparkSession, docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with its own columns, without those that the rules reject."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _verdicts(spark, own, whole, trusted, threshold).where("kept").select("row.*")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, read(spark, sf_dir, "documents"), good_labels(spark, sf_dir))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
