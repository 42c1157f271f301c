"""BM25 over chunks, with statistics for each scope.

Inputs are ``chunks`` (scope, ord, text) and ``questions`` (question_id, scope, question).  A null
scope of a question means all chunks: pass ``scoped=False`` and statistics are global.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import STOPWORDS, tokenize

K1, B = 1.5, 0.75
MOST_CHUNKS = 2000
SCORE_FLOOR, COVERAGE_FLOOR, ADDITIONS = 0.35, 0.35, 3


@dataclass(frozen=True)
class Index:
    """Tables of a lexical index.  Keys: scope; scope, ord; scope, token."""

    postings: DataFrame  # scope, ord, token, tf, length
    lengths: DataFrame  # scope, ord, text, length
    tokens: DataFrame  # scope, token, idf
    scopes: DataFrame  # scope, n, average, max_idf


def index(chunks: DataFrame, *, scoped: bool = True, stopwords: tuple[str, ...] = STOPWORDS, most_chunks: int | None = MOST_CHUNKS, asked: DataFrame | None = None) -> Index:
    """Count tokens.  A scope of more than ``most_chunks`` chunks has no index; None: any size has.

    ``asked`` (scope, token): only these tokens are looked up, so no others are counted."""
    own = chunks if scoped else chunks.withColumn("scope", F.lit("*"))
    counted = own.select("scope", "ord", "text", tokenize(F.col("text"), stopwords).alias("words"))
    lengths = counted.select("scope", "ord", "text", F.size("words").cast("long").alias("length"))
    scopes = lengths.groupBy("scope").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    if most_chunks is not None:
        scopes = scopes.where(F.col("n") <= most_chunks)
    scopes = scopes.withColumn("max_idf", F.log(1 + (F.col("n") + 0.5) / 0.5))
    each = counted.select("scope", "ord", F.size("words").cast("long").alias("length"), F.explode_outer("words").alias("token")).where("token is not null")
    if asked is not None:
        each = each.join(asked.select("scope", "token").distinct(), ["scope", "token"], "left_semi")
    postings = each.groupBy("scope", "ord", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = postings.groupBy("scope", "token").agg(F.count("*").alias("df"))
    tokens = df.join(scopes, "scope").select("scope", "token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Index(postings, lengths, tokens, scopes)


def question_tokens(questions: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(question_id, scope, token, times)."""
    words = questions.select("question_id", "scope", F.explode(tokenize(F.col("question"), stopwords)).alias("token"))
    return words.groupBy("question_id", "scope", "token").agg(F.count("*").alias("times"))


def matches(ix: Index, questions: DataFrame, *, k1: float = K1, b: float = B, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(question_id, scope, ord, score, coverage) of chunks that share a token with the question, in one pass over the postings.

    score: BM25, in which a token that the question repeats counts as often.  coverage: the share of the
    question's token weight that the chunk holds; unknown tokens weigh as much as the rarest could."""
    asked = question_tokens(questions, stopwords)
    weighed = asked.join(ix.tokens.select("scope", "token", "idf"), ["scope", "token"], "left").join(ix.scopes, "scope")
    weighed = weighed.withColumn("weight", F.coalesce("idf", "max_idf"))
    total = weighed.groupBy("question_id", "scope").agg(F.sum("weight").alias("total"))
    hit = weighed.where("idf is not null").join(ix.postings, ["scope", "token"])
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    summed = hit.groupBy("question_id", "scope", "ord").agg(F.sum(part).alias("score"), F.sum("weight").alias("held"))
    return summed.join(total, ["question_id", "scope"]).select("question_id", "scope", "ord", "score", (F.col("held") / F.col("total")).alias("coverage"))


def scores(ix: Index, questions: DataFrame, *, k1: float = K1, b: float = B, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(question_id, scope, ord, score) of chunks that share a token with the question; others score 0."""
    return matches(ix, questions, k1=k1, b=b, stopwords=stopwords).drop("coverage")


def coverage(ix: Index, questions: DataFrame, *, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(question_id, scope, ord, coverage) of chunks that share a token with the question; others cover nothing."""
    return matches(ix, questions, stopwords=stopwords).drop("score")


def endorsements(
    ix: Index,
    questions: DataFrame,
    *,
    score_floor: float = SCORE_FLOOR,
    coverage_floor: float = COVERAGE_FLOOR,
    additions: int = ADDITIONS,
    k1: float = K1,
    b: float = B,
    stopwords: tuple[str, ...] = STOPWORDS,
    matched: DataFrame | None = None,
) -> DataFrame:
    """(question_id, scope, text, ord, score): the best distinct texts for each question, above both floors.

    ``matched``: the result of ``matches`` where the caller has it already."""
    scored = (matches(ix, questions, k1=k1, b=b, stopwords=stopwords) if matched is None else matched).where("score > 0")
    best = scored.groupBy("question_id", "scope").agg(F.max("score").alias("best"))
    strong = scored.join(best, ["question_id", "scope"]).where((F.col("score") >= score_floor * F.col("best")) & (F.col("coverage") >= coverage_floor))
    texts = strong.join(ix.lengths.select("scope", "ord", "text"), ["scope", "ord"])
    same = Window.partitionBy("question_id", "scope", "text").orderBy(F.desc("score"), "ord")
    first = texts.withColumn("r", F.row_number().over(same)).where("r = 1")
    rank = Window.partitionBy("question_id", "scope").orderBy(F.desc("score"), "ord")
    return first.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= additions).select("question_id", "scope", "text", "ord", "score")
