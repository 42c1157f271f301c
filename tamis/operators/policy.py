"""Answering policies, prompts, and a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The policies: what to do with context, and without it (null: the model is not asked).
POLICIES = {
    "strict": ("Use only the passages below. If they do not hold the answer, say so.\n\nPassages:\n{context}\n\nQuestion: {question}\nAnswer:", None),
    "open": (
        "Prefer the passages below. Say so where you go beyond them.\n\nPassages:\n{context}\n\nQuestion: {question}\nAnswer:",
        "No passage supports an answer. Begin by saying that the answer is not from the document.\n\nQuestion: {question}\nAnswer:",
    ),
}
NO_CONTEXT = "The document says nothing about this."
EMPTY_BY_LENGTH = "warning: the model stopped at its length limit before answering"
EMPTY = "warning: the model gave no answer"


def resolve(name: str) -> tuple[str, str | None]:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known: {', '.join(POLICIES)}")
    return POLICIES[name]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in POLICIES.items()], "policy string, prompt_template string, unsupported_template string")


def prompts(spark: SparkSession, questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, policy, prompt) for questions (question_id, question, policy); null where the model is not asked.

    The question stands in the prompt as it was written.  A policy that is not known is an error, as in ``resolve``."""
    unknown = F.raise_error(F.concat(F.lit("unknown policy "), F.coalesce("policy", F.lit("null"))))
    known = F.broadcast(policies(spark).withColumn("__known", F.lit(True)))
    named = questions.join(known, "policy", "left").withColumn("policy", F.when(F.col("__known"), F.col("policy")).otherwise(unknown))
    joined = named.join(texts, "question_id", "left")
    context = F.array_join("texts", "\n\n")
    filled = lambda t: F.replace(t, F.lit("{question}"), F.col("question"))
    # The context goes in last, so nothing inside it is taken for a mark.
    with_context = F.concat(filled(F.substring_index("prompt_template", "{context}", 1)), context, filled(F.substring_index("prompt_template", "{context}", -1)))
    has = F.coalesce(F.size("texts"), F.lit(0)) > 0
    return joined.select("question_id", "policy", F.when(has, with_context).otherwise(filled(F.col("unsupported_template"))).alias("prompt"))


Generator = Callable[[str], tuple[str, str]]


def echo(prompt: str) -> tuple[str, str]:
    """A deterministic stand-in for a model: the first passage's first sentence, and why it stopped."""
    body = prompt.partition("Passages:\n")[2] or prompt
    return body.strip().split(". ")[0][:200], "stop"


def answers(prompted: DataFrame, generator: Generator = echo) -> DataFrame:
    """(question_id, policy, answer).  Rows without a prompt get a fixed answer and never reach the generator."""
    asked = prompted.where("prompt is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [generator(p) for p in part["prompt"]]
            text = [a if a.strip() else (EMPTY_BY_LENGTH if why == "length" else EMPTY) for a, why in out]
            yield pd.DataFrame({"question_id": part["question_id"], "policy": part["policy"], "answer": text})

    given = asked.select("question_id", "policy", "prompt").mapInPandas(run, "question_id long, policy string, answer string")
    fixed = prompted.where("prompt is null").select("question_id", "policy", F.lit(NO_CONTEXT).alias("answer"))
    return given.unionByName(fixed)
