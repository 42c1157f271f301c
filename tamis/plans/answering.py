"""Whole plans: documents into a store, questions to answers.  No plan holds state between calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import chunking, embed, fusion, policy
from tamis.sources import store


def ingest(spark: SparkSession, path: str, documents: DataFrame, embedder: embed.Embedder | None = None, *, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, length: chunking.Length = chunking.words) -> None:
    """Chunk and embed documents (title, content, source_id, ..) and replace their scopes in a store.

    A document that yields no chunk leaves what the store has of it."""
    own = documents.select(F.col("source_id").alias("url"), "title", "content")
    rows = embed.embed(chunking.chunk(own, size, overlap, length), "text", embedder)
    store.upsert(spark, path, rows)


def ask(spark: SparkSession, questions: DataFrame, chunks: DataFrame, *, embedder: embed.Embedder | None = None, generator: policy.Generator = policy.echo, **retrieval) -> DataFrame:
    """questions (question_id, scope, question, policy) to (question_id, policy, answer).  The policy has no say in retrieval."""
    asked = embed.embed(questions, "question", embedder)
    found = fusion.retrieve(spark, asked, chunks, **retrieval)
    return policy.answers(policy.prompts(spark, questions, fusion.prompt_texts(found)), generator)
