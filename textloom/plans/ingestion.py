"""Document ingestion as one plan: chunks, hashed embeddings, points and a status for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, merge, vectors


def ingest(documents: DataFrame, dimension: int = 384, longest: int = 4000, overlap: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, embedding places, statuses) of documents (document_id, title, text).

    A document without a text and title fails with a reason; the others are indexed, with their number of points. An
    error of one document doesn't stop the others.
    """
    usable = F.length(F.concat_ws("", "title", "text")) > 0
    made = chunks.document_chunks(documents.where(usable), longest, overlap)
    places = vectors.hashing_embedding(made, "point_id", "embedding_input", dimension)
    n = made.groupBy("document_id").agg(F.count("*").alias("n_points"))
    status = documents.select("document_id", usable.alias("ok")).join(n, "document_id", "left").select(
        "document_id", F.when(F.col("ok") & F.col("n_points").isNotNull(), "indexed").otherwise("failed").alias("ingestion_status"),
        F.coalesce("n_points", F.lit(0)).alias("n_points"), F.when(~F.coalesce("ok", F.lit(False)), "no text and no title").alias("error"),
    )
    return made, places, status


def replaced(old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The chunk table after an ingestion: chunks of documents that came anew replace the old ones."""
    return merge.replace_group(old_chunks, new_chunks, "document_id")
