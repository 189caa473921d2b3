"""Indexes and vectors as Parquet tables that are written once and read by any number of searches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import build
from ..operators.tfidf import SPACES, Index
from ..operators.vectors import hashed_vectors

TABLES = ("postings", "vocab", "norms")


def save_indexes(indexes: dict[str, Index], folder: str) -> None:
    """Replaces what the folder holds.  Postings are sorted by term within files, so a search that joins few terms skips row groups."""
    for space, index in indexes.items():
        for name in TABLES:
            rows: DataFrame = getattr(index, name)
            rows = rows.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else rows
            rows.write.mode("overwrite").parquet(f"{folder}/{space}/{name}")


def load_indexes(spark: SparkSession, folder: str) -> dict[str, Index]:
    return {s: Index(s, *(spark.read.parquet(f"{folder}/{s}/{name}") for name in TABLES)) for s in SPACES}


def save_vectors(chunks: DataFrame, folder: str) -> None:
    """Hashed vectors of chunks ``(ord, text, ...)``; replaces what the folder holds."""
    hashed_vectors(chunks.where("ord IS NOT NULL"), "ord", "text").withColumnRenamed("id", "vec_id").write.mode("overwrite").parquet(folder)


def open_store(spark: SparkSession, chunks: DataFrame, folder: str, backend: str = "tfidf") -> tuple[str, object]:
    """The store of a backend, ``tfidf`` or ``vectors``, built where the folder holds none; a vector store that can't be made falls back to the other.

    Returns the backend that serves, and its indexes or vectors.
    """
    if backend == "vectors":
        try:
            save_vectors(chunks, f"{folder}/vectors")
            return "vectors", spark.read.parquet(f"{folder}/vectors")
        except Exception:  # noqa: BLE001 - recorded by the name that is returned
            backend = "tfidf"
    save_indexes(build(chunks), f"{folder}/tfidf")
    return backend, load_indexes(spark, f"{folder}/tfidf")


def hits_json(hits: DataFrame) -> DataFrame:
    """``(query_id, hits)``: the hits of each query in order, as JSON."""
    fields = [c for c in hits.columns if c not in ("query_id", "place")]
    return hits.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("place", *fields)))).alias("hits"))


def chat_content(response: str | None) -> str | None:
    """The text of a chat completion; None where the response has none."""
    try:
        return json.loads(response or "")["choices"][0]["message"]["content"]
    except (ValueError, LookupError, TypeError):
        return None
