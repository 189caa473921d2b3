"""What a knowledge base holds: counts of the whole, and one row for each document.  Chunks are ``(ord, doc_id, title, section, source, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Documents, chunks and distinct section names; nulls count as no name.  An empty table gives one row of zeros.

    Distinct values are grouped before they are counted, so that no task holds all of them.
    """
    docs = chunks.where("doc_id IS NOT NULL").select("doc_id").distinct().agg(F.count("*").alias("documents"))
    names = chunks.where("section IS NOT NULL").select("section").distinct().agg(F.count("*").alias("sections"))
    return docs.join(F.broadcast(chunks.agg(F.count("*").alias("chunks"))), F.lit(True)).join(F.broadcast(names), F.lit(True))


def document_catalog(chunks: DataFrame) -> DataFrame:
    """``(doc_id, title, source, chunks, sections)``: title and source of the first chunk, section names in order.  Sort by title and first place to list it.

    Section names are made distinct first, so a document of very many chunks costs no more than its distinct names in one task.
    """
    first = chunks.groupBy("doc_id").agg(F.min(F.struct("ord", "title", "source")).alias("f"), F.count("*").alias("chunks"))
    names = chunks.where("section IS NOT NULL").select("doc_id", "section").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("section")).alias("sections"))
    return first.join(names, "doc_id", "left").select("doc_id", F.col("f.title").alias("title"), F.col("f.source").alias("source"), "chunks", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), F.col("f.ord").alias("first_ord"))
