"""Queries of the training-text operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicate_pairs

    return near_duplicate_pairs(_table(spark, sf_dir, "chunk"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .garbled import garbled_rows

    found = [garbled_rows(_table(spark, sf_dir, t), i, c, up).select(F.lit(t).alias("tbl"), F.col("id").alias("row_id")) for t, i, c, up in (("chunk", "ord", "text", False), ("upload_request", "upload_id", "content_base64", True))]
    return found[0].unionByName(found[1])


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .garbled import garbled_rows

    return garbled_rows(_table(spark, sf_dir, "chunk"), "ord", "text").withColumnRenamed("id", "ord")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import common_words, labelled_model, text_quality

    chunk = _table(spark, sf_dir, "chunk")
    words = common_words(_table(spark, sf_dir, "common_word"))
    return text_quality(chunk, words, labelled_model(chunk, _table(spark, sf_dir, "chunk_label"), words))


def p4_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).withColumnRenamed("id", "ord")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import common_words, labelled_model, not_prose

    chunk = _table(spark, sf_dir, "chunk")
    words = common_words(_table(spark, sf_dir, "common_word"))
    return not_prose(chunk, words, labelled_model(chunk, _table(spark, sf_dir, "chunk_label"), words)).withColumnRenamed("id", "ord")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .split import split_text

    return split_text(_table(spark, sf_dir, "chunk"), "ord").where("piece_no = 1").select(F.col("id").alias("ord"), "field")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .split import split_text

    return split_text(_table(spark, sf_dir, "chunk"), "ord").withColumnRenamed("id", "ord")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unicode_form import look_alike_pairs

    return look_alike_pairs(_table(spark, sf_dir, "chunk"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encode import encode_corpus

    return encode_corpus(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leakage import leaked_items

    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .residue import residue_documents

    return residue_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_restored, p3_found, p3_pieces, p4_found, p4_measures, p5_found, p6_ids, p7_found, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT ord, 'text' AS field FROM chunk WHERE length(text) > 720
            UNION ALL SELECT ord, 'section' AS field FROM chunk WHERE length(section) > 120""",
    }
