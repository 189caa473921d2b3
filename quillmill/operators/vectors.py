"""Dense vectors: exact nearest neighbours by cosine, and hashed vectors of texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the vectors serves.
BLOCK = 8192
DIMENSIONS = 768


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, id, score, place)``: the ``k`` vectors of highest cosine, ties by id; a query finds itself if it is in ``vectors``.

    A stated set of queries, BLOCK at a time, is held against all vectors: each Arrow batch is one matrix product that keeps its ``k`` best for each query, so only
    those are shuffled.  Null vectors and those of another length drop out; a zero vector has cosine 0.
    """
    out = None
    q = queries.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.col(vector_col).alias("v"))
    blocks = max(1, -(-q.count() // BLOCK))
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").collect()
        if not part:
            continue
        size = max(len(r.v) for r in part)
        ids = np.array([r.i for r in part if len(r.v) == size], np.int64)
        matrix = _unit(np.array([r.v for r in part if len(r.v) == size], np.float64))

        def best(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix, size: int = size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i is not None and v is not None and len(v) == size]
                if not keep:
                    continue
                own = np.array([i for i, _ in keep], np.int64)
                order = np.argsort(own, kind="stable")
                own = own[order]
                scores = np.round(matrix @ _unit(np.array([v for _, v in keep], np.float64)[order]).T, 12)
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(ids.size), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(own[at.reshape(-1)]), pa.array(scores[rows, at.reshape(-1)])], names=["query_id", "id", "score"])

        found = vectors.select(F.col(id_col).cast("bigint"), vector_col).mapInArrow(best, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, place int")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(id, embedding)``: counts of the runs of 2 to 5 characters of each word, padded with a space on both sides, hashed to ``dimensions`` and brought to length 1.

    The hash is CRC-32, so buckets are this library's own.  Null and blank texts give the zero vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.zeros((b.num_rows, dimensions))
            for r, s in enumerate(b.column(1).to_pylist()):
                for word in (s or "").lower().split():
                    w = f" {word} "
                    for n in range(2, 6):
                        if n >= len(w):
                            m[r, zlib.crc32(w.encode("utf-8", "surrogatepass")) % dimensions] += 1
                            break
                        for k in range(len(w) - n + 1):
                            m[r, zlib.crc32(w[k : k + n].encode("utf-8", "surrogatepass")) % dimensions] += 1
            flat = pa.array(_unit(m).astype(np.float32).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dimensions), flat)], names=["id", "embedding"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, embedding array<float>")
