"""Streams: session memory as keyed state, and ingest of files as they arrive.  The batch windows of `operators.memory` are the measure of the first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import chunk_documents
from ..operators.memory import KEPT
from ..sources.uploads import decoded

STATE = "turns array<struct<turn: bigint, role: string, content: string>>"
OUT = "session_id string, turn bigint, role string, content string, back int"


def bounded_memory(messages: DataFrame, most: int = KEPT) -> DataFrame:
    """After each batch, the last ``most`` turns of each session that got new ones; state holds no more than those."""

    def keep(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(int(t["turn"]), t["role"], t["content"]) for t in state.get[0]} if state.exists else set()
        for b in batches:
            held |= {(int(t), r, c) for t, r, c in zip(b["turn"], b["role"], b["content"], strict=True)}
        newest = sorted(held, key=lambda x: (x[0], x[1] or "", x[2] or ""), reverse=True)[:most]
        state.update(([{"turn": t, "role": r, "content": c} for t, r, c in newest],))
        yield pd.DataFrame({"session_id": key[0], "turn": [x[0] for x in newest], "role": [x[1] for x in newest], "content": [x[2] for x in newest], "back": range(1, len(newest) + 1)})

    rows = messages.where("session_id IS NOT NULL AND turn IS NOT NULL").select("session_id", "turn", "role", "content")
    return rows.groupBy("session_id").applyInPandasWithState(keep, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def ingest_files(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Chunks of files as they arrive in a folder, appended to a Parquet table; takes what is there and stops."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.{[mM][dD],[tT][xX][tT]}").option("recursiveFileLookup", True).load(folder)
    text = F.pandas_udf(lambda s: s.map(lambda raw: decoded(bytes(raw))), "string")
    chunks = chunk_documents(files.select("path", text("content").alias("text")))
    return chunks.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
