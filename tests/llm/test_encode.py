"""encode_corpus against the tokenizer on whole texts."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

from quillmill.llm.encode import VOCABULARY, encode_corpus, encoding


def test_repeated_rows_and_shared_passages(spark: SparkSession) -> None:
    rng = random.Random(3)
    words = [f"w{k}x" if k % 3 else f"{k} it's" for k in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(1500))
    rows = [(1, passage), (1, passage), (2, "Before. " + passage), (3, passage[:4000] + " then"), (4, "alone " + "".join(rng.choice(words) for _ in range(900))), (5, ""), (6, None)]
    rows += [rows[2], rows[4], rows[5], rows[6]]
    tokenizer, _ = encoding(VOCABULARY)
    expected = sorted((i, tokenizer.encode_ordinary(s or "")) for i, s in rows)
    found = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert found == expected
