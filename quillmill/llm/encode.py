"""Encoding of a corpus with a public tokenizer (problem 6): content-defined chunk reuse.

1. Every text is cut where a rolling hash of its last 16 characters has a given pattern, about every 256 characters, so the same passage gives the same
   chunks in every document.  Only chunk hashes are shuffled: those that occur more than once are the shared ones.
2. Of each shared chunk one occurrence is its owner; the owner's document encodes it, once.
3. Each document joins its shared chunks' ids, encodes the rest in place, and the joins between the parts are repaired: between two parts the text from the
   last sure token-piece boundary before the join to the first one behind it is encoded again, which gives exactly the ids of the whole text.

A *sure* boundary is a place where the tokenizer's splitting pattern ends a piece whatever stands around: between a character that isn't white space nor
an apostrophe and one of another class (letter, number, white space, other).  Merges never cross such a place, so ids left and right of it don't depend
on each other.  A join without one on some side takes more text, up to the whole parts.

The vocabulary file is a parameter; the path must exist on every executor.

Defined results
    Null and empty texts give an empty list.  Special tokens' strings in a text are ordinary text.  Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unicode_form import code_points

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEAN, MOST, PART = 256, 8192, 1 << 20
UNSURE, LETTER, NUMBER, SPACE, OTHER = range(5)


@lru_cache(4)
def encoding(vocabulary: str):  # noqa: ANN201
    """The tokenizer, and the number of bytes of each id."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}  # noqa: SIM115
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


@lru_cache(1 << 16)
def char_class(ch: str) -> int:
    if ch == "'":
        return UNSURE
    if ch.isspace():
        return SPACE if ch not in "\x1c\x1d\x1e\x1f" else UNSURE
    kind = ud.category(ch)
    return {"L": LETTER, "N": NUMBER}.get(kind[0], UNSURE if kind in ("Cn", "Co", "Cs") else OTHER)


def sure(x: str, y: str) -> bool:
    """Whether a piece ends between the neighbours ``x`` and ``y`` in any text."""
    a, b = char_class(x), char_class(y)
    return UNSURE not in (a, b) and a not in (SPACE, b)


@lru_cache(1)
def _gear() -> np.ndarray:
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(text: str, mean: int = MEAN) -> list[int]:
    """Chunk ends: after a character where the hash of the last 16 ends in zeros, and every MOST characters where there is none; the text's end is the last."""
    out: list[int] = []
    last = 0
    for at in range(0, len(text), PART):
        begin = max(at - 15, 0)
        cp, _ = code_points([text[begin : at + PART]])
        h = _gear()[cp & 0xFFFF]
        for k in (1, 2, 4, 8):
            low = h.copy()
            h[k:] += low[:-k] << np.uint32(k)
        for p in (np.flatnonzero(h & np.uint32((mean - 1) << 15) == 0) + begin + 1).tolist():
            if p > max(at, last):
                while p - last > MOST:
                    last += MOST
                    out.append(last)
                out.append(p)
                last = p
    while len(text) - last > MOST:
        last += MOST
        out.append(last)
    return out if out and out[-1] == len(text) else [*out, len(text)]


def _occurrences(mean: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, sizes, keys = [], [], [], []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for end in cuts(s, mean) if s else ():
                    ids.append(i), starts.append(at), sizes.append(end - at), keys.append(xxhash.xxh3_128_digest(s[at:end].encode("utf-8", "surrogatepass")))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=["row", "start", "size", "key"])

    return run


def _encode_owned(vocabulary: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = encoding(vocabulary)
        for b in batches:
            keys, ids = [], []
            for s, owned in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in owned:
                    keys.append(x["key"])
                    ids.append(np.asarray(tokenizer.encode_ordinary(s[x["start"] : x["start"] + x["size"]]), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], names=["key", "ids"])

    return run


def joined(text: str, parts: list[tuple[int, int, np.ndarray | None]], vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of the whole text from its parts ``(start, end, ids or None)`` that follow each other; parts without ids are encoded here."""
    tokenizer, size = encoding(vocabulary)
    done: list[np.ndarray] = []  # ids that are settled
    left, begin = np.zeros(0, np.int32), 0  # ids of the part before the join, whose text begins at ``begin``

    for start, end, ids in parts:
        ids = np.asarray(tokenizer.encode_ordinary(text[start:end]), np.int32) if ids is None else ids
        if start == 0 or sure(text[start - 1], text[start]):
            done.append(left)
            left, begin = ids, start
            continue
        low = start - 1
        while low > begin and not sure(text[low - 1], text[low]):
            low -= 1
        high = start + 1
        while high < end and not sure(text[high - 1], text[high]):
            high += 1
        back = len(text[low:start].encode("utf-8", "surrogatepass"))
        ahead = len(text[start:high].encode("utf-8", "surrogatepass"))
        keep = left.size
        while back > 0:
            keep -= 1
            back -= int(size[left[keep]])
        skip = 0
        while ahead > 0:
            ahead -= int(size[ids[skip]])
            skip += 1
        middle = np.asarray(tokenizer.encode_ordinary(text[low:high]), np.int32)
        if high < end:
            done.extend((left[:keep], middle))
            left, begin = ids[skip:], high
        else:
            done.append(left[:keep])
            left, begin = middle, low
    done.append(left)
    return np.concatenate(done)


def _assemble(vocabulary: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = encoding(vocabulary)
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            for at in range(0, len(rows), 256):
                turn = rows[at : at + 256]
                values = []
                for _, s, shared in turn:
                    parts, last = [], 0
                    for x in sorted(shared or (), key=lambda x: x["start"]):
                        if x["start"] < last:  # again, of a repeated row
                            continue
                        if x["start"] > last:
                            parts.append((last, x["start"], None))
                        last = x["start"] + x["size"]
                        parts.append((x["start"], last, np.frombuffer(x["ids"], np.int32)))
                    if s and last < len(s):
                        parts.append((last, len(s), None))
                    values.append(joined(s, parts, vocabulary) if len(parts) != 1 or parts[0][2] is not None else np.asarray(tokenizer.encode_ordinary(s), np.int32))
                    if not s:
                        values[-1] = np.zeros(0, np.int32)
                offsets = np.r_[0, np.cumsum([v.size for v in values])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in turn], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))], names=["row", "ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, mean: int = MEAN) -> DataFrame:
    """``(id, ids)`` of each row.  Rows of one id must be repeats of one row; a power of two is the mean length of a chunk."""
    docs = df.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text")).repartition("row")
    found = df.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text")).mapInArrow(_occurrences(mean), "row bigint, start bigint, size bigint, key binary")
    owner = found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "size")).alias("o")).where("n > 1").select("key", F.col("o.row").alias("row"), F.col("o.start").alias("start"), F.col("o.size").alias("size"))
    owned = owner.groupBy("row").agg(F.collect_list(F.struct("start", "size", "key")).alias("owned"))
    ids = docs.join(owned, "row").select("text", "owned").mapInArrow(_encode_owned(vocabulary), "key binary, ids binary").dropDuplicates(["key"])
    shared = found.join(ids, "key").groupBy("row").agg(F.collect_list(F.struct("start", "size", "ids")).alias("shared"))
    return docs.join(shared, "row", "left").select("row", "text", "shared").mapInArrow(_assemble(vocabulary), "row bigint, ids array<int>").withColumnRenamed("row", id_col)
