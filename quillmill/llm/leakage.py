"""Evaluation texts leaking into training text (problem 7): Wu-Manber multi-pattern search.

1. Documents and items are brought to letters and digits in lower case, so that case, white space, punctuation and markup don't count.
2. Every item is cut into pieces of PIECE characters, the test strings.  A *shift table*, indexed by the hash of a block of BLOCK characters, says how far
   the window may move when its last block is seen: as far as the block stands from the end of the nearest test string.  Positions that can't end a test
   string are skipped.  Where the shift is 0, the *suffix-hash bucket* of the last block, narrowed by the hash of the first block, gives the test strings
   that may stand there, and *direct comparison* of all characters confirms them.  Many places of a batch are scanned in step, so the loop is in numpy.
3. Hits of one document and item that lie on nearly one diagonal are the seeds of a passage.  From a seed the passage is extended both ways, over gaps of a
   changed, missing or added word.  A document holds an item if a passage covers at least ``least`` of the item's characters.

Items are broadcast in groups of bounded size (ITEM_CHARS): a collection of items beyond the bound takes several passes over the documents.

Defined results
    Null or empty documents and items, and items without a letter or digit, give no row.  Repeated documents or items give each pair of ids once.  Ties need no
    rule, since every item that a document holds comes out.  Documents of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unicode_form import code_points

PIECE, BLOCK = 8, 4
LEAST = 0.5
#: Characters of a gap on either side, and characters that must agree behind it.
GAP, AGAIN = 24, 6
#: Least share of a passage's characters that stand in the document unchanged.
SAME = 0.72
#: A passage's seeds lie within so many diagonals.
SLACK = 64
#: Share of the pieces of a passage that survive changed words at least.
SURVIVE = 0.3
TABLE_BITS = 20
LANES = 4096
#: Characters of items that are broadcast at a time, 16 MB in UTF-8 at most.
ITEM_CHARS = 4_000_000


@lru_cache(1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits in lower case of all texts, one behind the other, each text ended by a 0; where each begins; and how many each has."""
    lowered = [s.lower() for s in texts]
    cp, size = code_points(lowered)
    row = np.repeat(np.arange(size.size), size)
    keep = _alnum()[cp]
    count = np.bincount(row[keep], minlength=size.size)
    begin = np.cumsum(count + 1) - count - 1
    out = np.zeros(int((count + 1).sum()), np.uint32)
    inside = np.ones(out.size, bool)
    inside[begin + count] = False
    out[inside] = cp[keep]
    return out, begin, count


def _block(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the BLOCK characters that begin at each place."""
    h = cp[at].astype(np.uint64)
    for k in range(1, BLOCK):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[at + k]
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - TABLE_BITS)


class Patterns:
    """Shift table and buckets of the pieces of all items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        cp, begin, count = plain([s for _, s in items])
        self.ids = [i for i, _ in items]
        self.cp, self.begin, self.count = cp, begin, count
        item = np.repeat(np.arange(count.size), count // PIECE)
        first = np.cumsum(count // PIECE) - count // PIECE
        place = (np.arange(item.size) - first[item]) * PIECE
        self.short = [k for k, n in enumerate(count.tolist()) if 0 < n < PIECE]
        at = begin[item] + place
        self.shift = np.full(1 << TABLE_BITS, PIECE - BLOCK + 1, np.int64)
        for k in range(PIECE - BLOCK + 1):
            np.minimum.at(self.shift, _block(cp, at + k).astype(np.int64), PIECE - BLOCK - k)
        key = _block(cp, at + PIECE - BLOCK) << np.uint64(TABLE_BITS) | _block(cp, at)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place, self.at = key[order], item[order], place[order], at[order]

    def hits(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``cp`` where a test string begins, and which."""
        none = np.zeros(0, np.int64)
        if cp.size < PIECE or not self.key.size:
            return none, none
        lanes = min(LANES, cp.size // 64 + 1)
        edges = np.linspace(PIECE - 1, cp.size, lanes + 1).astype(np.int64)
        end, stop = edges[:-1], edges[1:]
        found: list[np.ndarray] = []
        going = end < stop
        while going.any():
            end, stop = end[going], stop[going]
            shift = self.shift[_block(cp, end - BLOCK + 1).astype(np.int64)]
            zero = shift == 0
            if zero.any():
                found.append(end[zero] - PIECE + 1)
            end = end + np.maximum(shift, 1)
            going = end < stop
        if not found:
            return none, none
        at = np.concatenate(found)
        key = _block(cp, at + PIECE - BLOCK) << np.uint64(TABLE_BITS) | _block(cp, at)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        size = high - low
        which = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(at, size)
        same = np.ones(at.size, bool)
        for k in range(PIECE):
            same &= cp[at + k] == self.cp[self.at[which] + k]
        return at[same], which[same]


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far ``a`` goes on like ``b`` from their beginnings, with gaps: end in ``a``, end in ``b``, and characters that agree."""
    i = j = same = 0
    while True:
        n = min(a.size - i, b.size - j)
        differs = a[i : i + n] != b[j : j + n]
        run = int(differs.argmax()) if differs.any() else n
        i, j, same = i + run, j + run, same + run
        if run == n:
            return i, j, same
        x, y = a[i : i + GAP + AGAIN].tolist(), b[j : j + GAP + AGAIN].tolist()
        best = None
        for d in range(len(x) - AGAIN + 1):
            part = x[d : d + AGAIN]
            for e in range(len(y) - AGAIN + 1):
                if y[e : e + AGAIN] == part and (best is None or d + e < best[0] + best[1]):
                    best = (d, e)
                    break
        if best is None:
            return i, j, same
        i, j = i + best[0], j + best[1]


def passage(item: np.ndarray, doc: np.ndarray, p: int, q: int) -> tuple[int, int, int, int, int]:
    """The passage around the common place ``item[p]``, ``doc[q]``: its ends in the item and in the document, and characters that agree."""
    i, j, same = _extend(item[p:], doc[q : q + 3 * item.size])
    low = max(0, q - 3 * item.size)
    k, m, before = _extend(item[:p][::-1], doc[low:q][::-1])
    return p - k, p + i, q - m, q + j, same + before


def held(patterns: Patterns, texts: list[str], least: float = LEAST) -> Iterator[tuple[int, int, float]]:
    """``(place of the text, item's id, share)`` for every item that a text holds; share is that of the item's characters in the longest passage."""
    cp, begin, count = plain(texts)
    for k in patterns.short:
        item = patterns.cp[patterns.begin[k] : patterns.begin[k] + patterns.count[k]].tobytes()
        for t in range(len(texts)):
            doc = cp[begin[t] : begin[t] + count[t]].tobytes()
            at = doc.find(item)
            while at >= 0 and at % 4:
                at = doc.find(item, at + 1)
            if at >= 0:
                yield t, patterns.ids[k], 1.0
    at, which = patterns.hits(cp)
    if not at.size:
        return
    text, item, place = np.searchsorted(begin, at, "right") - 1, patterns.item[which], patterns.place[which]
    q = at - begin[text]
    pair = text * len(patterns.ids) + item
    order = np.lexsort((place, q - place, pair))
    text, item, place, q, pair = text[order], item[order], place[order], q[order], pair[order]
    key = pair * (1 << 34) + (q - place) + (1 << 33)
    near = np.searchsorted(key, key + SLACK, "right") - np.arange(key.size)
    need = np.maximum(1, (patterns.count[item] * (least * SURVIVE) / PIECE).astype(np.int64))
    good = np.flatnonzero(near >= need)
    last, done, best = -1, [], 0.0
    for g in good.tolist():
        t, k = int(text[g]), int(item[g])
        if pair[g] != last:
            if last >= 0 and best >= least:
                yield last // len(patterns.ids), patterns.ids[last % len(patterns.ids)], best
            last, done, best = int(pair[g]), [], 0.0
            whole = patterns.cp[patterns.begin[k] : patterns.begin[k] + patterns.count[k]]
            doc = cp[begin[t] : begin[t] + count[t]]
        p, at_doc = int(place[g]), int(q[g])
        if best >= 0.999 or any(x <= p < y and u <= at_doc < v for x, y, u, v in done):
            continue
        x, y, u, v, same = passage(whole, doc, p, at_doc)
        done.append((x, y, u, v))
        if same >= SAME * max(y - x, v - u):
            best = max(best, (y - x) / whole.size)
    if last >= 0 and best >= least:
        yield last // len(patterns.ids), patterns.ids[last % len(patterns.ids)], best


def _scan(items: list[tuple[int, str]], least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(items)
        for b in batches:
            rows = [(i, s) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and s]
            at = 0
            while at < len(rows):
                end, held_chars = at, 0
                while end < len(rows) and (end == at or held_chars + len(rows[end][1]) < 2_000_000):
                    held_chars += len(rows[end][1])
                    end += 1
                found = [(rows[at + t][0], i, share) for t, i, share in held(patterns, [s for _, s in rows[at:end]], least)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.float64())], names=["doc_id", "item_id", "share"])
                at = end

    return run


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``(doc_id, item_id, share)``: every document and item of which a passage of at least ``least`` of the item's characters stands in the document."""
    items = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text_col).alias("s")).where("i IS NOT NULL AND s IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-chars // ITEM_CHARS))
    docs = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text_col).alias("t"))
    out = None
    for k in range(groups):
        part = sorted({(r["i"], r["s"]) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == k).toLocalIterator()})
        found = docs.mapInArrow(_scan(part, least), "doc_id bigint, item_id bigint, share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
