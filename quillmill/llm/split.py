"""Splitting oversized items at natural boundaries (problem 3): byte ranges with halos, stitched boundary tables, emission by offset.

A piece that begins at ``s`` ends at the last paragraph, else sentence, else line, else word end between the least and the greatest end, else at the
greatest; the next one begins at a natural boundary within the ``overlap`` characters before that end, else exactly ``overlap`` before it.  So the next
begin is a function of ``s`` and of the few hundred characters behind it alone, which makes the chain of pieces divisible:

1. An item is taken in *ranges*; each worker sees its range and a *halo* on both sides, and finds the boundaries in it.
2. A piece that begins before a range can only hand over at one of the first ``limit`` places in it.  For each of these the worker follows the chain to the
   range's end; chains soon meet, so the *boundary table* of a range is a few rows ``(first, last, exit, pieces)``.
3. The tables of an item, a few bytes for each range, are *stitched* in order: where each range is entered, and by *prefix sums* the number of its first piece.
4. Ranges are read again and pieces emitted by offset.

Items of one range skip steps 2 to 4.  `split_text` works on a text column, ranges in characters.  `split_files` works on files with ranges in bytes that
workers read themselves: no file is ever loaded whole, and only offsets are shuffled.

Defined results
    A null text gives no piece; a text within the limit, also an empty one, gives itself as its only piece.  Pieces carry their offsets, and every character
    of the text stands in a piece.  Repeated rows give repeated pieces.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .unicode_form import code_points

OVERLAP = 90
#: Largest number of characters of a stored field, by field.
LIMITS = {"text": 720, "section": 120}
RANGE = 1 << 16
FILE_RANGE = 1 << 22
#: How far back white space before a boundary is looked at.
LOOK = 64
NONE, WORD, LINE, SENTENCE, PARAGRAPH = range(5)
#: Ends of sentences, closing marks that may follow them, and further ends of clauses.
ENDS, STOPS, CLOSERS, CLAUSES = "。！？；…", ".!?", "”’」』）】》\"')]", "，、：,;:|"


@lru_cache(1)
def _classes() -> tuple[np.ndarray, ...]:
    import unicodedata as ud

    space = np.zeros(0x110000, bool)
    joined = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        ch = chr(cp)
        space[cp] = ch.isspace()
        joined[cp] = ud.category(ch)[0] == "M" or cp == 0x200D
    sets = []
    for s in (ENDS, STOPS, CLOSERS, CLAUSES):
        flags = np.zeros(0x110000, bool)
        flags[[ord(c) for c in s]] = True
        sets.append(flags)
    return space, joined, *sets


def boundaries(cp: np.ndarray) -> np.ndarray:
    """The kind of boundary before each code point; depends on LOOK places before it at most."""
    space, _, ends, stops, closers, clauses = _classes()
    n = cp.size
    kind = np.zeros(n, np.int8)
    if n < 2:
        return kind
    at = np.arange(n)
    blank = space[cp]
    solid = np.maximum.accumulate(np.where(blank, -1, at))
    before = np.r_[-1, solid[:-1]]  # last visible place before each
    gap = at - 1 - before  # white space directly before each place
    lines = np.r_[0, np.cumsum(cp == 0x0A)]
    newlines = lines[at] - lines[np.maximum(before + 1, at - LOOK)]
    known = (before >= 0) & (gap <= LOOK)
    last = np.where(known, cp[np.maximum(before, 0)], 0)
    prior = np.where(known & (before >= 1), cp[np.maximum(before - 1, 0)], 0)
    full = ends[last] | closers[last] & ends[prior]
    stop = stops[last] | closers[last] & stops[prior]
    visible = ~blank
    after = visible & (gap > 0)
    kind[after] = WORD
    kind[visible & (clauses[last]) & (last > 0x7F) & (gap == 0)] = WORD
    kind[after & (newlines == 1)] = LINE
    kind[visible & full & ~(ends | closers)[cp]] = SENTENCE
    kind[after & (full | stop)] = SENTENCE
    kind[after & (newlines > 1)] = PARAGRAPH
    kind[0] = NONE
    return kind


class Window:
    """A part of an item, with halos: code points, and the offset of each and of the end."""

    def __init__(self, cp: np.ndarray, offsets: np.ndarray, last: bool, limit: int, overlap: int = OVERLAP) -> None:
        self.cp, self.offsets, self.last, self.limit, self.overlap = cp, offsets, last, limit, overlap
        self.kind = boundaries(cp)
        self.least = overlap + (limit - overlap) // 2

    def _whole(self, at: int, floor: int) -> int:
        """``at``, moved back from before a mark of the character that stands there."""
        joined = _classes()[1]
        while at > floor and at < self.cp.size and (joined[self.cp[at]] or self.cp[at] == 0x0A and self.cp[at - 1] == 0x0D):
            at -= 1
        return at

    def end(self, s: int) -> int:
        if self.last and self.cp.size - s <= self.limit:
            return self.cp.size
        part = self.kind[s + self.least : s + self.limit + 1]
        best = int(part.max()) if part.size else NONE
        if best == NONE:
            return self._whole(min(s + self.limit, self.cp.size), s + self.least)
        return s + self.least + int(np.flatnonzero(part == best)[-1])

    def after(self, s: int, e: int) -> int:
        """Where the piece behind ``[s, e)`` begins."""
        part = self.kind[e - self.overlap : e - self.overlap // 2]
        found = np.flatnonzero(part)
        return e - self.overlap + int(found[0]) if found.size else self._whole(e - self.overlap, s + 1)

    def chain(self, s: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """``(begin, end, next begin)`` of the pieces that begin from ``s`` on and before ``stop``; next is -1 behind the last."""
        while s < stop:
            e = self.end(s)
            following = -1 if self.last and e == self.cp.size else self.after(s, e)
            yield s, e, following
            if following < 0:
                return
            s = following

    def table(self, first: int, entries: int, stop: int) -> list[tuple[int, int, int, int]]:
        """``(first entry, last entry, exit, pieces)`` by offsets, for entries at ``first`` and the ``entries`` - 1 places behind it; exit -1: the item ends."""
        known: dict[int, tuple[int, int]] = {}
        out: list[tuple[int, int, int, int]] = []
        for s in range(first, min(first + entries, stop)):
            path = []
            at, tail = s, None
            while tail is None:
                if at < 0 or at >= stop:
                    tail = (-1 if at < 0 else int(self.offsets[at]), 0)
                elif at in known:
                    tail = known[at]
                else:
                    path.append(at)
                    at = next(self.chain(at, stop))[2]
            for k, p in enumerate(reversed(path), 1):
                known[p] = (tail[0], tail[1] + k)
            here = int(self.offsets[s])
            x, count = known[s]
            if out and out[-1][2:] == (x, count):
                out[-1] = (out[-1][0], here, x, count)
            else:
                out.append((here, here, x, count))
        return out


def stitched(tables: list[tuple[int, list[tuple[int, int, int, int]]]], ends: dict[int, int]) -> list[tuple[int, int, int]]:
    """``(range, entry, number of its first piece)`` from the tables ``(range, rows)`` of one item, ranges in order; ``ends`` has each range's end."""
    out, entry, number = [], 0, 1
    for k, rows in sorted(tables):
        if entry < 0 or entry >= ends[k]:
            continue
        for first, last, leave, count in rows:
            if first <= entry <= last:
                out.append((k, entry, number))
                entry, number = leave, number + count
                break
    return out


PIECES = "piece_no bigint, begin bigint, end bigint, piece string"


def _emit(keys: int, ranged: bool, overlap: int):  # noqa: ANN202
    """Key columns, then text and limit; with ``ranged`` also base, stop, last, entry and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            rows, out = [], []
            for r, x in enumerate(zip(*columns[keys:], strict=True)):
                s, limit = x[0], x[1]
                if not ranged and len(s) <= limit:
                    rows.append(r)
                    out.append((1, 0, len(s), s))
                    continue
                base, stop, last, entry, number = x[2:] if ranged else (0, len(s), True, 0, 1)
                cp, size = code_points([s])
                window = Window(cp, base + np.arange(size[0] + 1), last, limit, overlap)
                for k, (at, end, _) in enumerate(window.chain(entry - base, stop - base)):
                    rows.append(r)
                    out.append((number + k, base + at, base + end, s[at:end]))
            part = b.select(range(keys)).take(pa.array(rows, pa.int64()))
            values = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *values], names=[*part.schema.names, "piece_no", "begin", "end", "piece"])

    return run


def _range_rows(keys: int, size: int):  # noqa: ANN202
    """Ranges of long texts, each with its halos: LOOK and the overlap before, two limits behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, limits = b.column(keys).to_pylist(), b.column(keys + 1).to_pylist()
            for r, (s, limit) in enumerate(zip(texts, limits, strict=True)):
                for k in range(-(-len(s) // size)):
                    base, end = max(0, k * size - LOOK - limit), min(len(s), (k + 1) * size + 2 * limit)
                    values = [[k], [s[base:end]], [limit], [base], [min(len(s), (k + 1) * size)], [end == len(s)]]
                    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([*b.select(range(keys)).slice(r, 1).columns, *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[*b.schema.names[:keys], "range_no", "text", "lim", "base", "stop", "last"])

    return run


def _tables(keys: int, size: int, overlap: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            found = []
            for k, s, limit, base, stop, last in zip(*columns[keys:], strict=True):
                cp, n = code_points([s])
                window = Window(cp, base + np.arange(n[0] + 1), last, limit, overlap)
                found.append([{"first": x, "last": y, "leave": z, "pieces": c} for x, y, z, c in window.table(k * size - base, 1 if k == 0 else limit, stop - base)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("leave", pa.int64()), ("pieces", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.select(range(keys)).columns, b.column(keys), b.column(keys + 4), pa.array(found, kind)], names=[*b.schema.names[:keys], "range_no", "stop", "rows"])

    return run


def _stitch(items: pd.Series) -> pd.Series:
    def one(ranges) -> list[dict]:  # noqa: ANN001
        tables = [(int(x["range_no"]), [(int(y["first"]), int(y["last"]), int(y["leave"]), int(y["pieces"])) for y in x["rows"]]) for x in ranges]
        ends = {int(x["range_no"]): int(x["stop"]) for x in ranges}
        return [{"range_no": k, "entry": e, "number": n} for k, e, n in stitched(tables, ends)]

    return items.map(one)


def _stitched(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Entry and first number of each range that is entered."""
    together = tables.groupBy(*keys).agg(F.collect_set(F.struct("range_no", "stop", "rows")).alias("ranges"))
    return together.select(*keys, F.explode(F.pandas_udf(_stitch, "array<struct<range_no: bigint, entry: bigint, number: bigint>>")("ranges")).alias("x")).select(*keys, "x.range_no", "x.entry", "x.number")


def split_text(df: DataFrame, id_col: str, limits: dict[str, int] | None = None, overlap: int = OVERLAP, size: int = RANGE, over_only: bool = True) -> DataFrame:
    """``(id, field, piece_no, begin, end, piece)`` of the fields of ``limits``; with ``over_only``, of those above their limit only."""
    limits = LIMITS if limits is None else limits
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.lit(n).alias("lim")) for f, n in limits.items())))
    rows = df.select(F.col(id_col).alias("id"), each.alias("x")).select("id", "x.field", "x.text", "x.lim").where("text IS NOT NULL")
    if over_only:
        rows = rows.where(F.length("text") > F.col("lim"))
    kind = df.schema[id_col].dataType.simpleString()
    near = rows.where(F.length("text") <= size).mapInArrow(_emit(2, False, overlap), f"id {kind}, field string, {PIECES}")
    keys = ["id", "field", "hash"]
    far = rows.where(F.length("text") > size).select("id", "field", F.xxhash64("text").alias("hash"), "text", "lim")
    ranges = far.mapInArrow(_range_rows(3, size), f"id {kind}, field string, hash bigint, range_no bigint, text string, lim int, base bigint, stop bigint, last boolean")
    tables = ranges.mapInArrow(_tables(3, size, overlap), f"id {kind}, field string, hash bigint, range_no bigint, stop bigint, rows array<struct<first: bigint, last: bigint, leave: bigint, pieces: bigint>>")
    entered = ranges.join(_stitched(tables, keys), [*keys, "range_no"]).select("id", "field", "text", "lim", "base", "stop", "last", "entry", "number")
    return near.unionByName(entered.mapInArrow(_emit(2, True, overlap), f"id {kind}, field string, {PIECES}"))


def _read(path: str, begin: int, end: int) -> bytes:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    with system.open_input_file(at) as f:
        return f.read_at(end - begin, begin)


def _file_window(path: str, size: int, k: int, length: int, limit: int, overlap: int) -> tuple[Window, str]:
    """The window of a byte range: UTF-8, invalid bytes dropped.  Halos are wide enough for four bytes a character."""
    begin, end = max(0, k * size - 4 * (LOOK + limit)), min(length, (k + 1) * size + 8 * limit)
    raw = _read(path, begin, end)
    lead = 0
    while begin and lead < 3 and lead < len(raw) and raw[lead] & 0xC0 == 0x80:
        lead += 1
    text = raw[lead:].decode("utf-8", "ignore")
    cp, n = code_points([text])
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    if int(width.sum()) != len(raw) - lead:  # invalid bytes were dropped: place what was kept
        width = np.zeros(cp.size, np.int64)
        at = 0
        kept = raw[lead:]
        for i, ch in enumerate(text):
            code = ch.encode()
            found = kept.index(code, at)
            width[i] = found + len(code) - at
            at = found + len(code)
    return Window(cp, begin + lead + np.r_[0, np.cumsum(width)], end == length, limit, overlap), text


def _file_tables(size: int, limit: int, overlap: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, length, k in zip(b["path"], b["length"], b["range_no"], strict=True):
                w, _ = _file_window(path, size, k, length, limit, overlap)
                first, stop = np.searchsorted(w.offsets, [k * size, min(length, (k + 1) * size)])
                rows = [{"first": x, "last": y, "leave": z, "pieces": c} for x, y, z, c in w.table(int(first), 1 if k == 0 else limit, int(stop))]
                yield pd.DataFrame({"path": [path], "range_no": [k], "stop": [min(length, (k + 1) * size)], "rows": [rows]})

    return run


def _file_emit(size: int, limit: int, overlap: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, length, k, entry, number in zip(b["path"], b["length"], b["range_no"], b["entry"], b["number"], strict=True):
                w, text = _file_window(path, size, k, length, limit, overlap)
                at, stop = np.searchsorted(w.offsets, [entry, min(length, (k + 1) * size)])
                out = [(path, number + i, int(w.offsets[s]), int(w.offsets[e]), text[s:e]) for i, (s, e, _) in enumerate(w.chain(int(at), int(stop)))]
                yield pd.DataFrame(out, columns=["path", "piece_no", "begin", "end", "piece"])

    return run


def split_files(spark: SparkSession, files: DataFrame, limit: int = LIMITS["text"], overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """``(path, piece_no, begin, end, piece)`` of the UTF-8 files ``(path, length)``, offsets in bytes; paths must be readable by every executor.

    ``spark.read.format("binaryFile").select("path", "length")`` lists files without reading them.  An empty file gives no piece.
    """
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size) - 1)).alias("range_no"))
    ranges = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "range_no")
    tables = ranges.mapInPandas(_file_tables(size, limit, overlap), "path string, range_no bigint, stop bigint, rows array<struct<first: bigint, last: bigint, leave: bigint, pieces: bigint>>")
    entered = ranges.join(_stitched(tables, ["path"]), ["path", "range_no"])
    return entered.mapInPandas(_file_emit(size, limit, overlap), "path string, piece_no bigint, begin bigint, end bigint, piece string")
