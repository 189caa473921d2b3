"""One consistent form for text that looks the same (problem 5).

Method: the strings of an Arrow batch are exploded to one table of positioned code points ``(row, position, code point)``, held as numpy columns;
mapping tables of fixed size (compatibility decompositions, look-alike letters, invisible characters) are looked up for every code point, marks are
ordered by combining class within their base, base and marks are recomposed, and the strings are rebuilt by row.  The tables come from the Unicode
database that Python ships, by the rules below; only look-alike letters, for which there is no rule, are listed.

Defined results
    null stays null, an empty string stays empty.  Letter case, visible punctuation and the number of visible spaces are kept, so CJK-width punctuation
    (``，``) stays different from ``,``.  Joiners stay where they change what is drawn (between emoji, in Arabic and Indic scripts), and so do variation
    selectors behind a pictograph.  Texts of any length are worked on in windows of bounded size.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut

#: Letters of other scripts that are drawn like Latin ones, and the Latin letters they are read as.
LOOK_ALIKE = {
    "АВЕЗКМНОРСТХУЅІЈԌԚԜӀҮ": "ABE3KMHOPCTXYSIJGQWIY",
    "аесорхуѕіјԁԛԝһӏү": "aecopxysijdqwhly",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ονϲϳ": "ovcj",
    "ɑɡıɩ": "agii",
}
#: Characters that draw a hyphen.
HYPHENS = "‐‑﹣－"
#: Characters of no width beyond category Cf.
NO_WIDTH = "͏ᅟᅠ឴឵ㅤﾠ"

KEEP, DROP, ONE, MANY, JOINER, SELECTOR = range(6)
WINDOW = 1 << 19
LIMIT = 0x110000


def _compat_target(ch: str) -> str | None:
    """What a compatibility character is drawn as, or None where it is drawn differently."""
    tag, _, rest = ud.decomposition(ch).partition("> ")
    if not rest:
        return None
    cp, target = ord(ch), ud.normalize("NFKC", ch)
    if tag in ("<wide", "<narrow"):
        return None if ud.category(ch)[0] == "P" and ch not in HYPHENS else target
    if tag == "<noBreak":
        return target
    if tag == "<compat":
        letters = 0xFB00 <= cp <= 0xFB17 or 0x2E80 <= cp <= 0x2FD5 or 0x2160 <= cp <= 0x217F or 0x0132 <= cp <= 0x01F3
        if letters or target == " " or ch in "℃℉…":
            return target
    return None


def _drawn_as(ch: str) -> str:
    """What one character is read as, canonically decomposed: compatibility and look-alike mappings are applied to the bases until nothing changes."""
    letters = {x: y for a, b in LOOK_ALIKE.items() for x, y in zip(a, b, strict=True)}
    out = ud.normalize("NFD", ch)
    for _ in range(4):
        new = "".join(ud.normalize("NFD", "-" if c in HYPHENS else letters.get(c) or _compat_target(c) or c) for c in out)
        if new == out:
            break
        out = new
    return out


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Lookup columns by code point, and the sorted pairs of canonical composition."""
    kind, one, ccc = np.zeros(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.uint32), np.zeros(LIMIT, np.uint8)
    trigger, pictograph, joining, whole = (np.zeros(LIMIT, bool) for _ in range(4))
    many: dict[int, str] = {}
    pairs: dict[tuple[int, int], int] = {}
    ranges = [range(0x80, 0x3400), range(0xA640, 0xAC00), range(0xF900, 0x10000), range(0x10A00, 0x11A00), range(0x16AF0, 0x16B40), range(0x1D160, 0x1D250), range(0x1E000, 0x1E950), range(0x1F000, 0x1FB00), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200)]
    for cp in (c for r in ranges for c in r):  # of the rest, Hangul syllables are composed by rule and no other has a mapping
        ch = chr(cp)
        ccc[cp], cat, parts, target = ud.combining(ch), ud.category(ch), ud.decomposition(ch).split(), None
        pictograph[cp] = cat in ("So", "Sk") and cp > 0x2000
        if parts or ch in HYPHENS or any(ch in a for a in LOOK_ALIKE):
            canonical = ud.normalize("NFC", ch)
            drawn = _drawn_as(ch)
            target = ud.normalize("NFC", drawn) if drawn != ud.normalize("NFD", ch) else canonical
            if target != canonical and any(ud.combining(c) for c in drawn):
                target = drawn  # composed below with the marks that follow it
            if canonical == ch and parts and parts[0][0] != "<":
                whole[cp], many[cp] = True, ud.normalize("NFD", ch)
                if len(parts) == 2:
                    pairs[int(parts[0], 16), int(parts[1], 16)] = cp
        if cat == "Cf" and not 0xFFF9 <= cp <= 0xFFFB and not 0x0600 <= cp <= 0x08FF or ch in NO_WIDTH:
            kind[cp] = JOINER if cp in (0x200C, 0x200D) else DROP
        elif 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp:
            kind[cp] = SELECTOR
        elif target is not None and target != ch:
            if len(target) == 1:
                kind[cp], one[cp] = ONE, ord(target)
            else:
                kind[cp], many[cp] = MANY, ud.normalize("NFD", target)
        trigger[cp] = kind[cp] != KEEP or ccc[cp] > 0 or cat == "Mn" or 0x1100 <= cp < 0x1200
    kind[ord("\r")], one[ord("\r")], trigger[ord("\r")] = ONE, ord("\n"), True
    for first, last in ((0x0600, 0x08FF), (0x0900, 0x0DFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF)):
        joining[first : last + 1] = True
    pictograph[0x1F3FB:0x1F400] = True
    trigger[[b for _, b in pairs]] = True
    keys = np.array(sorted(many), np.uint32)
    sizes = np.array([len(many[k]) for k in sorted(many)], np.int64)
    flat = np.array([ord(c) for k in sorted(many) for c in many[k]], np.uint32)
    pair = np.array(sorted((a << 21 | b, c) for (a, b), c in pairs.items()), np.int64)
    return {"kind": kind, "one": one, "ccc": ccc, "trigger": trigger, "pictograph": pictograph, "joining": joining, "whole": whole, "many": keys, "sizes": sizes, "flat": flat, "starts": np.cumsum(sizes) - sizes, "pair": pair[:, 0], "made": pair[:, 1].astype(np.uint32)}


def _neighbour(flags: np.ndarray, cp: np.ndarray, row: np.ndarray, at: np.ndarray, step: int, skip: np.ndarray) -> np.ndarray:
    """Whether the next code point in a direction, past those of ``skip``, has the flag and is in the same row."""
    to = at + step
    for _ in range(2):
        inside = (to >= 0) & (to < cp.size)
        hop = inside & skip[cp[np.clip(to, 0, cp.size - 1)]]
        to = np.where(hop, to + step, to)
    inside = (to >= 0) & (to < cp.size)
    to = np.clip(to, 0, cp.size - 1)
    return inside & (row[to] == row[at]) & flags[cp[to]]


def _map(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kind = t["kind"][cp]
    keep = kind != DROP
    if (at := np.flatnonzero(kind == JOINER)).size:
        selectors = t["kind"] == SELECTOR
        drawn = _neighbour(t["pictograph"], cp, row, at, -1, selectors) & _neighbour(t["pictograph"], cp, row, at, 1, selectors)
        keep[at] = drawn | _neighbour(t["joining"], cp, row, at, -1, np.zeros(LIMIT, bool))
    if (at := np.flatnonzero(kind == SELECTOR)).size:
        keep[at] = _neighbour(t["pictograph"], cp, row, at, -1, np.zeros(LIMIT, bool))
    if (at := np.flatnonzero(cp == 0x0D)).size:  # "\r\n" is one line end
        keep[at[(at + 1 < cp.size) & (cp[np.minimum(at + 1, cp.size - 1)] == 0x0A)]] = False
    cp, row, kind = t["one"][cp][keep], row[keep], kind[keep]
    marked = np.r_[(t["ccc"][cp[1:]] > 0) & (row[1:] == row[:-1]), False] if cp.size else np.zeros(0, bool)
    open_up = (kind == MANY) | t["whole"][cp] & marked  # a composite before a mark is opened, so that all marks of its base are ordered together
    if open_up.any():
        which = np.searchsorted(t["many"], cp)
        which[which == t["many"].size] = 0
        size = np.where(open_up, t["sizes"][which], 1)
        begin = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(begin, size)
        spread = np.repeat(open_up, size)
        source = np.where(spread, np.repeat(t["starts"][which], size) + inner, 0)
        cp, row = np.where(spread, t["flat"][source], np.repeat(cp, size)), np.repeat(row, size)
    return cp.astype(np.uint32), row


def _compose(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Orders marks by class within their base and composes what has a composite."""
    if not cp.size:
        return cp, row
    ccc = t["ccc"][cp]
    same = np.r_[False, row[1:] == row[:-1]]
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & same[1:]).any():
        base = np.cumsum((ccc == 0) | ~same)
        order = np.lexsort((ccc, base))
        cp, ccc = cp[order], ccc[order]
    while True:
        starter = (ccc == 0)
        last = np.maximum.accumulate(np.where(starter, np.arange(cp.size), -1))
        before = np.r_[-1, last[:-1]]
        same = np.r_[False, row[1:] == row[:-1]]
        prior = np.r_[np.uint8(0), ccc[:-1]]
        at = np.flatnonzero(same & (before >= 0) & ((t["trigger"][cp] | (cp >= 0x1161) & (cp < 0x1200))))
        j = before[at]
        at, j = at[row[j] == row[at]], j[row[j] == row[at]]
        free = (j == at - 1) | (prior[at] < ccc[at]) & (prior[at] > 0)
        at, j = at[free], j[free]
        if not at.size:
            return cp, row
        key = cp[j].astype(np.int64) << 21 | cp[at]
        where = np.minimum(np.searchsorted(t["pair"], key), t["pair"].size - 1)
        made = np.where(t["pair"][where] == key, t["made"][where], 0).astype(np.int64)
        a, b = cp[j].astype(np.int64), cp[at].astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        made = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(lvt, a + b - 0x11A7, made))
        at, j, made = at[made > 0], j[made > 0], made[made > 0]
        j, first = np.unique(j, return_index=True)
        at, made = at[first], made[first]
        free = ~np.isin(j, at)  # its base isn't itself taken into another in this pass
        at, j, made = at[free], j[free], made[free]
        if not at.size:
            return cp, row
        cp[j] = made
        left = np.ones(cp.size, bool)
        left[at] = False
        cp, row, ccc = cp[left], row[left], t["ccc"][cp[left]]


def _apart(x: str, y: str) -> bool:
    """Whether nothing in the form of ``y`` depends on ``x``: both are plain, and ``y`` is neither a mark nor composes with what stands before it."""
    t = tables()
    return not t["trigger"][ord(x)] and not t["trigger"][ord(y)] and not 0xAC00 <= ord(x) < 0xD7A4 and not t["joining"][ord(x)] and not t["pictograph"][ord(x)] and not t["pictograph"][ord(y)] and y != "\n"


def _windows(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows in turns of about WINDOW characters; a longer row comes in parts cut between two plain characters."""
    ids: list[int] = []
    parts: list[str] = []
    size = 0
    for i, s in enumerate(texts):
        at = 0
        while len(s) - at > WINDOW:
            end = at + WINDOW
            while end > at + 1 and not _apart(s[end - 1], s[end]):
                end -= 1
            if end == at + 1:  # nowhere in the whole window: look ahead
                end = at + WINDOW
                while end < len(s) and not _apart(s[end - 1], s[end]):
                    end += 1
            yield [i], [s[at:end]]
            at = end
        if size + len(s) - at > WINDOW and ids:
            yield ids, parts
            ids, parts, size = [], [], 0
        ids.append(i)
        parts.append(s[at:] if at else s)
        size += len(s) - at
    if ids:
        yield ids, parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all parts, one behind the other, and the length of each part."""
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))


def consistent(texts: list[str]) -> list[str]:
    """The consistent form of each text; texts without a character to change come back as they are."""
    t, out = tables(), [""] * len(texts)
    for ids, parts in _windows(texts):
        cp, size = code_points(parts)
        row = np.repeat(np.arange(len(parts)), size)
        hit = t["trigger"][cp]
        touched = np.zeros(len(parts), bool)
        touched[row[hit]] = True
        if touched.any():
            take = touched[row]
            new, at = _compose(*_map(cp[take], row[take], t), t)
            count = np.bincount(at, minlength=len(parts))
            text, end = new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.cumsum(count)
        for k, (i, s) in enumerate(zip(ids, parts, strict=True)):
            done = text[end[k] - count[k] : end[k]] if touched[k] else s
            out[i] = out[i] + done if out[i] else done
    return out


@F.pandas_udf(T.StringType())
def _consistent_udf(s: pd.Series) -> pd.Series:
    there = s.notna()
    out = pd.Series([None] * len(s), dtype=object, index=s.index)
    out[there] = consistent(s[there].tolist())
    return out


def consistent_form(text: Column) -> Column:
    """Column of the consistent form; null for null."""
    return _consistent_udf(text)


def _hash(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def _forms(fields: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for k, field in enumerate(fields, 1):
                rows = [(i, s) for i, s in zip(ids, b.column(k).to_pylist(), strict=True) if i is not None and s is not None and s.strip()]
                forms = consistent([s for _, s in rows])
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([field] * len(rows), pa.string()), pa.array([_hash(f) for f in forms], pa.binary()), pa.array([_hash(s) for _, s in rows], pa.binary())], names=["id", "field", "form", "stored"])

    return run


def form_keys(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """Of each non-blank field of each row: 128-bit hashes of its consistent form and of the string as stored."""
    return df.select(id_col, *fields).mapInArrow(_forms(fields), "id bigint, field string, form binary, stored binary")


#: Salts of the join that finds the rows of forms with several spellings.
SALTS = 16
#: Rows of a group that one task pairs with the rest of the group at a time.
BLOCK = 4096


def look_alike_rows(df: DataFrame, id_col: str = "ord", per_row: tuple[str, ...] = ("text",), per_value: tuple[str, ...] = ("title",)) -> DataFrame:
    """``(id, field, form, stored, n)``: the members of every class of strings that look the same but are stored in more than one way.

    ``form`` is the class, ``stored`` the spelling within it, ``n`` the number of rows of the class.  Keys are hashes, computed once and cut to the shared
    folder.  Copies are counted together before any key is joined, and the join to the classes is salted, so that a form with a third of all rows is spread
    over SALTS tasks.
    """
    keys = cut(form_keys(df, id_col, per_row + per_value))
    spelt = keys.groupBy("field", "form", "stored").agg(F.count("*").alias("n"))
    mixed = spelt.groupBy("field", "form").agg(F.count("*").alias("spellings"), F.sum("n").alias("n")).where("spellings > 1")
    mixed = mixed.select("field", "form", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(mixed, ["field", "form", "salt"])
    each = F.when(F.col("field").isin(list(per_row)), F.col("id"))
    return rows.groupBy("field", "form", "stored", "n", each.alias("row")).agg(F.min("id").alias("id")).select("id", "field", "form", "stored", "n")


def look_alike_pairs(df: DataFrame, id_col: str = "ord", per_row: tuple[str, ...] = ("text",), per_value: tuple[str, ...] = ("title",)) -> DataFrame:
    """Pairs ``(ord_a, ord_b, field)`` of rows whose fields look the same but are stored differently.

    Fields of ``per_row`` give a pair for each two such rows.  Those of ``per_value`` stand once for each stored string, by its smallest id.  Null and
    blank strings give nothing.  Only hashes are shuffled; forms of one spelling leave before the join, so copies of one string, however many, meet nothing.
    A large class is paired in blocks: its rows as first partner fall into one block for each BLOCK of them, and the class stands once in each block.
    """
    rows = cut(look_alike_rows(df, id_col, per_row, per_value))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    a = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).alias("a")
    b = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("b")
    on = (F.col("a.field") == F.col("b.field")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.stored") != F.col("b.stored")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, on).select(F.col("a.id").alias("ord_a"), F.col("b.id").alias("ord_b"), F.col("a.field").alias("field"))
