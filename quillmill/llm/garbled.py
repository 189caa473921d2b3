"""Garbled text from wrong character encoding (problem 2): round-trip repair.

A text that was decoded with the wrong encoding is brought back by a *round trip*: it is encoded again under a candidate legacy encoding, and the bytes are
strictly decoded as the intended one.  Of all candidates the one is taken that lowers a *garbling cost* most, and the trip is repeated for nested layers,
until no trip lowers the cost.  Trips are made for each stretch of a text that the legacy encoding can hold, so a text that is garbled in part is repaired
there alone.

The garbling cost adds up what characters cost by rules that hold for any corpus: characters of everyday writing are cheap (ASCII, letters and marks of
western European languages, the first level of the Chinese national standard), others dear, and replacement, private-use and control characters dearest;
so is a Chinese character inside a word of Latin letters.  A mistaken reading also turns one character into two or three, which alone raises the cost.

Where bytes were lost, the text can't be restored in whole; such rows are told by what is left of the damage.  Garbled characters that a text quotes as an
example, between quotation marks, are no damage.

Defined results
    Null, blank and pure ASCII texts are not garbled and come back as they are.  Of an upload, a payload that is null or isn't base64 has no text.  Repeated
    rows give repeated results.  Texts of any length are examined whole, in windows of bounded size.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unicode_form import code_points, consistent

#: Legacy encodings that texts are mistaken for, and encodings that texts were in.
WIDE = ("gb18030", "big5hkscs", "cp949", "cp932")
#: Of these, what western text may be mistaken for beside them.
BESIDE = ("cp1250", "cp1251", "mac-roman", "cp437", "cp850")
MISTAKEN = ("cp1252", "latin-1", "cp1250", "cp1251", "gb18030", "big5hkscs", "cp949", "cp932", "mac-roman", "cp437", "cp850", "cp1254", "iso8859-15", "koi8-r")
INTENDED = ("utf-8", "gb18030", "cp1252", "big5hkscs")
#: Letters and marks of everyday writing beyond ASCII and Chinese.
EVERYDAY = "àâäáãåæçéèêëíìîïñóòôöõøœúùûüÿßÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜŸ’‘“”„«»–—…·•°€£§µ×÷±½¼¾²³©®™≤≥≠≈→←↑↓√∞∑∫、。，；：？！（）《》〈〉【】「」『』〔〕￥％～—　│─"
#: What is left of lost characters.
LOST = ("锟斤拷", "锟斤", "斤拷", "ï¿½", "烫烫烫", "屯屯屯", "�")
LAYERS = 4
#: A single Chinese character is in a text of Latin letters if there are at most FEW within so many places.
AROUND, FEW = 24, 5
#: Share of the cost that is left that a further trip must take away.
FURTHER = 0.3
#: Share of the cost that a trip must take away to be taken without a look at the others.
SURE = 0.8
WINDOW = 1 << 16
LEAST_DROP = 0.5

CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x80-\x9f\ue000-\uf8ff]")
#: Garbled letters whose second half isn't seen, so that the consistent form drops it.
UNSEEN = re.compile("[ÃÂ][\xa0\xad]")
QUOTED = re.compile(r"(?:“([^“”\n]{1,24}?)”|‘([^‘’\n]{1,24}?)’|「([^「」\n]{1,24}?)」|『([^『』\n]{1,24}?)』|\"([^\"\n]{1,24}?)\"|`([^`\n]{1,24}?)`|（([^（）\n]{1,12}?)）)")
UTF8_RUN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\x00-\x09\x0b-\x7f])*")


@lru_cache(1)
def costs() -> np.ndarray:
    """The cost of every code point."""
    out = np.full(0x110000, 4.0, np.float32)
    out[:0x80] = 0
    out[:0x20] = 6
    out[[9, 10, 13]] = 0
    out[0x7F:0xA0] = 8
    out[0xA0:0x100] = 1.2
    out[0x250:0x300] = 3
    out[0x2000:0x2C00] = 1.2
    out[0x3000:0x3040] = 1.5
    out[0x3040:0x3100] = 3
    out[0xFF00:0xFFF0] = 1.5
    out[0x1F000:0x1FB00] = 1.5
    out[0x300:0x370] = 1
    out[[0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD, 0x202F, 0x2009]] = 0.3
    out[0x3400:0xA000] = 3
    for lead in range(0xB0, 0xF8):
        for trail in range(0xA1, 0xFF):
            try:
                out[ord(bytes((lead, trail)).decode("gb2312"))] = 0.3 if lead < 0xD8 else 1.5
            except UnicodeDecodeError:
                continue
    out[[ord(c) for c in EVERYDAY]] = 0.3
    out[0xFE00:0xFE10] = 0.3
    out[0xE000:0xF900] = 8
    out[0xFFFD] = 8
    return out


@lru_cache(1)
def _groups() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points that are Chinese characters, that are Latin letters, and that are written in Chinese text."""
    han, latin, wide = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    han[0x3400:0xA000] = True
    wide[0x2E80:0xA000] = wide[0xF900:0xFB00] = wide[0xFF00:0xFFF0] = True
    wide[[ord(c) for c in "“”‘’…—"]] = True
    for cp in range(0x250):
        latin[cp] = chr(cp).isalpha()
    return han, latin, wide


@lru_cache(1)
def _case() -> tuple[np.ndarray, np.ndarray]:
    lower, upper = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for cp in range(0x530):
        lower[cp], upper[cp] = chr(cp).islower(), chr(cp).isupper()
    return lower, upper


def _alone(cp: np.ndarray) -> np.ndarray:
    """Single Chinese characters that touch a Latin word and no other wide character."""
    han, latin, wide = _groups()
    out = han[cp]
    if not out.any():
        return out
    a, w = latin[cp], wide[cp]
    beside = np.zeros(cp.size, bool)
    beside[1:] = a[:-1]
    beside[:-1] |= a[1:]
    out &= beside
    out[1:] &= ~w[:-1]
    out[:-1] &= ~w[1:]
    if out.any():  # in a text of Latin letters
        at = np.flatnonzero(out)
        total = np.r_[0, np.cumsum(han[cp])]
        out[at] = total[np.minimum(at + AROUND, cp.size)] - total[np.maximum(at - AROUND, 0)] <= FEW
    return out


def cost(text: str) -> float:
    """The garbling cost of a text."""
    cp, _ = code_points([text])
    if not cp.size:
        return 0.0
    total = float(costs()[cp].sum()) + 2.5 * float(np.count_nonzero(_alone(cp)))
    strange = (cp >= 0x80) & (cp < 0x250)
    if strange.any():  # western texts have no long runs of such letters, and no capitals behind small ones
        lower, upper = _case()
        total += float((strange[1:] & strange[:-1]).sum()) + float((lower[cp[:-1]] & strange[1:] & upper[cp[1:]]).sum())
    return total


@lru_cache(32)
def _table(encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane, its bytes in the encoding as a number, and how many they are; 0 where it has none."""
    value, size = np.zeros(0x10000, np.uint32), np.zeros(0x10000, np.uint8)
    codes = [bytes((k,)) for k in range(256)]
    if encoding in WIDE:
        codes = [bytes((a, b)) for a in range(0x81, 0xFF) for b in range(0x40, 0xFF)] + codes
    for raw in codes:
        try:
            ch = raw.decode(encoding)
        except UnicodeDecodeError:
            if not (encoding in ("cp1252", "cp1250", "cp1251", "cp1254") and 0x80 <= raw[0] <= 0x9F):
                continue
            ch = chr(raw[0])  # bytes without a character stay what they are
        if len(ch) == 1 and ord(ch) < 0x10000:
            value[ord(ch)], size[ord(ch)] = int.from_bytes(raw, "big"), len(raw)
    size[10] = 0
    return value, size


def _encoded(cp: np.ndarray, encoding: str) -> tuple[bytes, np.ndarray]:
    """A text in the encoding, line ends and characters that it can't hold as b"\\n", and where the bytes of each character begin."""
    value, size = _table(encoding)
    basic = np.where(cp < 0x10000, cp, 10)
    n, v = size[basic].astype(np.int64), value[basic]
    v = np.where(n == 0, 10, v)
    n = np.maximum(n, 1)
    starts = np.r_[0, np.cumsum(n)]
    raw = np.empty(int(starts[-1]), np.uint8)
    raw[starts[1:] - 1] = v & 0xFF
    two = n == 2
    raw[starts[:-1][two]] = v[two] >> 8
    return raw.tobytes(), starts


def _decoded(raw: bytes, intended: str) -> str | None:
    try:
        return raw.decode(intended)
    except UnicodeDecodeError:
        return None


STRETCH, BEYOND = re.compile(rb"[^\n]+"), re.compile(r"[^\x00-\x7f]+")


class _Trip:
    """A text after one round trip of those stretches for which it lowers the cost, and by how much that is."""

    def __init__(self, text: str, before: np.ndarray) -> None:
        self.text, self.before, self.parts, self.at, self.gain = text, before, [], 0, 0.0

    def offer(self, a: int, b: int, raw: bytes, intended: str) -> bool:
        if a < self.at or b <= a:
            return False
        base = self.before[b] - self.before[a]  # what neighbours add to it is less than half as much
        if intended != "utf-8" and base < 1.3:
            return False
        try:
            new = raw.decode(intended)
        except UnicodeDecodeError:
            return False
        code = np.frombuffer(new.encode("utf-32-le", "surrogatepass"), np.uint32)
        now = float(costs()[code].sum())
        if now > (1.5 if intended == "utf-8" else 0.45) * base:
            return False
        before = base
        if ((code >= 0x80) & (code < 0x250)).any():
            before, now = cost(self.text[a:b]), cost(new)
        # a stretch that isn't in Unicode's own form proves less: more of it must get better
        if before - now < LEAST_DROP or (intended != "utf-8" and (before - now < 2 or now > 0.3 * before)):
            return False
        self.parts.extend((self.text[self.at : a], new))
        self.at, self.gain = b, self.gain + before - now
        return True

    def result(self) -> str:
        return "".join((*self.parts, self.text[self.at :]))


def _from_unicode(trip: _Trip, raw: bytes, starts: np.ndarray) -> _Trip:
    for m in UTF8_RUN.finditer(raw):
        a = int(np.searchsorted(starts, m.start()))
        b = int(np.searchsorted(starts, m.end(), "right")) - 1
        if b > a:
            trip.offer(a, b, raw[starts[a] : starts[b]], "utf-8")
    return trip


def _from_legacy(trip: _Trip, raw: bytes, starts: np.ndarray, dear: np.ndarray, intended: str) -> _Trip:
    text = trip.text

    def first_of(tries: tuple[tuple[int, int], ...], least: int, most: int) -> bool:
        return any(least <= x < y <= most and trip.offer(x, y, raw[starts[x] : starts[y]], intended) for x, y in tries)

    for m in STRETCH.finditer(raw):
        a, b = (int(k) for k in np.searchsorted(starts, (m.start(), m.end())))
        if dear[b] == dear[a]:
            continue
        beyond = [(a + x.start(), a + x.end()) for x in BEYOND.finditer(text[a:b])]
        if not beyond:
            continue
        x, y = beyond[0][0], beyond[-1][1]
        if not first_of(((a, b), (x, y), (x, y + 1), (x + 1, y), (x, y - 1)), a, b):
            for x, y in beyond:
                if dear[y] > dear[x]:
                    first_of(((x, y), (x, y + 1), (x + 1, y), (x, y - 1)), a, b)
    return trip


@lru_cache(1)
def _legacy() -> tuple[tuple[str, str], ...]:
    """Pairs of legacy encodings, likelier ones first."""
    first = (("cp1252", "gb18030"), ("big5hkscs", "gb18030"), ("gb18030", "cp1252"), ("cp949", "gb18030"), ("gb18030", "big5hkscs"))
    rest = ((w, r) for r in INTENDED[1:] for w in MISTAKEN if w != r and (r == "gb18030" or w in WIDE or w in BESIDE))
    return tuple(dict.fromkeys((*first, *rest)))


def repair(text: str) -> tuple[str, list[str]]:
    """The text with its garbled stretches restored, and the trips taken, as ``mistaken>intended``."""
    path: list[str] = []
    first = 0.0
    for _ in range(LAYERS):
        cp, _ = code_points([text])
        marks = _marks(cp)
        if not marks.any():
            break
        dear = np.r_[0, np.cumsum(marks)]
        before = np.r_[0, np.cumsum(costs()[cp] + 2.5 * _alone(cp) + ((cp >= 0x80) & (cp < 0x250)))]
        best, way = _Trip(text, before), ""
        encoded = {}
        whole = float(before[-1])
        first = first or whole
        for w in MISTAKEN:
            raw, starts = _encoded(cp, w)
            held = (np.diff(starts) > 1) | (np.frombuffer(raw, np.uint8)[starts[:-1]] != 10)
            if not (held & marks).any():
                continue
            encoded[w] = raw, starts
            trip = _from_unicode(_Trip(text, before), raw, starts)
            if trip.gain > best.gain + 1e-6:
                best, way = trip, f"{w}>utf-8"
            if best.gain > SURE * whole:
                break
        if best.gain < 0.3 * whole and (not path or whole > FURTHER * first):
            for w, r in _legacy():
                if w in encoded:
                    trip = _from_legacy(_Trip(text, before), *encoded[w], dear, r)
                    if trip.gain > best.gain + 1e-6:
                        best, way = trip, f"{w}>{r}"
                    if best.gain > SURE * whole:
                        break
        if not way or path and best.gain < FURTHER * cost(text):
            break
        text = best.result()
        path.append(way)
    return text, path


def without_examples(text: str) -> str:
    """The text without what it quotes, where that would be dear."""
    return QUOTED.sub(lambda m: "" if cost(m[0]) > 1.5 else m[0], text)


def _marks(cp: np.ndarray) -> np.ndarray:
    """Where a code point, or what stands beside it, hints at garbling."""
    if not cp.size:
        return np.zeros(0, bool)
    c = costs()[cp]
    h = _groups()[0][cp]
    lower = _case()[0][cp]
    marks = (c >= 2.5) & (cp != 0xFFFD) | _alone(cp)
    rare = h & (c > 1)
    letter = (cp >= 0x80) & ((cp < 0x250) | (cp >= 0x370) & (cp < 0x530))
    other = (cp >= 0x80) & ~h & ~((cp >= 0x3000) & (cp < 0x3040)) & (cp < 0xFF00)
    plain = lower | (cp >= 0x2010) & (cp < 0x203B) | (cp >= 0x2500) & (cp < 0x2580)
    marks[:-1] |= letter[:-1] & other[1:] & ~(lower[:-1] & plain[1:]) | rare[:-1] & rare[1:]
    return marks


def hinted(texts: list[str]) -> np.ndarray:
    """Which texts have anything that hints at garbling; the others are right as they are.  Texts are looked at together, apart from each other."""
    if not texts:
        return np.zeros(0, bool)
    gap = "\n" * (AROUND + 1)
    cp, _ = code_points([gap.join((*texts, ""))])
    ends = np.cumsum([len(s) + len(gap) for s in texts])
    total = np.r_[0, np.cumsum(_marks(cp))]
    out = total[ends] > total[np.r_[0, ends[:-1]]]
    for k, s in enumerate(texts):
        if not out[k] and (any(x in s for x in LOST) or CONTROL.search(s)):
            out[k] = True
    return out


def examine(text: str) -> tuple[bool, bool, str, str]:
    """Whether a text is garbled, whether characters are lost, the text restored as far as it goes, and the trips.

    What the consistent form of problem 5 mends, such as look-alike letters, is no garbling: a trip has to lower the cost of that form.
    """
    if not hinted([text])[0]:
        return False, False, text, ""
    plain = without_examples(text)
    lost = any(x in plain for x in LOST)
    odd = CONTROL.search(plain) is not None
    path: list[str] = []
    same = consistent([plain])[0]
    unseen = UNSEEN.search(plain) is not None
    if unseen or _marks(code_points([same])[0]).any():
        least, restored = cost(plain if unseen else same), []
        for at in range(0, len(plain), WINDOW):
            new, trips = repair(plain[at : at + WINDOW])
            restored.append(new)
            path = path or trips
        if path and cost("".join(restored)) > least - LEAST_DROP:
            path = []
    restored = "".join(restored) if path else text
    if path and plain != text:
        restored = "".join(repair(text[at : at + WINDOW])[0] for at in range(0, len(text), WINDOW))
    left = without_examples(restored)
    lost = lost or odd and CONTROL.search(left) is not None or bool(path) and any(x in left for x in LOST)
    return bool(path) or lost, lost, restored, ",".join(path)


def read_upload(payload: str | None) -> tuple[str | None, bool, bytes]:
    """The text of an upload as the project reads it, whether bytes were left out, and the bytes; None where the payload isn't base64."""
    if payload is None:
        return None, False, b""
    if payload.startswith("data:"):
        payload = payload.partition(",")[2]
    try:
        raw = base64.b64decode(payload, validate=True)
    except (binascii.Error, ValueError):
        return None, False, b""
    for encoding in ("utf-8", "gb18030", "gbk"):
        try:
            return raw.decode(encoding), False, raw
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore"), True, raw


def _from_bytes(raw: bytes, text: str, left_out: bool) -> str:
    """The text that the bytes give in the encoding of least cost, if that is less than the cost of ``text`` and of bytes left out of it."""
    best, least = text, cost(text) + 4 * len(CONTROL.findall(text)) + (4 * (len(raw) - len(text.encode("utf-8", "surrogatepass"))) if left_out else 0)
    for encoding in ("utf-16", *(("utf-16-le", "utf-16-be") if b"\0" in raw else ()), "cp1252", "big5hkscs", "cp932"):
        try:
            new = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if (c := cost(new)) < least - LEAST_DROP:
            best, least = new, c
    return best


def _examine(uploads: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            kept, found = [], []
            texts = [read_upload(s) if uploads else (s, False, b"") for s in b.column(1).to_pylist()]
            hints = hinted([s or "" for s, _, _ in texts])
            for r, (s, left_out, raw) in enumerate(texts):
                if not (left_out or hints[r]):
                    continue
                garbled, lost, restored, trips = examine(s)
                if garbled or left_out:
                    if uploads and (new := _from_bytes(raw, restored, left_out)) != restored:
                        restored, trips, lost, left_out = new, "bytes", False, False
                    kept.append(r)
                    found.append((restored, trips, lost or left_out))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.bool_())], names=["id", "restored", "trips", "lost"])

    return run


def garbled_rows(df: DataFrame, id_col: str, text_col: str, uploads: bool = False) -> DataFrame:
    """``(id, restored, trips, lost)`` of the rows whose text is garbled: the text as far as it can be restored, the round trips that did it, and whether
    characters are lost.  With ``uploads``, the column holds base64 payloads of files.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(_examine(uploads), f"id {kind}, restored string, trips string, lost boolean")
