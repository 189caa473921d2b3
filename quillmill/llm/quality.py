"""Per-document text quality statistics, and whether a text is natural prose (problem 4).

1. Texts longer than PART characters are split into parts, so that one huge document is many rows of work.
2. Of each part *partial counts* are made: a vector of sums, maxima, and the state at both boundaries.  The line that a boundary cuts is kept apart as a
   vector of its own counts (head and tail), and so is whether a word runs over the boundary.
3. Partial counts are *associative*: `merge` joins two neighbours, mending the cut line and the cut word, and parts are merged in a tree, PARTS_A_STEP at a
   time, in rounds of aggregation; no task ever holds more than PARTS_A_STEP states of a document.
4. Ratios are derived from the merged counts, and the rule outcome is that of a linear model of them, fitted to hand labels.

The model is fitted on at most LABELLED rows (a documented bound, chosen by hash of the id), everything else covers all rows.

A word is a run of letters and digits; each Chinese character counts as a word.  A common word is one of the given list; those of Chinese are found as
substrings.  A sentence's end is a line's last visible character, before closing marks.

Defined results
    Null and blank texts have counts of 0 and null ratios, and no outcome.  Repeated rows give repeated results.  An empty table gives an empty table; without a
    label of both sorts there is no model, and an error says so.  Texts of any length are counted whole.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .garbled import examine
from .unicode_form import code_points

PART, PARTS_A_STEP = 1 << 16, 64
#: Rounds of merging: enough for the longest text there can be, 2^31 bytes.
ROUNDS = 3
LABELLED = 20_000
#: Most common words.
WORDS = 10_000
#: Marks that end a sentence, closing marks behind them, and marks that get a count of their own.
SENTENCE_ENDS, CLOSERS, MARKS = "。！？.!?…", "”’」』）】》\"')]»", ",.;:|│\t=()_{}/#<>[]-*•·、，。；：“”\"'+&%@~^\\$`"
BULLET = re.compile(r"\s*(?:[-*•·–+]\s|\d{1,3}[.、)）]|[（(]\d{1,3}[)）]|\* \[)")
TOKEN = re.compile(r"[^\W_㐀-鿿]+")
CJK = re.compile(r"[㐀-鿿]")
WIDE = re.compile(r" {2,}|\t")

#: Of a line: visible characters, whether it is visible at all, ends in a sentence's end, in another mark, begins as a list item, has delimiters, is short.
LINE = ("line_chars", "lines", "ended", "ended_chars", "marked", "bullets", "bullet_chars", "delimited", "delimited_chars", "short", "squares")
SUMS = ("chars", "spaces", "letters", "upper", "digits", "cjk", "words", "word_chars", "common", "wide_gaps", "symbols", *(f"mark_{ord(c)}" for c in MARKS))
MOST = ("longest_word",)


#: Of each value of bits, which of the five are set.
OF_BIT = np.array([[k >> bit & 1 for bit in range(5)] for k in range(32)])


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Bits of every code point (1 space, 2 letter, 4 upper case, 8 digit, 16 Chinese), and the place of marks in MARKS."""
    bits, mark = np.zeros(0x110000, np.uint8), np.full(0x110000, len(MARKS), np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x3FFFF:
            bits[cp] = 16
        else:
            bits[cp] = ch.isspace() | ch.isalpha() << 1 | ch.isupper() << 2 | ch.isdigit() << 3
    for k, c in enumerate(MARKS):
        mark[ord(c)] = k
    return bits, mark


Words = tuple[frozenset[str], tuple[str, ...]]
#: What the last visible character of a line is: there is none, a sentence's end, another mark, a letter or digit.
NOTHING, ENDED, MARKED, OTHER = range(4)
Line = tuple[int, int, bool, int]


def line_state(line: str) -> Line:
    """Of a line or a part of one: visible characters, delimiters, whether it begins as a list item, and what it ends in."""
    visible = len("".join(line.split()))
    if not visible:
        return 0, 0, False, NOTHING
    last = line.rstrip().rstrip(CLOSERS)[-1:]
    end = NOTHING if not last else ENDED if last in SENTENCE_ENDS else OTHER if last.isalnum() else MARKED
    return visible, len(WIDE.findall(line.strip())) + line.count("|") + line.count("│"), BULLET.match(line) is not None, end


def _join_lines(a: Line, b: Line) -> Line:
    return a[0] + b[0], a[1] + b[1], a[2] if a[0] else b[2], b[3] or a[3]


def line_counts(state: Line) -> np.ndarray:
    size, gaps, bullet, end = state
    if not size:
        return np.zeros(len(LINE))
    return np.array([size, 1, end == ENDED, (end == ENDED) * size, end in (MARKED, NOTHING), bullet, bullet * size, gaps > 1, (gaps > 1) * size, size < 25, size * size], float)


class Counts:
    """Counts of a text or of a part of it, and the state at its boundaries."""

    __slots__ = ("sums", "inner", "broken", "head", "tail", "begin", "end", "longest", "before", "behind", "one")

    @classmethod
    def of(cls, text: str, words: Words) -> Counts:
        c = cls()
        bits, mark = _kinds()
        cp, _ = code_points([text])
        kinds, marks = np.bincount(bits[cp], minlength=32), np.bincount(mark[cp], minlength=len(MARKS) + 1)
        spaces, letters, upper, digits, cjk = (kinds @ OF_BIT).tolist()
        latin = TOKEN.findall(text.lower())
        sizes = [len(w) for w in latin]
        common = sum(map(words[0].__contains__, latin)) + (sum(map(text.count, words[1])) if cjk else 0)
        c.sums = np.array([cp.size, spaces, letters, upper, digits, cjk, len(latin) + cjk, sum(sizes) + cjk, common, len(WIDE.findall(text)), cp.size - spaces - letters - digits - cjk, *marks[:-1]], float)
        lines = [line_state(x) for x in text.split("\n")]
        c.broken, c.head, c.tail = len(lines) > 1, lines[0], lines[-1]
        c.inner = np.sum([line_counts(x) for x in lines[1:-1]], 0) if len(lines) > 2 else np.zeros(len(LINE))
        keep = max(map(len, words[1]), default=1) - 1
        c.begin, c.end = text[: max(keep, 1)], text[-max(keep, 1) :]
        c.longest = max(sizes, default=0)
        c.before = sizes[0] if sizes and TOKEN.match(text) else 0
        c.behind = sizes[-1] if sizes and TOKEN.match(text[-1]) else 0
        c.one = bool(sizes) and sizes[0] == len(text)
        return c

    def merge(self, other: Counts, words: Words) -> Counts:
        """The counts of this part and the next one together."""
        c = Counts()
        c.sums = self.sums + other.sums
        if self.behind and other.before:  # one word runs over the boundary
            c.sums[SUMS.index("words")] -= 1
        both = self.end + other.begin
        c.sums[SUMS.index("common")] += sum(both.count(w) - self.end.count(w) - other.begin.count(w) for w in words[1] if len(w) > 1)
        across = _join_lines(self.tail if self.broken else self.head, other.head)
        c.inner = self.inner + other.inner
        c.broken = self.broken or other.broken
        if self.broken and other.broken:
            c.inner = c.inner + line_counts(across)
        c.head = self.head if self.broken else across
        c.tail = other.tail if other.broken else across
        c.begin, c.end = self.begin, other.end
        c.longest = max(self.longest, other.longest, self.behind + other.before)
        c.before = self.before + (other.before if self.one else 0)
        c.behind = other.behind + (self.behind if other.one else 0)
        c.one = self.one and other.one
        return c

    def vector(self) -> np.ndarray:
        """All counts, the text being complete."""
        edge = self.inner + line_counts(self.head) + (line_counts(self.tail) if self.broken else 0)
        return np.concatenate((self.sums, edge, (self.longest,)))

    def dump(self) -> bytes:
        return pickle.dumps([getattr(self, k) for k in self.__slots__])

    @classmethod
    def load(cls, raw: bytes) -> Counts:
        c = cls()
        for k, v in zip(cls.__slots__, pickle.loads(raw), strict=True):  # noqa: S301 - of our own making
            setattr(c, k, v)
        return c


def parts(text: str, size: int = PART) -> list[str]:
    """The text in parts of about ``size`` characters, ended behind a line or a word where there is one near, so that few lines and words are cut."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        for pattern in ("\n", " "):
            found = text.rfind(pattern, max(at, end - 4096), end)
            if found > at and not text[found + 1 : found + 2].isspace():
                end = found + 1
                break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def vector(text: str, words: Words) -> np.ndarray:
    return Counts.of(text, words).vector()


def ratios(v: np.ndarray) -> np.ndarray:
    """Ratios of counts (n, SUMS + LINE + MOST): the model's input."""
    s, e = v[:, : len(SUMS)], v[:, len(SUMS) : len(SUMS) + len(LINE)]
    get = dict(zip(SUMS, s.T, strict=True)) | dict(zip(LINE, e.T, strict=True)) | {"longest_word": v[:, -1]}
    visible = np.maximum(get["chars"] - get["spaces"], 1)
    lines, words = np.maximum(get["lines"], 1), np.maximum(get["words"], 1)
    marks = s[:, SUMS.index(f"mark_{ord(MARKS[0])}") :] / np.maximum(get["chars"], 1)[:, None]
    columns = [
        get["letters"] / visible, get["upper"] / visible, get["digits"] / visible, get["cjk"] / visible, get["symbols"] / visible, get["spaces"] / np.maximum(get["chars"], 1),
        get["word_chars"] / words, get["common"] / words, np.minimum(np.log1p(get["longest_word"]), 6), get["wide_gaps"] / lines, get["ended"] / lines, get["ended_chars"] / visible,
        get["marked"] / lines, get["bullets"] / lines, get["bullet_chars"] / visible, get["delimited"] / lines, get["delimited_chars"] / visible, get["short"] / lines,
        np.log1p(get["squares"] / visible), np.log1p(lines), (get["digits"] > 0.3 * visible), (get["common"] == 0),
    ]
    return np.c_[np.stack([np.asarray(c, float) for c in columns], 1), np.sqrt(marks)]


def fit(x: np.ndarray, prose: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: means, scales and weights (the last one is the constant)."""
    if prose.all() or not prose.any():
        raise ValueError("labels of prose and of something else are needed")
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(w.size)
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (prose - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def score(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Over 0 for prose."""
    mean, scale, w = model
    return np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))] @ w


def common_words(df: DataFrame) -> Words:
    """Common words of ``common_word(lang, word)``, a table of fixed size: those of letters as a set, Chinese ones in order."""
    found = sorted({r["word"].lower() for r in df.where("word IS NOT NULL AND length(word) > 0").select("word").distinct().limit(WORDS + 1).collect()})
    if len(found) > WORDS:
        raise ValueError(f"more than {WORDS} common words")
    return frozenset(w for w in found if not CJK.search(w)), tuple(w for w in found if CJK.search(w))


#: Whether a text, or a part of it, is damaged; also gets the counts where the text is whole.
Damage = Callable[[str, np.ndarray | None], bool]


def _vectors(keys: int, words: Words, damage: Damage | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [s or "" for s in b.column(keys).to_pylist()]
            found = [vector(s, words) for s in texts]
            damaged = [damage is not None and damage(s, v) for s, v in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.select(range(keys)).columns, pa.array(found, pa.list_(pa.float64())), pa.array(damaged, pa.bool_())], names=[*b.schema.names[:keys], "counts", "damaged"])

    return run


def _part_rows(keys: int, words: Words, size: int, damage: Damage | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, s in enumerate(b.column(keys).to_pylist()):
                for k, x in enumerate(parts(s, size)):
                    values = (pa.array([k], pa.int64()), pa.array([Counts.of(x, words).dump()], pa.binary()), pa.array([damage is not None and damage(x, None)], pa.bool_()))
                    yield pa.RecordBatch.from_arrays([*b.select(range(keys)).slice(r, 1).columns, *values], names=[*b.schema.names[:keys], "part", "state", "damaged"])

    return run


def counts(df: DataFrame, id_col: str, text_col: str, words: Words, size: int = PART, damage: Damage | None = None) -> DataFrame:
    """``(id, counts, damaged)`` of every row; counts are the sums of SUMS and LINE and the longest word."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= size).mapInArrow(_vectors(1, words, damage), f"id {kind}, counts array<double>, damaged boolean")
    far = rows.where(F.length("text") > size).select("id", F.monotonically_increasing_id().alias("row"), "text")
    schema = f"id {kind}, row bigint, part bigint, state binary, damaged boolean"
    states = far.mapInArrow(_part_rows(2, words, size, damage), schema)

    def step(key, group):  # noqa: ANN001, ANN202
        group = group.sort_values("part")
        state = Counts.load(group["state"].iloc[0])
        for raw in group["state"].iloc[1:]:
            state = state.merge(Counts.load(raw), words)
        return group.iloc[:1].assign(part=key[2], state=state.dump(), damaged=bool(group["damaged"].any()))[["id", "row", "part", "state", "damaged"]]

    for _ in range(ROUNDS):
        states = states.groupBy("id", "row", F.floor(F.col("part") / PARTS_A_STEP).alias("step")).applyInPandas(step, schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Counts.load(x).vector() for x in b.column(3).to_pylist()], pa.list_(pa.float64())), b.column(4)], names=["id", "counts", "damaged"])

    return near.unionByName(states.mapInArrow(finish, f"id {kind}, counts array<double>, damaged boolean"))


def labelled_model(df: DataFrame, labels: DataFrame, words: Words, id_col: str = "ord", text_col: str = "text", kind_col: str = "kind", most: int = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model, fitted on at most ``most`` labelled rows, those with the smallest hashes of their ids."""
    of = labels.where(F.col(id_col).isNotNull() & F.col(kind_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(kind_col).alias("kind"))
    of = of.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(of), "id").where("text IS NOT NULL")
    found = counts(rows.withColumn("id", F.struct("id", "kind")), "id", "text", words).select("id.kind", "counts").toPandas()
    return fit(ratios(np.stack(found["counts"])), (found["kind"] == "prose").to_numpy())


def text_quality(df: DataFrame, words: Words, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """Measures of every row, and ``prose``: whether it is natural prose, null for blank texts."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(SUMS) + len(LINE) + 1)
            get = dict(zip((*SUMS, *LINE), v.T[:-1], strict=True))
            visible, lines, n = get["chars"] - get["spaces"], get["lines"], get["words"]

            def share(x: np.ndarray, of: np.ndarray) -> pa.Array:
                return pa.array(np.divide(x, of, out=np.zeros_like(x), where=of > 0), pa.float64(), mask=of <= 0)

            prose = pa.array(score(ratios(v), model) > 0, pa.bool_(), mask=visible <= 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), share(get["word_chars"], n), share(get["symbols"], visible), share(get["ended"], lines), share(get["common"], n), prose], names=["id", "words", "mean_word_length", "symbol_share", "ended_line_share", "common_word_share", "prose"])

    kind = df.schema[id_col].dataType.simpleString()
    return counts(df, id_col, text_col, words).select("id", "counts").mapInArrow(derive, f"id {kind}, words bigint, mean_word_length double, symbol_share double, ended_line_share double, common_word_share double, prose boolean")


def not_prose(df: DataFrame, words: Words, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """``(id)`` of the rows whose text isn't natural prose, without blank texts and those that a wrong encoding garbled (problem 2)."""

    def damage(text: str, v: np.ndarray | None) -> bool:
        return (v is None or score(ratios(v[None]), model)[0] <= 0) and bool(text.strip()) and examine(text)[0]

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(SUMS) + len(LINE) + 1)
            keep = (v[:, 0] > v[:, 1]) & (score(ratios(v), model) <= 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep))], names=["id"])

    kind = df.schema[id_col].dataType.simpleString()
    return counts(df, id_col, text_col, words, damage=damage).where("NOT damaged").select("id", "counts").mapInArrow(other, f"id {kind}")
