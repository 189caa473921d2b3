"""Near-duplicate records (problem 1): Golay-code fuzzy hashing.

Every distinct text gets a fingerprint of 253 bits, 11 segments of 23.  Bit *i* is one bit of the *i*-th min-hash of the text's runs of characters, so
two texts of resemblance J differ in a share (1 - J) / 2 of their bits.  The binary Golay code (23, 12, 7) is perfect: a segment lies within 3 bits of
one codeword.  A segment within 2 bits of its codeword is decoded to the index of that word, one at distance 3 to the six words within 4 bits; then
any two segments that differ in at most 2 bits have an index in common (tests check all cases).  By the pigeonhole principle, texts whose fingerprints
differ in at most 32 bits agree so far in a segment at least, and mostly in several.

An index alone has 4,096 values, too few for a large corpus.  So each segment's keys also carry two min-hashes, ``table = (segment, minhash, minhash)``:
rows are shuffled once by that, and meet by equal index within it.  That gives up the pigeonhole guarantee, as a segment only counts with probability J^2.
To make up for it, every text gets three fingerprints of different bits of its min-hashes, so 33 tables.  With P(index in common | J = 0.7) = 0.604 the
loss, (1 - J^2 P)^33 if tables were independent, is 1e-5 at J = 0.7 (0.02 with 11 tables) and less above.  Pairs whose 128-bit sketches are far apart
leave at once; the rest are verified exactly on their texts.

Copies are collapsed before and expanded after the search, so a group of copies of any size costs one fingerprint.

Defined results
    Null and blank texts are no cases.  A text shorter than a run of ``width`` characters is its own only run.  Repeated rows and copies pair with each
    other.  Text of any length is hashed in windows of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .unicode_form import code_points, consistent

WIDTH, LEAST = 5, 0.7
SEGMENTS, BITS, BINS = 11, 23, 256
#: Fingerprints of each text, of different bits of its min-hashes.
ROUNDS = 3
TABLES = ROUNDS * SEGMENTS
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Sketches of 128 bits differ in (1 - J) / 2 of their bits, 19.2 +- 3.7 at J = 0.7; this is over six deviations more, as few runs make it vary more.
SKETCH_MOST = 44
#: Most rows of two ids that are broadcast, 16 MB.
BROADCAST_ROWS = 1_000_000
#: Most rows of one table that a task pairs in memory.
GROUP = 20_000
#: From so many distinct runs on, one hash of each run is enough for all bins.
FEW = 96
PART = 1 << 19
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each single bit, and for each syndrome the error patterns that lead to nearby codewords, -1 where there are fewer than six."""

    def rest(word: int) -> int:
        for i in range(BITS - 1, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    single = np.array([rest(1 << i) for i in range(BITS)], np.int64)
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in itertools.combinations(range(BITS), weight):
            found[int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0].append((weight, sum(1 << i for i in bits)))
    errors = np.full((1 << 11, 6), -1, np.int64)
    for syndrome, of in enumerate(found):
        use = [e for w, e in of if w == of[0][0] or of[0][0] == 3]
        errors[syndrome, : len(use)] = use
    return single, errors


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords near each 23-bit word: an array (n, 6), -1 where there are fewer."""
    single, errors = golay()
    syndrome = np.zeros(words.shape, np.int64)
    for i in range(BITS):
        syndrome ^= np.where(words >> i & 1, single[i], 0)
    e = errors[syndrome]
    return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _run_hashes(cp: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the run of ``width`` code points that begins at each place (of the last places, what is left, past the end)."""
    h = np.zeros(cp.size, np.uint64)
    for k in range(width):
        part = np.zeros(cp.size, np.uint64)
        part[: max(cp.size - k, 0)] = cp[k:]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
    return _mix(h)


def compact(texts: list[str]) -> list[str]:
    """Consistent form without white space and case."""
    return ["".join(s.lower().split()) for s in consistent(texts)]


def _turns(forms: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Run hashes of all texts in turns of bounded size: the text's place, and the hash."""
    ids: list[int] = []
    parts: list[str] = []

    def turn() -> tuple[np.ndarray, np.ndarray]:
        cp, size = code_points(parts)
        h = _run_hashes(cp, width)
        end = np.cumsum(size)  # each part has at least one run
        inside = np.ones(cp.size, bool)
        for k in range(1, width):
            inside[end - k] = False
        return np.repeat(np.asarray(ids), size - width + 1), h[inside]

    held = 0
    for i, s in enumerate(forms):
        if len(s) < width:  # its only run ends with the text, whatever stands behind
            if s:
                yield np.full(1, i), _run_hashes(code_points([s])[0], width)[:1]
            continue
        for at in range(0, len(s) - width + 1, PART):
            part = s[at : at + PART + width - 1]
            if ids and held + len(part) > PART:
                yield turn()
                ids, parts, held = [], [], 0
            ids.append(i)
            parts.append(part)
            held += len(part)
    if ids:
        yield turn()


def _filled(low: np.ndarray) -> np.ndarray:
    """Empty bins take the min-hash of another bin of their row, chosen by hash."""
    empty = low == EMPTY
    full = ~empty
    rows, bins = np.nonzero(empty)
    for turn_no in range(1, 200):
        if not rows.size:
            break
        source = (_mix((np.arange(BINS) * 1000 + turn_no).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)[bins]
        good = full[rows, source]
        low[rows[good], bins[good]] = low[rows[good], source[good]]
        rows, bins = rows[~good], bins[~good]
    return low


def _signatures(forms: list[str], width: int, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of two families, the places of its texts and their BINS min-hashes.

    Texts of FEW distinct runs and more: one hash of each run, which falls into one bin.  Texts of up to FEW / ``least`` distinct runs: a function of its
    own for each bin, as few runs would leave most bins empty.  Two texts of resemblance ``least`` or more are both in the first family where the larger
    has more than FEW / ``least`` runs, for then the other has more than FEW, and both in the second where it hasn't; so they always have one in common.
    """
    low = np.full(len(forms) * BINS, EMPTY)
    for i, h in _turns(forms, width):
        np.minimum.at(low, i * BINS + (h >> np.uint64(56)).astype(np.int64), h & np.uint64((1 << 56) - 1))
    low = low.reshape(-1, BINS)
    runs = (low != EMPTY).sum(1)  # at most the number of distinct runs, which is counted where it may be small
    check = np.flatnonzero((runs > 0) & (runs * least <= FEW + 1e-9))
    distinct: list[np.ndarray] = [np.zeros(0, np.uint64)] * check.size
    for i, h in _turns([forms[k] for k in check], width):
        order = np.argsort(i, kind="stable")
        i, h = i[order], h[order]
        for part in np.split(np.arange(i.size), np.flatnonzero(np.diff(i)) + 1):
            distinct[i[part[0]]] = np.unique(np.r_[distinct[i[part[0]]], h[part]])
    runs[check] = [d.size for d in distinct]
    binned = np.flatnonzero(runs >= FEW)
    few = [k for k in range(check.size) if runs[check[k]] * least <= FEW + 1e-9]
    seeds = _mix(np.arange(1, BINS + 1, dtype=np.uint64))
    own = np.array([_mix(distinct[k][:, None] ^ seeds[None, :]).min(0) >> np.uint64(8) for k in few], np.uint64).reshape(-1, BINS)
    return [(binned, _filled(low[binned])), (check[few] if few else check[:0], own)]


@lru_cache(1)
def _orders() -> np.ndarray:
    """The order of the bins in each round; in the first they follow each other."""
    return np.array([np.arange(BINS) if k == 0 else np.argsort(_mix(np.arange(BINS, dtype=np.uint64) + np.uint64(k << 32))) for k in range(ROUNDS)])


def segments(forms: list[str], width: int = WIDTH, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of compact texts (n), one or two of each, with table keys (n, 33), the segments' 23-bit words (n, 33) and 128-bit sketches (n, 2)."""
    families = _signatures(forms, width, least)
    low = np.concatenate([x for _, x in families])
    family = np.repeat(np.arange(2, dtype=np.uint64), [i.size for i, _ in families])
    mixed = _mix(low * np.uint64(0xD6E8FEB86659FD93) + np.arange(BINS, dtype=np.uint64)[None, :])
    words, keys = np.empty((len(low), TABLES), np.int64), np.empty((len(low), TABLES), np.uint64)
    for k in range(ROUNDS):  # the first bit of each min-hash, then the third and so on, of bins in another order
        order = _orders()[k]
        bit = (mixed >> np.uint64(k and k + 1) & np.uint64(1)).astype(np.int64)[:, order[: SEGMENTS * BITS]].reshape(-1, SEGMENTS, BITS)
        at = np.arange(SEGMENTS)
        words[:, k * SEGMENTS + at] = (bit << np.arange(BITS)).sum(2)
        a, b = order[(at * BITS + 3 * BITS + 5) % BINS], order[(at * BITS + 7 * BITS + 11) % BINS]
        keys[:, k * SEGMENTS + at] = _mix(_mix(mixed[:, a]) + mixed[:, b] + (k * SEGMENTS + at).astype(np.uint64)[None, :] + family[:, None] * np.uint64(TABLES))
    second = (mixed >> np.uint64(1) & np.uint64(1))[:, ::2].reshape(-1, 64, 2)
    sketch = (second << np.arange(64, dtype=np.uint64)[None, :, None]).sum(1, dtype=np.uint64)
    return np.concatenate([i for i, _ in families]), keys.view(np.int64) >> 32, words, sketch.view(np.int64)


def fingerprints(forms: list[str], width: int = WIDTH, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `segments`, but with the codeword indices (n, 33, 6) near each word."""
    which, keys, words, sketch = segments(forms, width, least)
    return which, keys, codeword_indices(words.reshape(-1)).reshape(-1, TABLES, 6), sketch


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, s) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and s is not None and s.strip()]
        forms = compact([s for _, s in rows])
        kept = [(i, xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass"))) for (i, _), f in zip(rows, forms, strict=True) if f]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array([h for _, h in kept], pa.binary())], names=["id", "form"])


def _tables(width: int, least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if s.strip()]
            for at in range(0, len(rows), 1024):
                turn = rows[at : at + 1024]
                there = [(i, f) for (i, _), f in zip(turn, compact([s for _, s in turn]), strict=True) if f]  # of invisible characters only, nothing is left
                if not there:
                    continue
                which, keys, words, sketch = segments([f for _, f in there], width, least)
                part = np.repeat(np.array([i for i, _ in there], np.int64)[which], TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys.reshape(-1).astype(np.int32)), pa.array(words.reshape(-1).astype(np.int32)), *(pa.array(np.repeat(sketch[:, k], TABLES)) for k in range(2))], names=["id", "tab", "word", "s", "t"])

    return run


def _distinct_runs(forms: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct run hashes of each text."""
    found: list[list[np.ndarray]] = [[] for _ in forms]
    for i, h in _turns(forms, width):
        begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])  # the rows of a text stand together in a turn
        for k, at, end in zip(i[begin].tolist(), begin.tolist(), np.r_[begin[1:], i.size].tolist(), strict=True):
            found[k].append(h[at:end])
    return [_sorted_distinct(np.concatenate(x) if len(x) > 1 else x[0]) if x else np.zeros(0, np.uint64) for x in found]


def _sorted_distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.empty(h.size, bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _verify(width: int, least: float):  # noqa: ANN202
    """Exact similarity: each text of a batch is hashed once, and pairs compare sorted arrays of distinct 64-bit run hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            a_ids, b_ids, texts_a, texts_b = (b.column(k).to_pylist() for k in range(4))
            known = dict(zip(a_ids, texts_a, strict=True))
            known |= dict(zip(b_ids, texts_b, strict=True))
            place = {i: k for k, i in enumerate(known)}
            runs = _distinct_runs(compact(list(known.values())), width)
            out_a, out_b, out_j = [], [], []
            for x, y in zip(a_ids, b_ids, strict=True):
                one, other = runs[place[x]], runs[place[y]]
                if other.size * least <= one.size + 1e-9 and one.size * least <= other.size + 1e-9:
                    both = np.concatenate([one, other])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    j = common / (both.size - common)
                    if j >= least - 1e-12:
                        out_a.append(x), out_b.append(y), out_j.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_j, pa.float64())], names=["a", "b", "similarity"])

    return run


def members(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """``(id, rep)``: each non-blank row and the smallest id among the rows of the same compact form."""
    forms = df.select(id_col, text_col).mapInArrow(_forms, "id bigint, form binary")
    return forms.join(forms.groupBy("form").agg(F.min("id").alias("rep")), "form").select("id", "rep")


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df``, best a table that was cut, has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def _pairs_within(tab: np.ndarray, ids: np.ndarray, word: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that share a table key and a codeword index near their words, and whose sketches are near."""
    near = codeword_indices(word.astype(np.int64))
    there = near >= 0
    key = np.repeat(tab.astype(np.int64) << 12, there.sum(1)) | near[there]
    row = np.nonzero(there)[0]
    order = np.argsort(key)
    key, row = key[order], row[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[begin, key.size])
    left = np.repeat(begin + count, count) - np.arange(key.size)  # members from here to the end of the group
    at = np.flatnonzero(left > 1)
    found: list[np.ndarray] = []
    step = 1
    while at.size:
        x, y = row[at], row[at + step]
        close = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= SKETCH_MOST
        x, y = ids[x[close]], ids[y[close]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])
        step += 1
        at = at[left[at] > step]
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


TABLE_SCHEMA = "id bigint, tab int, word int, s bigint, t bigint"
PAIR_SCHEMA = f"a bigint, b bigint, {TABLE_SCHEMA}"


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by table key to pairs.  A table of more than GROUP rows is handed on as it is, so that no task holds more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("tab", pa.int32()), ("word", pa.int32()), ("s", pa.int64()), ("t", pa.int64())])
    names = ["id", "tab", "word", "s", "t"]

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        sketch = np.stack([rows["s"].to_numpy(), rows["t"].to_numpy()], 1).view(np.uint64)
        a, b = _pairs_within(rows["tab"].to_numpy(), rows["id"].to_numpy(), rows["word"].to_numpy(), sketch)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(a.size, t) for t in schema.types[2:])], schema=schema)

    def handed_on(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in rows.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64())] * 2 + [b.column(n).cast(schema.field(n).type) for n in names], schema=schema)

    held: pa.Table | None = None
    hot: int | None = None
    for b in batches:
        rows = pa.Table.from_batches([b]).select(names)
        rows = rows if held is None else pa.concat_tables([held, rows])
        tab = rows["tab"].to_numpy()
        if hot is not None:
            end = int(np.searchsorted(tab, hot, "right"))
            yield from handed_on(rows.slice(0, end))
            rows, tab = rows.slice(end), tab[end:]
            if not tab.size:
                held = None
                continue
            hot = None
        last = int(np.searchsorted(tab, tab[-1], "left"))
        if last:
            yield pairs(rows.slice(0, last))
        held = rows.slice(last)
        if held.num_rows > GROUP:
            hot = int(tab[-1])
            yield from handed_on(held)
            held = None
    if held is not None and held.num_rows:
        yield pairs(held)


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near = codeword_indices(b.column(2).to_numpy().astype(np.int64))
        row, at = np.nonzero(near >= 0)
        part = b.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near[row, at].astype(np.int32)), part.column(3), part.column(4)], names=["id", "tab", "near", "s", "t"])


def candidate_pairs(texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """Pairs ``(a, b)`` of ids of ``texts(id, text)`` that share a table key and a codeword index in it, and whose sketches are near.

    Rows are shuffled once, by table key, and paired within it; words are decoded to codeword indices in memory.  Rows of tables that are too large for that are
    unfolded and joined by both, which spreads them over as many tasks as there are indices.
    """
    tab = texts.mapInArrow(_tables(width, least), TABLE_SCHEMA)
    tab = tab.repartition(ROUNDS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tab").sortWithinPartitions("tab")
    found = cut(tab.mapInArrow(_paired, PAIR_SCHEMA))
    near = found.where("id IS NOT NULL").select("id", "tab", "word", "s", "t").mapInArrow(_unfolded, "id bigint, tab int, near int, s bigint, t bigint")
    x, y = near.alias("x"), near.alias("y")
    far = F.bit_count(F.col("x.s").bitwiseXOR(F.col("y.s"))) + F.bit_count(F.col("x.t").bitwiseXOR(F.col("y.t")))
    on = (F.col("x.tab") == F.col("y.tab")) & (F.col("x.near") == F.col("y.near")) & (F.col("x.id") < F.col("y.id")) & (far <= SKETCH_MOST)
    hot = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return found.where("a IS NOT NULL").select("a", "b").unionByName(hot).distinct()


def similar_texts(texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``(a, b, similarity)`` of the distinct texts ``(id, text)`` whose sets of runs have at least ``least`` of their union in common.

    Candidate pairs are cut to a table.  Where they are few enough to broadcast, that is checked, only the texts that they name are shuffled; beyond
    that, pairs and texts are joined by shuffle.
    """
    pairs = cut(candidate_pairs(texts, width, least))
    text_a, text_b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    if small(pairs, BROADCAST_ROWS):
        with_a = text_a.join(F.broadcast(pairs), "a")
        text_b = text_b.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    else:
        with_a = pairs.join(text_a, "a")
    return with_a.join(text_b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(width, least), "a bigint, b bigint, similarity double")


def near_duplicates(df: DataFrame, id_col: str = "ord", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, rep)`` of the groups of copies, and links ``(a, b, similarity)`` between their representatives: all there is, without the pairs of copies."""
    of = cut(members(df, id_col, text_col))
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    copies = of.where("id <> rep").select("id")
    texts = texts.join(F.broadcast(copies) if small(copies, BROADCAST_ROWS) else copies, "id", "left_anti")
    return of, similar_texts(texts, width, least)


def near_duplicate_pairs(df: DataFrame, id_col: str = "ord", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """All pairs of rows ``(ord_a, ord_b)`` with equal or similar texts, copies expanded."""
    of, links = near_duplicates(df, id_col, text_col, width, least)
    a, b = of.select(F.col("id").alias("ia"), F.col("rep").alias("a")), of.select(F.col("id").alias("ib"), F.col("rep").alias("b"))
    linked = links.select("a", "b").join(a, "a").join(b, "b").select("ia", "ib")
    copies = a.join(b, F.col("a") == F.col("b")).where("ia < ib").select("ia", "ib")
    return linked.unionByName(copies).select(F.least("ia", "ib").alias("ord_a"), F.greatest("ia", "ib").alias("ord_b"))
