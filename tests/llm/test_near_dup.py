"""near_duplicate_pairs against the definition of p1_found, worked out by brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import SparkSession

from quillmill.llm import near_dup
from quillmill.llm.near_dup import BITS, LEAST, SKETCH_MOST, WIDTH, codeword_indices, compact, fingerprints, near_duplicate_pairs


def brute(rows: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    there = [(i, s) for i, s in rows if s is not None]
    sets = [(i, {f[k : k + WIDTH] for k in range(max(len(f) - WIDTH + 1, 1))}) for (i, _), f in zip(there, compact([s for _, s in there]), strict=True) if f]
    return {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= LEAST * len(x | y)}


def found(spark: SparkSession, rows: list[tuple[int, str | None]]) -> list[tuple[int, int]]:
    return sorted(map(tuple, near_duplicate_pairs(spark.createDataFrame(rows, "ord bigint, text string")).collect()))


def test_short_blank_and_invisible_texts(spark: SparkSession) -> None:
    texts = [None, "", " ", "​", "​‍", "a", "a​", "A", "ab", "abc", "abcd", "abcd", "abcde", "a b c d e", "abcdef"]
    rows = list(enumerate(texts))
    assert found(spark, rows) == sorted(brute(rows))


def letters(rng: random.Random, size: int) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))


def test_pairs_on_both_sides_of_every_border_of_length(spark: SparkSession) -> None:
    rng = random.Random(1)
    texts = []
    for size, longer in [(95, 105)] * 20 + [(99, 100), (100, 101), (101, 102), (136, 137), (137, 138), (141, 142), (135, 150), (60, 70), (200, 220)] * 4:
        text = letters(rng, size)
        texts += [text, text + letters(rng, longer - size)]
    texts += [texts[0] * 3, texts[0] * 40]  # long, with few distinct runs
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert len(expected) == 61
    assert found(spark, rows) == sorted(expected)


def test_segments_that_differ_in_two_bits_have_an_index_in_common() -> None:
    errors = [0, *(1 << a | 1 << b for a in range(BITS) for b in range(a + 1))]
    words = np.arange(1 << 11)  # one of each coset; a codeword added to both segments changes all indices alike
    near = codeword_indices(words)
    for e in errors:
        other = codeword_indices(words ^ e)
        assert ((near[:, :, None] == other[:, None, :]) & (near >= 0)[:, :, None]).any((1, 2)).all()


def test_no_pair_at_the_threshold_is_lost() -> None:
    rng = random.Random(2)
    letter = [chr(0x4E00 + k) for k in range(3000)]
    texts, size = [], 1000
    for _ in range(600):
        text = [rng.choice(letter) for _ in range(size)]
        other = text[:]
        for k in range(35):  # each change takes five runs: J = 825 / 1172
            other[28 * k + 10] = "a"
        texts += ["".join(text), "".join(other)]
    which, keys, indices, sketch = fingerprints(texts)
    assert which.tolist() == list(range(1200))
    met = 0
    for a in range(0, 1200, 2):
        table = (keys[a] == keys[a + 1])[:, None, None] & (indices[a][:, :, None] == indices[a + 1][:, None, :]) & (indices[a] >= 0)[:, :, None]
        met += bool(table.any()) and int(np.bitwise_count((sketch[a] ^ sketch[a + 1]).view(np.uint64)).sum()) <= SKETCH_MOST
    assert met == 600


def test_tables_beyond_the_bound_are_joined(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(5)
    base = letters(rng, 300)
    rows = [(k, base[: 10 + k] + "x" + base[12 + k :]) for k in range(0, 120, 2)] + [(k, letters(rng, 80)) for k in range(200, 260)]
    assert found(spark, rows) == sorted(brute(rows))
    monkeypatch.setattr("quillmill.llm.near_dup.GROUP", 5)
    from quillmill.llm import near_dup

    table = spark.createDataFrame(rows, "id bigint, text string")
    batches = [b for b in near_dup._tables(5, 0.7)(iter(table.toArrow().to_batches()))]
    import pyarrow as pa

    every = pa.Table.from_batches(batches).sort_by("tab")
    handed = sum(b.num_rows - b.column(0).null_count == 0 and b.num_rows for b in near_dup._paired(iter(every.to_batches(max_chunksize=50))))
    assert handed > 0
    pairs = {(x, y) for b in near_dup._paired(iter(every.to_batches(max_chunksize=50))) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x is not None}
    monkeypatch.setattr("quillmill.llm.near_dup.GROUP", 10**9)
    whole = {(x, y) for b in near_dup._paired(iter(every.to_batches(max_chunksize=50))) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert pairs < whole


def test_sorted_runs_of_texts_of_any_length(monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(near_dup, "PART", 64)  # longer texts come in several turns
    rng = random.Random(5)
    forms = ["", "abc", "abcde", "a" * 9, *("".join(rng.choice("abcd") for _ in range(n)) for n in (6, 63, 64, 65, 300))]
    found = near_dup._distinct_runs(forms, 5)
    whole = near_dup._run_hashes
    for s, h in zip(forms, found, strict=True):
        runs = {s[k : k + 5] for k in range(max(1, len(s) - 4))} if s else set()
        cp = [np.frombuffer(r.encode("utf-32-le"), np.uint32) for r in runs]
        assert h.tolist() == sorted(int(whole(c, 5)[0]) for c in cp)
