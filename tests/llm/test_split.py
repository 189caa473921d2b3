"""Pieces of long items: limits, overlaps, natural ends, and the same pieces however ranges divide the text."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quillmill.llm.split import LIMITS, OVERLAP, Window, split_files, split_text
from quillmill.llm.unicode_form import code_points


def prose(rng: random.Random, size: int) -> str:
    out = ""
    while len(out) < size:
        if rng.random() < 0.5:
            out += "".join(rng.choice("电极电势标准曲线的误差") for _ in range(rng.randint(3, 60))) + rng.choice("。！？，")
        else:
            out += " ".join("abcdefgh"[: rng.randint(1, 8)] for _ in range(rng.randint(1, 30))) + rng.choice([". ", "! ", "\n", "\n\n", "é "])
    return out[:size]


def whole(text: str, limit: int) -> list[tuple[int, int]]:
    cp, n = code_points([text])
    return [(s, e) for s, e, _ in Window(cp, np.arange(n[0] + 1), True, limit).chain(0, len(text))]


def test_pieces_keep_the_limit_share_the_overlap_and_cover_all() -> None:
    rng = random.Random(1)
    for size in (721, 1000, 5000, 20000):
        for limit in LIMITS.values():
            text = prose(rng, size)
            pieces = whole(text, limit)
            assert pieces[0][0] == 0
            assert pieces[-1][1] == size
            assert all(0 < e - s <= limit for s, e in pieces)
            assert all(OVERLAP // 2 < e - s <= OVERLAP + 2 for (_, e), (s, _) in zip(pieces, pieces[1:], strict=False))


def test_natural_ends_are_preferred() -> None:
    text = "x" * 500 + ".\n\n" + "y" * 150 + ". " + "z" * 800
    assert whole(text, 720)[0] == (0, 503)
    text = "字" * 500 + "。" + "字" * 700
    assert whole(text, 720)[0] == (0, 501)
    text = "word " * 300
    assert all(e % 5 == 0 for _, e in whole(text, 720))


@pytest.mark.parametrize("size", [1500, 4096])
def test_ranges_give_the_pieces_of_the_whole_text(spark: SparkSession, size: int) -> None:
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (30_000, 12_345, 4096, 721, 720, 0)] + [" " * 9000, "x" * 9000, "\n" * 5000 + "字" * 3000, None]
    rows = [(i, s, "a" * 121 if i == 3 else None, "extra") for i, s in enumerate(texts)]
    rows.append(rows[1])  # delivered again
    df = spark.createDataFrame(rows, "ord bigint, text string, section string, piece string")
    found = sorted((r.id, r.field, r.piece_no, r.begin, r.end, r.piece) for r in split_text(df, "ord", size=size).collect())
    expected = [(i, "text", k, b, e, s[b:e]) for i, s, _, _ in rows if s and len(s) > 720 for k, (b, e) in enumerate(whole(s, 720), 1)]
    expected += [(3, "section", k, b, e, "a" * (e - b)) for k, (b, e) in enumerate(whole("a" * 121, 120), 1)]
    assert found == sorted(expected)


def test_files_are_read_by_ranges(spark: SparkSession, tmp_path: Path) -> None:
    text = prose(random.Random(3), 60_000)
    (tmp_path / "a.txt").write_text(text, newline="")
    (tmp_path / "empty.txt").write_text("")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    found = sorted((r.piece_no, r.begin, r.end, r.piece) for r in split_files(spark, files, size=10_000).collect())
    assert [p for *_, p in found] == [text[b:e] for b, e in whole(text, 720)]
    raw = text.encode()
    assert all(raw[b:e].decode() == p for _, b, e, p in found)


def test_empty_table(spark: SparkSession) -> None:
    assert split_text(spark.createDataFrame([], "ord bigint, text string, section string"), "ord").count() == 0
