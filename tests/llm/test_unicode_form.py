"""The consistent form, and pairs of look-alikes under any join."""

from __future__ import annotations

import random
import unicodedata as ud

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmill.llm import unicode_form
from quillmill.llm.unicode_form import consistent, consistent_form, look_alike_pairs, look_alike_rows


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ｈｅｌｌｏ　１２", "Hello 12"), ("é", "é"), ("a​b­c", "abc"), ("a b c", "a b c"), ("Сourse", "Course"), ("q̣̇", ud.normalize("NFC", "q̣̇")), ("ﬁn", "fin"), ("⼤⽤", "大用"),
        ("don‑t", "don-t"), ("ё", "ë"), ("，", "，"), ("👩🏽‍🏫", "👩🏽‍🏫"), ("", ""), ("a\r\nb\rc", "a\nb\nc"),
    ],
)
def test_forms(text: str, form: str) -> None:
    assert consistent([text]) == [form]
    assert consistent([form]) == [form]


def test_composed_and_decomposed_are_one_for_every_character() -> None:
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and ud.decomposition(chr(c))]
    assert consistent([ud.normalize("NFC", c) for c in every]) == consistent([ud.normalize("NFD", c) for c in every])


def test_windows_do_not_change_the_form(monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", "é", "한", "하", "字", "̣", " ", "Ａ", "​"]) for _ in range(500)) for _ in range(20)]
    whole = consistent(texts)
    monkeypatch.setattr(unicode_form, "WINDOW", 16)
    assert consistent(texts) == whole


def test_pairs_under_sort_merge_joins(spark: SparkSession) -> None:
    rows = [(1, "Course A", "t"), (2, "Сourse A", "t"), (3, "Course A", "ｔ"), (4, "Course A", None), (5, None, "T"), (6, " ", " "), (7, "other", "u"), (2, "Сourse A", "t")]
    df = spark.createDataFrame(rows, "ord bigint, text string, title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {tuple(r) for r in look_alike_pairs(df).collect()}
        assert found == {(1, 2, "text"), (1, 4, "text"), (2, 3, "text"), (2, 4, "text"), (3, 4, "text"), (1, 3, "title")}
        assert look_alike_pairs(df.limit(0)).count() == 0
        assert {r.n for r in look_alike_rows(df).where("field = 'text'").collect()} == {5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_classes_are_paired_in_blocks(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(unicode_form, "BLOCK", 3)
    rows = [(k, "a b" if k % 2 else "a b") for k in range(20)]
    found = sorted((r.ord_a, r.ord_b) for r in look_alike_pairs(spark.createDataFrame([(k, s, None) for k, s in rows], "ord bigint, text string, title string")).collect())
    assert found == [(a, b) for a in range(20) for b in range(a + 1, 20) if (a + b) % 2]


def test_column(spark: SparkSession) -> None:
    df = spark.createDataFrame([("Ａ",), (None,)], "s string")
    assert [r.x for r in df.select(consistent_form(F.col("s")).alias("x")).collect()] == ["A", None]
