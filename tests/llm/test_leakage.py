"""leaked_items against passages planted in texts."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

from quillmill.llm.leakage import Patterns, code_points, leaked_items, plain


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_hits_are_all_places_of_all_pieces() -> None:
    rng = random.Random(1)
    items = [(i, "".join(rng.choice("abc") for _ in range(rng.choice([0, 5, 8, 40, 100])))) for i in range(60)]
    patterns = Patterns(items)
    text = "".join(rng.choice("abc") for _ in range(200_000)) + items[-1][1]
    cp, _ = code_points([text])
    at, which = patterns.hits(cp)
    pieces = [s[k : k + 8] for _, s in items for k in range(0, len(s) - 7, 8)]
    expected = sum(text[k:].startswith(p) for p in set(pieces) for k in (i for i in range(len(text)) if text[i] == p[0] and text[i : i + 8] == p) for _ in range(pieces.count(p)))
    assert at.size == which.size == expected


def test_passages(spark: SparkSession) -> None:
    rng = random.Random(2)
    items = [words(rng, 60) for _ in range(5)] + [[*"的推导分为步其中最容易出错是检查点常见情况只验证了对称形"] * 4]
    texts: list[str | None] = []
    expected = set()
    for k, item in enumerate(items):
        glue = "" if k == 5 else " "
        for part, changed, there in ((1.0, 0, True), (0.6, 0, True), (0.6, 3, True), (0.3, 0, False), (1.0, 4, True)):
            piece = item[int(len(item) * (0.95 - part)) if part < 1 else 0 :][: int(len(item) * part)]
            for c in range(changed):
                piece[(c + 1) * len(piece) // (changed + 1) - 1] = "" if c % 2 else "Zyx"
            body = "".join(w.upper() + rng.choice([glue, glue + "\n> ", "**" + glue]) for w in piece)
            texts.append(" ".join(words(rng, 80)) + "\n" + body + "\n" + " ".join(words(rng, 80)))
            if there:
                expected.add((len(texts) - 1, k))
    texts += [None, "", "   ", "short"]
    docs = spark.createDataFrame([(i, s, 0) for i, s in enumerate(texts)] + [(0, texts[0], 1)], "doc_id bigint, text string, share int")
    rows = [(k, ("" if k == 5 else " ").join(s)) for k, s in enumerate(items)] + [(6, None), (7, ""), (8, "!!"), (0, " ".join(items[0]))]
    found = [(r.doc_id, r.item_id) for r in leaked_items(docs, spark.createDataFrame(rows, "item_id bigint, text string")).collect()]
    assert sorted(found) == sorted(expected)


def test_short_items_and_empty_tables(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "a b-C d"), (2, "xyz")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "bcd"), (2, "yzx")], "item_id bigint, text string")
    assert [tuple(r)[:2] for r in leaked_items(docs, items).collect()] == [(1, 1)]
    assert leaked_items(docs.limit(0), items).count() == leaked_items(docs, items.limit(0)).count() == 0


def test_plain_has_one_lower_case_form() -> None:
    cp, begin, count = plain(["A-b\n1", "", "Ü"])
    assert [list(map(chr, cp[b : b + n])) for b, n in zip(begin, count, strict=True)] == [["a", "b", "1"], [], ["ü"]]
