"""Round trips restore what a wrong encoding did to a text, and leave right text alone."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import SparkSession

from quillmill.llm.garbled import examine, garbled_rows

ZH = "助教统计了一百份作业，大多数人混淆了边界条件与初始状态。先写出已知量再代入，再看结果是否稳妥。"
FR = "La référence citée précède le modèle détaillé ; l’élève doit vérifier les unités à l’étape suivante."


@pytest.mark.parametrize(("text", "steps"), [(ZH, ["utf-8", "latin-1"]), (ZH, ["gb18030", "latin-1"]), (FR, ["utf-8", "cp1252"]), (FR, ["utf-8", "cp1252", "utf-8", "cp1252"]), (FR, ["cp1252", "gb18030"]), (ZH.replace("，", ","), ["utf-8", "mac-roman"]), ("the Míflonel scheme", ["utf-8", "cp1252"]), ("difficile à dire", ["utf-8", "cp1252"])])
def test_round_trips(text: str, steps: list[str]) -> None:
    wrong = text
    for right, mistaken in zip(steps[::2], steps[1::2], strict=True):
        wrong = wrong.encode(right).decode(mistaken, "replace")
    garbled, _, restored, trips = examine("Plain before. " + wrong)
    assert garbled
    assert trips
    if "�" not in wrong:
        assert restored == "Plain before. " + text


@pytest.mark.parametrize("text", [ZH, FR, "", "größe, größer – “naïve” café", "鍛造工坊的铭牌写着“锟鋙”。", "viewer shows “ö” as “Ã¶”. Explain.", "🧪 ∑∫√≠ ≤ 𝔸𝕏 𠮷", "课堂演示⽤的ﬁ eіn"])
def test_right_text_stays(text: str) -> None:
    assert examine(text) == (False, False, text, "")


def test_lost_characters_are_told(spark: SparkSession) -> None:
    rows = [(1, "184 �C at load", 0), (2, "锟斤拷锟斤拷 in text", 0), (3, None, 0), (4, " ", 0), (5, "plain", 0), (6, ZH, 0), (7, ZH.encode().decode("latin-1"), 0), (7, ZH.encode().decode("latin-1"), 0)]
    found = sorted((r.id, r.lost, r.restored == ZH) for r in garbled_rows(spark.createDataFrame(rows, "ord bigint, text string, lost int"), "ord", "text").collect())
    assert found == [(1, True, False), (2, True, False), (7, False, True), (7, False, True)]


def test_uploads(spark: SparkSession) -> None:
    files = [ZH.encode(), ZH.encode("gbk"), FR.encode("cp1252"), ZH.encode("utf-16"), ZH.replace("统计", "").encode("big5", "ignore"), b"", b"\xff"]
    rows = [(k, ("data:text/plain;base64," if k % 2 else "") + base64.b64encode(f).decode()) for k, f in enumerate(files)] + [(10, None), (11, "not base64!")]
    found = {r.id: r for r in garbled_rows(spark.createDataFrame(rows, "upload_id bigint, body string"), "upload_id", "body", uploads=True).collect()}
    assert sorted(found) == [2, 3, 4, 6]
    assert (found[2].restored, found[3].restored) == (FR, ZH)


def test_empty_table(spark: SparkSession) -> None:
    assert garbled_rows(spark.createDataFrame([], "ord bigint, text string"), "ord", "text").count() == 0
