"""residue_documents: trusted units, near-duplicates of them, chains, and texts that only teach."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillmill.llm.residue import BANDS, MISSED, _changes, keys_and_simhashes, residue_documents, trusted, units

TEACHING = "Shell variables such as `${HOME}` or `%PATH%` are expanded before the command runs; lab 9 asks how Nu treats an unset name."


def test_documents(spark: SparkSession) -> None:
    texts = [
        "# Notes\n\nThe margin is small.\n\nTopic: {{ lecture_no }}", "Lecturer: <insert name here>", "姓名：%学号%", "参考资料：（待补充）", "本讲主题：XXXX年XX月XX日",
        "You need to enable JavaScript to run this app. (Tive)", "502 Bad Gateway\n\nupstream closed the connection", "The margin.\n\n- Veuillez activer JavaScript pour afficher le cours Zovi.",
        "Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor.",
        TEACHING, "<h1>{{ course_name }}</h1>\n<p>${total}</p>", "讲解 HTTP 状态码：404 表示资源不存在，502 表示网关收到无效响应。", "The margin is small, and the rest follows from it.", "", " \n", None, "设计稿常用 lorem ipsum 一类的无意义文字占位，小组讨论了它对可读性的影响。",
    ]
    rows = [(i, s, 0) for i, s in enumerate(texts)] + [(0, texts[0], 1)]
    found = sorted(r.doc_id for r in residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string, key int")).collect())
    assert found == list(range(9))


def test_labels_spread_along_a_chain(spark: SparkSession) -> None:
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda sigma omega".split()
    chain = [" ".join(words[k : k + 8]) + " now" for k in range(4)]
    rows = list(enumerate([*chain, " ".join(reversed(words[:3])) + " other words that differ"]))
    found = sorted(r.doc_id for r in residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), messages=[chain[0]]).collect())
    assert found == [0, 1, 2, 3]


def test_units_that_differ_in_few_bits_share_a_changed_band() -> None:
    changes, width = set(_changes()), 64 // BANDS
    for spread in range(1, 40):
        bits = [(spread * k * 7 + k) % 64 for k in range(MISSED)]
        bands = [sum(1 << b % width for b in set(bits) if b // width == k) for k in range(BANDS)]
        assert any(b in changes for b in bands)


def test_rules() -> None:
    assert not trusted(TEACHING)
    assert trusted("Due: TBD – fill in before release")
    assert all(map(trusted, ["Due: CHANGEME", "Dear Your title goes here", "欢迎选修××学院××班", "文字" * 9, "blah " * 12 + "bl", "此处为示例文字" * 5]))
    assert not any(map(trusted, ["| --- | --- | --- | --- | --- |", "a" * 40, "2 × 3 × 4", "See here", "ha ha ha"]))
    assert units("- a\r\n\n# b\n1. c") == ["a", "b", "c"]
    keys, sims = keys_and_simhashes([frozenset("abc"), frozenset("cab"), frozenset("abd"), frozenset()])
    assert keys[0] == keys[1] != keys[2]
    assert sims[0] == sims[1]


def test_empty_table(spark: SparkSession) -> None:
    assert residue_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
