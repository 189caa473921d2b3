"""Golden values of the text functions."""

from __future__ import annotations

from collections.abc import Callable

import pytest
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import ingest, route, search


def value(spark: SparkSession, c: Column) -> object:
    got = spark.range(1).select(c.alias("x")).first().x
    return list(got) if isinstance(got, list) else got


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: T.unify(F.lit("　a\r\nb\rc \t d\n\n\n\ne\xa0")), "a\nb\nc d\n\ne"),
        (lambda: T.unify(F.lit(None).cast("string")), None),
        (lambda: T.compact(F.lit("a  b\nc")), "a b c"),
        (lambda: T.compact(F.lit("x" * 8 + " y"), 10), "x" * 8 + " y"),
        (lambda: T.compact(F.lit("x" * 8 + " yz"), 10), "x" * 8 + "…"),
        (lambda: T.document_slug(F.lit("k/a_b-c.md")), "a_b-c"),
        (lambda: T.document_slug(F.lit("k/课程 A!.md")), "课程-a"),
        (lambda: T.document_title(F.lit("x\n ## Deep #\n# y"), F.lit("k/z.md")), "Deep #"),
        (lambda: T.document_title(F.lit("plain"), F.lit("k/o_neil-ab2cd.md")), "O Neil Ab2Cd"),
        (lambda: T.safe_file_name(F.lit("  ?? ")), "document"),
        (lambda: T.safe_file_name(F.lit("A b—C.md")), "a-b-c-md"),
        (lambda: T.terms(F.lit("ChatGPT 9abc a-b_c x 什么 向量数据库 如何")), ["chatgpt", "abc", "a-b_c", "向量数据库", "gpt"]),
        (lambda: T.sentences(F.lit("A. b! c。 d。e\n- 1. f\n\n")), ["A.", "b!", "c。", "d。e", "f"]),
        (lambda: T.requested_count(F.lit("出 0 道选择题")), 1),
        (lambda: T.requested_count(F.lit("99个题目")), 10),
        (lambda: T.requested_count(F.lit("随便")), 5),
        (lambda: T.requested_count(F.lit(None).cast("string")), 5),
        (lambda: T.numbered_steps(F.lit("1. 打开终端并进入工作目录里面 2、运行节点然后检查输出的话题。3. 成绩写到实验报告里面不要忘记 1. 打开终端并进入工作目录里面")), ["打开终端并进入工作目录里面 2、运行节点然后检查输出的话题", "打开终端并进入工作目录里面"]),
        (lambda: T.between(F.lit("前言 实验原理 甲乙丙 操作步骤 丁"), ["实验原理"], ["操作步骤"], 100), "实验原理 甲乙丙"),
        (lambda: T.between(F.lit("none"), ["x"], ["y"], 9), ""),
        (lambda: ingest.dedupe_lines(F.lit("a\n a \n\nb\na")), "a\nb\na"),
        (lambda: search.expanded(F.lit("storage")), "storage " + search.EXPANSIONS["rag"]),
        (lambda: route.topics(F.lit("RAG 简历")), ["rag", "resume"]),
        (lambda: route.topics(F.lit("x")), ["knowledge_base"]),
    ],
)
def test_functions(spark: SparkSession, column: Callable[[], Column], expected: object) -> None:
    assert value(spark, column()) == expected


ROUTES = [
    ("什么是 RAG，为什么能降低幻觉？", "evaluation"), ("总结这份实验报告的原理和步骤", "summarize"), ("根据数据库事务出 5 道选择题", "quiz_generation"), ("什么是 Embedding？", "concept_explain"),
    ("这个项目怎么写进简历？", "resume_packaging"), ("帮我总结 RAG 与 Agent 的复习重点", "summarize"), ("根据数据库事务和隔离级别出 5 道选择题", "quiz_generation"), ("什么是 RAG？请结合资料解释", "concept_explain"),
    ("帮我制定三天复习计划", "review_plan"), ("我这部分总错，帮我做错题回顾", "mistake_review"), ("如何把 TF-IDF 替换成真实 Embedding 和向量数据库？", "concept_explain"), ("RAG 和 Agent 在这个系统里分别负责什么", "resume_packaging"),
]


def test_routes(spark: SparkSession) -> None:
    df = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(ROUTES)] + [(99, "zzz"), (100, None)], "query_id int, query string")
    found = {r.query_id: (r.intent, r.confidence) for r in route.routed(spark, df).collect()}
    assert [found[k][0] for k in range(len(ROUTES))] == [i for _, i in ROUTES]
    assert found[99] == ("rag_answer", 0.0)
    assert 100 not in found
