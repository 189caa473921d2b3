"""Operators on small tables with nulls, ties, repeated rows and empty inputs."""

from __future__ import annotations

import io
import math
import random
import re
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmill.operators import answer, catalog, ingest, memory, scan, search, study, tfidf, vectors
from quillmill.queries import QUERIES
from quillmill.queries_sql import SQL
from quillmill.sources import index_store, uploads
from quillmill.streaming import sessions


def test_sections_and_packing(spark: SparkSession) -> None:
    long = "".join(chr(0x4E00 + k % 3000) for k in range(1351))
    text = f"before the first heading, long enough\n# A\n#B\nbody of section b, twenty characters\n\n{'x' * 700}\n\n{'y' * 18}\n## C\n\n# D\n{long}\n\nshort"
    df = spark.createDataFrame([("k/one.md", text, 1), ("k/two.md", "# only\n## headings", 2), ("k/three.md", "", 3), ("k/four.md", None, 4)], "path string, text string, id int")
    rows = ingest.chunk_documents(df).orderBy("path", "chunk_no").collect()
    one = [(r.chunk_no, r.section, len(r.text)) for r in rows if r.source == "one.md"]
    assert one == [(1, "A", 37), (2, "B", 36), (3, "B", 720), (4, "D", 720), (5, "D", 720), (6, "D", 91)]
    assert [r.id for r in rows if r.source == "one.md"][:2] == ["one-001", "one-002"]
    assert [r.text for r in rows if r.source == "two.md"] == []
    assert ingest.chunk_documents(df.limit(0)).count() == 0


def test_ordinals(spark: SparkSession) -> None:
    names = [f"{random.Random(k).random():.9f}" for k in range(500)]
    found = {r.path: r.ord for r in ingest.with_ordinal(spark.createDataFrame([(n,) for n in names], "path string").repartition(7), ["path"]).collect()}
    assert found == {n: k for k, n in enumerate(sorted(names))}


def test_catalog(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, "a", "t", "s2", "a.md"), (0, "a", None, "s1", "a.md"), (2, "b", "u", None, "b.md")], "ord bigint, doc_id string, title string, section string, source string")
    assert tuple(catalog.corpus_stats(df).select("documents", "chunks", "sections").first()) == (2, 3, 2)
    assert {(r.doc_id, r.title, tuple(r.sections), r.chunks) for r in catalog.document_catalog(df).collect()} == {("a", None, ("s1", "s2"), 2), ("b", "u", (), 1)}
    assert tuple(catalog.corpus_stats(df.limit(0)).select("documents", "chunks", "sections").first()) == (0, 0, 0)


def test_tfidf_against_the_formulas(spark: SparkSession) -> None:
    texts = {1: "a-b c c", 2: "c d", 3: "", 4: None, 5: "-x- y"}
    df = spark.createDataFrame(list(texts.items()), "ord bigint, text string")
    index = tfidf.build_index(df, "ord", F.col("text"), "word")
    counts = {i: Counter(tfidf.word_terms(s)) for i, s in texts.items() if s}
    assert counts[1] == {"a-b": 1, "c": 2, "a-b c": 1, "c c": 1}
    assert counts[5] == {"x": 1, "y": 1, "x y": 1}
    seen = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(6 / (1 + n)) + 1 for t, n in seen.items()}
    w = {i: {t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for i, c in counts.items()}
    q = {t: idf[t] for t in ("c", "d", "c d")}
    q.pop("zz", None)
    found = {r.id: r.cosine for r in tfidf.cosines(index, spark.createDataFrame([(9, "c d zz")], "query_id bigint, query string"), "query_id", F.col("query")).collect()}
    for i in (1, 2):
        dot = sum(w[i].get(t, 0) * x for t, x in q.items())
        assert math.isclose(found[i], dot / math.sqrt(sum(x * x for x in w[i].values()) * sum(x * x for x in q.values())), rel_tol=1e-12)
    assert set(found) == {1, 2}


def test_search_keeps_terms_that_vectors_miss(spark: SparkSession) -> None:
    chunks = [(k, f"id{k}", "d", f"t{k}", "s", "f.md", f"filler text number {k} about nothing") for k in range(40)] + [(40, "x", "d", None, None, "f.md", None), (41, "y", "d", "RAG", "架构", "f.md", "检索增强生成 with RAG")]
    df = spark.createDataFrame(chunks, "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    queries = spark.createDataFrame([(1, "rag", 3), (2, None, 3), (3, "zzzz", None)], "query_id bigint, query string, top_k int")
    hits = search.search(df, queries).orderBy("query_id", "place").collect()
    assert [r.ord for r in hits if r.query_id == 1][0] == 41
    assert [r.place for r in hits if r.query_id == 3] == list(range(1, 7))
    assert {r.query_id for r in hits} == {1, 3}
    guard = {r.query_id: r.weak for r in search.evidence(queries, search.search(df, queries)).collect()}
    assert guard == {1: False, 2: True, 3: True}


def test_nearest(spark: SparkSession) -> None:
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)] + [(200, None), (201, [1.0]), (202, [0.0] * 8)]
    rows.append((203, rows[0][1]))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    found = vectors.nearest(df, df.where("vec_id in (0, 7)"), 5).orderBy("query_id", "place").collect()
    assert [r.id for r in found if r.query_id == 0][:2] == [0, 203]

    def cos(a: list[float], b: list[float]) -> float:
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    best = sorted((-cos(rows[7][1], v), i) for i, v in rows if v and len(v) == 8 and any(v))[:5]
    assert [r.id for r in found if r.query_id == 7] == [i for _, i in best]


MESSAGES = [("s", k, "user" if k % 2 else "assistant", f"m{k}") for k in range(1, 12)] + [("s", 11, "user", "m11"), ("t", 1, "assistant", "a"), (None, 1, "user", "x"), ("u", 1, "user", None)]


def test_memory_in_batch_and_in_a_stream(spark: SparkSession, tmp_path: Path) -> None:
    df = spark.createDataFrame(MESSAGES, "session_id string, turn bigint, role string, content string")
    last = {(r.session_id, r.turn, r.back) for r in memory.last_turns(df).collect()}
    assert {t for s, t, _ in last if s == "s"} == set(range(4, 12))
    assert {(r.session_id, r.topic) for r in memory.last_user_topic(df).collect()} == {("s", "m11"), ("u", "")}
    asked = spark.createDataFrame([("s", "再讲讲它"), ("s", "plain"), ("t", "继续"), (None, "继续")], "session_id string, query string")
    assert sorted(r.resolved for r in memory.resolved_queries(asked, df).collect()) == sorted(["m11\n追问：再讲讲它", "plain", "继续", "继续"])
    for k in range(3):
        spark.createDataFrame(MESSAGES[k::3], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sessions.bounded_memory(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    final = {(r.session_id, r.turn, r.back) for r in spark.table("kept").collect()}
    assert last <= final


def test_files_are_ingested_as_they_arrive(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.MD").write_bytes("# 标题\n\n这里是足够长的一段课程资料，用来检查入库。".encode("gbk"))
    (tmp_path / "in" / "b.bin").write_bytes(b"no")
    for _ in range(2):
        sessions.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert [(r.title, r.chunk_no) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("标题", 1)]
    assert [r.text[:1] for r in uploads.scan_folder(spark, str(tmp_path / "in")).collect()] == ["#"]


def test_names_are_unique(spark: SparkSession) -> None:
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", "a-2", "c"])) for k in range(60)]
    taken = ["a", "a-3", "b-2", "x", "c-5", "c-6"]
    found = {r.id: r.name for r in uploads.unique_names(spark.createDataFrame(rows, "id int, stem string"), F.col("stem"), spark.createDataFrame([(t,) for t in taken], "name string"), ["id"]).where("stem <> 'a-2'").collect()}
    used = set(taken)
    for k, stem in rows:
        if stem == "a-2":
            continue
        name, n = stem, 1
        while name in used:
            n += 1
            name = f"{stem}-{n}"
        used.add(name)
        assert found[k] == name


def docx(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/></w:r></w:p>" for p in paragraphs)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/footer1.xml", xml.replace(paragraphs[0], "foot"))
    return out.getvalue()


def test_uploads(spark: SparkSession) -> None:
    import base64

    files = [("a.TXT", "中文".encode("gbk")), ("b.docx", docx("one", "one", "two")), ("c.docx", b"broken"), ("d.exe", b"x"), ("e.md", b"ab\xff"), (None, b"x")]
    rows = [(k, n, None, ("data:;base64," if k % 2 else "") + base64.b64encode(b).decode()) for k, (n, b) in enumerate(files)] + [(9, "f.txt", "t", "?"), (10, "g.txt", "t", None)]
    found = {r.id: (r.text, r.problem) for r in uploads.read_uploads(spark.createDataFrame(rows, "upload_id int, filename string, title string, content_base64 string")).collect()}
    assert found[0] == ("中文", None)
    assert found[1] == ("one\ntwo\nfoot\ntwo", None)
    assert found[2] == (None, "broken: BadZipFile")
    assert found[3] == found[5] == (None, "format")
    assert found[4] == ("ab", None)
    assert found[9] == found[10] == (None, "payload")


def test_study(spark: SparkSession) -> None:
    text = "Margins bound the error of the margin in every case we saw. Short one. 余弦距离 余弦距离 间隔"
    hits = spark.createDataFrame([(1, 1, "a.md", "s", "t", text, 0.5), (1, 2, "b.md", "s2", "cosine", text, 0.4), (1, 3, "a.md", "s", "t", None, 0.2)], "query_id int, place int, source string, section string, title string, text string, score double")
    queries = spark.createDataFrame([(1, "cosine"), (2, "x")], "query_id int, query string")
    assert [(r.n, len(r.point)) for r in study.key_points(hits).orderBy("n").collect()] == [(1, 59), (2, 59)]
    assert {r.source for r in study.focus_sources(hits, queries).collect()} == {"b.md"}
    assert study.source_summary(hits).first().sources == "a.md / s；b.md / s2；a.md / s"
    assert study.evidence_bullets(hits.where("text is not null")).count() == 1
    quiz = study.quiz(hits, queries.select("query_id", F.lit(2).alias("wanted"))).orderBy("n").collect()
    assert [q.answer for q in quiz] == ["A", "D"]
    assert all(re.sub(r"\W", "", q.options["ABCD".index(q.answer)]).startswith("Margins") for q in quiz)
    assert [list(r.focus) for r in study.review_plan(hits.limit(0), queries.where("query_id = 2")).orderBy("day").collect()][0] == list(study.PLAN_DEFAULT[:3])
    assert study.weak_points(hits, queries).count() == 2
    assert study.summaries(hits, queries).count() == 2
    best = spark.createDataFrame([(1, 7), (2, 8)], "query_id int, ord bigint")
    assert tuple(study.retrieval_quality(hits.withColumn("ord", F.lit(5).cast("bigint") + F.col("place")), best).first()) == (2, 0.5, 0.25)


def test_answers_from_a_stored_index(spark: SparkSession, tmp_path: Path) -> None:
    chunks = spark.createDataFrame([(k, f"id{k}", "d", f"t{k}", "RAG 架构" if k == 3 else "s", "f.md", f"检索增强生成 part {k} of the retrieval chain") for k in range(5)], "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    queries = spark.createDataFrame([(1, "s", "什么是检索增强生成？", 2), (2, "s", "再讲讲它", None), (3, None, None, 1)], "query_id bigint, session_id string, query string, top_k int")
    messages = spark.createDataFrame([("s", 1, "user", "总结 retrieval 的重点")], "session_id string, turn bigint, role string, content string")
    name, indexes = index_store.open_store(spark, chunks, str(tmp_path / "store"))
    assert name == "tfidf"
    found = {r.query_id: r for r in answer.answered(spark, chunks, queries, messages, indexes).collect()}
    assert sorted(found) == [1, 2]
    assert (found[1].intent, found[1].concept, found[1].hits) == ("concept_explain", "检索增强生成", 2)
    assert (found[2].intent, found[2].hits, found[2].weak) == ("summarize", 5, False)
    assert '"place":1,"id":"id3"' in found[1].citations
    name, store = index_store.open_store(spark, chunks, str(tmp_path / "store"), "vectors")
    assert name == "vectors"
    assert vectors.nearest(store, store.where("vec_id = 2"), 1).first().id == 2
    assert index_store.chat_content('{"choices": [{"message": {"content": "x"}}]}') == "x"
    assert index_store.chat_content("oops") is None
    assert index_store.hits_json(search.search(chunks, queries, indexes)).count() == 2


def test_terms_by_hash_are_those_of_the_spaces() -> None:
    rng = random.Random(4)
    texts = ["", "a", "--", "-a--b- -", "a  b　 c", "İß ŞA_9-é", "\n\n", "x\ty", "中文 中", *("".join(rng.choice("aB -_\n\t　中é") for _ in range(rng.randrange(60))) for _ in range(200))]
    for space, c in scan.term_hashes(texts).items():
        counts = [Counter(tfidf.SPACES[space](s)) for s in texts]
        rows = Counter(t for x in counts for t in x)
        assert sorted(c.n.tolist()) == sorted(rows.values()) and len(set(c.h.tolist())) == len(rows)
        assert sorted(zip(c.row.tolist(), c.tf.tolist(), strict=True)) == sorted((k, n) for k, x in enumerate(counts) for n in x.values())


def test_scans_give_the_hits_of_the_indexes(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(scan, "COMMON", 2)
    rng = random.Random(6)
    words = ["rag", "agent", "storage", "lock", "page", "数据库", "事务", "fault", "rank"]
    rows = [(k, f"{k}", "d", "title " + rng.choice(words), rng.choice(words), "s", None if k == 7 else " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(150)]
    chunks = spark.createDataFrame([*rows, *((k + 150, *r[1:]) for k, r in enumerate(rows[:60]))], "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    queries = spark.createDataFrame([(1, "rag page", 2), (2, "什么是事务", 12), (3, "lock rank storage", None), (4, "zzqq", 3), (5, None, 3)], "query_id bigint, query string, top_k int")
    terms = search.for_batch(chunks)
    assert isinstance(terms, scan.Terms)
    columns = ("query_id", "place", "ord", *(F.round(c, 9) for c in ("score", "vector_score", "keyword_score", "title_score")))
    one, other = (sorted(map(tuple, search.search(chunks, queries, x).select(*columns).collect())) for x in (terms, search.build(chunks)))
    assert one == other and {r[0] for r in one} == {1, 2, 3, 4}


def test_scores_where_few_terms_fit_into_memory(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("rag", "lock", "页面", "rank", "q") for b in range(30)]
    rows = [(k, f"{k}", "d", "title", rng.choice(words), "s", " ".join(rng.choice(words) for _ in range(1 + rng.randrange(25)))) for k in range(400)]
    chunks = spark.createDataFrame([*rows, *((k + 400, *r[1:]) for k, r in enumerate(rows[:90]))], "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    queries = search.prepared(spark.createDataFrame([(1, "rag7 page", 2), (2, "页面3 页面4", 12), (3, "lock1 rank2 q3", None), (4, "zz", 3)], "query_id bigint, query string, top_k int"))

    def found(x: object) -> list[tuple]:
        return sorted(map(tuple, search.vector_candidates(x, chunks, queries).select("query_id", "ord", F.round("vector_score", 9)).collect()))

    expected = found(search.build(chunks))
    for most, rows_most in ((400, 1_000_000), (60, 0), (0, 1_000_000)):
        monkeypatch.setattr(scan, "VOCAB_MOST", most)
        monkeypatch.setattr(scan, "ROWS_MOST", rows_most)
        terms = search.for_batch(chunks)
        assert isinstance(terms, scan.Terms) and terms.least > 2
        assert found(terms) == expected


def test_later_batches_use_the_norms_of_the_first(spark: SparkSession) -> None:
    rng = random.Random(12)
    words = ["rag", "agent", "storage", "lock", "page", "数据库", "事务", "İx", "rank"]
    chunks = spark.createDataFrame([(999 - k, f"{k}", "d", "title", rng.choice(words), "s", None if k == 7 else " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(300)], "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    first, second = ([(1, "rag page", 2), (2, "什么是事务", 12)], [(5, "İx storage 事务", None), (6, "lock zzqq rank", 3), (7, "zzqq", 1)])
    terms, other = search.for_batch(chunks, again=True), search.build(chunks)
    for rows in (first, second):
        queries = search.prepared(spark.createDataFrame(rows, "query_id bigint, query string, top_k int"))
        one, two = (sorted(map(tuple, search.vector_candidates(x, chunks, queries).select("query_id", "ord", F.round("vector_score", 9)).collect())) for x in (terms, other))
        assert one == two
        assert terms.norms[0].tolist() == list(range(700, 1000))


def test_equal_questions_and_terms_of_the_same_questions_are_weighed_once(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    t, q, w = np.array([3, 3, 5, 5, 8, 9, 9]), np.array([0, 2, 0, 2, 2, 0, 2]), np.array([1.0, 2, 1, 2, 2, 1, 1])
    term, group, begin, count = scan._grouped(t, q, w)
    assert [x.tolist() for x in (term, group, begin, count)] == [[3, 5, 8, 9], [0, 0, 1, 2], [0, 4, 5], [2, 1, 2]]
    scored = []
    monkeypatch.setattr(scan, "term_hashes", lambda x, *more, f=scan.term_hashes: scored.extend(x) or f(x, *more))
    rows = [(k, f"{k}", "d", "t", "s", "s", f"lock {'rank' if k % 3 else 'page'} {k % 7}") for k in range(60)]
    chunks = spark.createDataFrame(rows, "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    queries = search.prepared(spark.createDataFrame([(1, "lock rank", 1), (2, "page 5", 12), (3, "lock rank", 12), (4, "lock rank", None)], "query_id bigint, query string, top_k int"))
    one, two = (sorted(map(tuple, search.vector_candidates(x, chunks, queries).select("query_id", "ord", F.round("vector_score", 9)).collect())) for x in (search.for_batch(chunks), search.build(chunks)))
    assert one == two and Counter(r[0] for r in one) == {1: 24, 2: 48, 3: 48, 4: 24}
    assert sorted(scored) == ["lock rank", "page 5"]


def test_later_batches_use_bounded_norms_where_few_terms_fit(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(scan, "VOCAB_MOST", 60)
    rng = random.Random(13)
    words = [f"{a}{b}" for a in ("rag", "lock", "页面", "q") for b in range(20)]
    chunks = spark.createDataFrame([(499 - k, f"{k}", "d", "t", rng.choice(words), "s", " ".join(rng.choice(words) for _ in range(1 + rng.randrange(15)))) for k in range(200)], "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    terms, other = search.for_batch(chunks, again=True), search.build(chunks)
    for rows in ([(1, "rag7 page", 2), (2, "页面3", 12)], [(5, "lock1 q3", None), (6, "zz 页面4", 3), (7, "lock1 q3", 1)]):
        queries = search.prepared(spark.createDataFrame(rows, "query_id bigint, query string, top_k int"))
        one, two = (sorted(map(tuple, search.vector_candidates(x, chunks, queries).select("query_id", "ord", F.round("vector_score", 9)).collect())) for x in (terms, other))
        assert one == two
        assert terms.least > 2 and terms.norms[0].tolist() == list(range(300, 500)) and terms.norms[3].max() > 1


def tables(spark: SparkSession, folder: Path) -> str:
    rows = [(k, f"id{k}", "d", f"t{k % 5}", "s", "f.md", f"lock {'rank' if k % 3 else 'page'} {k % 7} 检索增强生成") for k in range(60)]
    spark.createDataFrame(rows, "ord bigint, id string, doc_id string, title string, section string, source string, text string").write.parquet(f"{folder}/chunk.parquet")
    asks = [(1, "lock rank", 1, "a"), (7, "总结 zzqq", 3, "b"), (99, "lock rank", 1, "b"), (100, "什么是检索增强生成", None, None), (101, None, 3, "a"), (250, "再讲讲它", 3, "a")]
    spark.createDataFrame(asks, "ask_id bigint, query string, top_k int, session_id string").write.parquet(f"{folder}/ask_request.parquet")
    spark.createDataFrame([("a", 1, "user", "page 5")], "session_id string, turn bigint, role string, content string").write.parquet(f"{folder}/session_message.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["cited_hits", "answers", "fallback_hits"])
def test_all_questions_are_searched(spark: SparkSession, tmp_path: Path, name: str) -> None:
    found = QUERIES[name](spark, tables(spark, tmp_path)).collect()
    assert {r.query_id for r in found} == {1, 7, 99, 100, 250}
    one, same = ([tuple(r)[1:] for r in sorted(found) if r.query_id == k] for k in (1, 99))
    assert one and one == same


def test_sql_of_cited_hits_has_all_questions_and_others_their_own() -> None:
    assert "% 100" not in SQL["cited_hits"] and all("query_id % 100 = 0" in SQL[n] for n in ("search_hits", "vector_top", "term_matches", "word_cosines"))


def test_others_of_one_set_of_terms_leave_out_the_candidates_of_each_query(spark: SparkSession) -> None:
    queries = [(5, ["lock", "rank"], 2), (6, ["rank", "lock"], 1), (7, ["page"], 3)]
    texts = ["lock rank", "rank", "page lock", "lock rank", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array(["lock", "", "", "", ""])], names=["ord", "text", "names"])
    held = np.array([0, 3, 4]), np.array([0, 1, 2])
    found = sorted((r["query_id"], r["ord"], r["keyword_score"]) for b in search._matches(queries, held)(iter([batch])) for r in b.to_pylist())
    assert found == [(5, 0, 1.0), (5, 1, 0.5), (5, 3, 1.0), (6, 0, 1.0), (6, 3, 1.0), (7, 2, 1.0)]


def test_later_batches_of_many_rows_keep_no_norms(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    assert scan.NORMS_MOST <= 1_000_000
    monkeypatch.setattr(scan, "NORMS_MOST", 50)
    rows = [(k, f"{k}", "d", "t", "s", "s", f"lock {'rank' if k % 3 else 'page'} {k % 7}") for k in range(60)]
    chunks = spark.createDataFrame(rows, "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    terms, other = search.for_batch(chunks, again=True), search.build(chunks)
    for ask in ("lock rank", "page 5 zz"):
        queries = search.prepared(spark.createDataFrame([(1, ask, 2)], "query_id bigint, query string, top_k int"))
        one, two = (sorted(map(tuple, search.vector_candidates(x, chunks, queries).select("query_id", "ord", F.round("vector_score", 9)).collect())) for x in (terms, other))
        assert one == two and terms.norms is None


def test_terms_are_held_once_in_a_worker() -> None:
    h = scan.ended(np.array([3, 1 << 40, (1 << 56) - 1], np.uint64))
    table = scan.Table(h)
    assert table.h is h and table.find(np.array([3, 4, 1 << 40, (1 << 56) - 1, (1 << 56) - 2], np.uint64)).tolist() == [0, -1, 1, 2, -1]


def test_scores_of_many_queries_are_added_up_row_by_row(spark: SparkSession, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(scan, "LONG", 1)
    rows = [(k, f"{k}", "d", "t", "s", "s", "" if k == 5 else f"lock {'rank' if k % 3 else 'page'} {k % 7}") for k in range(60)]
    chunks = spark.createDataFrame(rows, "ord bigint, id string, doc_id string, title string, section string, source string, text string")
    queries = search.prepared(spark.createDataFrame([(1, "lock rank", 2), (2, "page 5 zz", 12), (3, "yy", 1)], "query_id bigint, query string, top_k int"))
    one, two = (sorted(map(tuple, search.vector_candidates(x, chunks, queries).select("query_id", "ord", F.round("vector_score", 9)).collect())) for x in (search.for_batch(chunks), search.build(chunks)))
    assert one == two and {r[0] for r in one} == {1, 2, 3}
