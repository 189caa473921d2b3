"""SQL of the queries, for an engine whose regular expressions know no look-around."""

from __future__ import annotations

from .functions import text as T
from .operators import route, search
from .operators.answer import ASKED_ABOUT
from .operators.memory import REFERRING

W, B = T.SPACE, T.BLANK


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _unify(x: str) -> str:
    tail = r"'\n{3,}', chr(10) || chr(10), 'g')"
    inner = f"regexp_replace(regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), {tail}"
    return _strip(inner)


def _compact(x: str, n: int) -> str:
    line = _strip(f"regexp_replace({x}, '{W}+', ' ', 'g')")
    return f"CASE WHEN length({line}) <= {n} THEN {line} ELSE regexp_replace({line}[1:{n - 1}], '{W}+$', '') || '…' END"


def _stem(path: str) -> str:
    return f"regexp_replace(parse_filename({path}), '(.)\\.[^.]*$', '\\1')"


def _slug(path: str) -> str:
    s = f"lower(regexp_replace(regexp_replace({_stem(path)}, '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'))"
    return f"CASE WHEN {s} <> '' THEN {s} ELSE 'doc-' || sha1(parse_filename({path}))[1:10] END"


def _safe(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g')), '^-+|-+$', '', 'g')[1:80], ''), 'document')"


def _title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def _list(items: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _terms(x: str) -> str:
    return f"""list_filter(list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z][a-z0-9_\\-]+'), regexp_extract_all({x}, '[{T.HAN}]{{2,}}'),
        list_transform(regexp_extract_all({x}, '[A-Z]{{2,}}'), lambda s: lower(s)))), lambda t: NOT list_contains({_list(T.STOP_TERMS)}, t))"""


def _expanded(x: str) -> str:
    return x + " || " + " || ".join(f"CASE WHEN contains(lower({x}), '{k}') THEN ' {v}' ELSE '' END" for k, v in search.EXPANSIONS.items())


def _sentences(x: str) -> str:
    return f"""list_filter(list_transform(string_split_regex(regexp_replace({x}, '([。！？.!?]){W}+', '\\1' || chr(10), 'g'), '\\n+'),
        lambda s: {_strip(f"regexp_replace(s, '^[\\-*0-9.、{T.SPACES}]+', '')")}), lambda s: s <> '')"""


ASKED = "SELECT ask_id AS query_id, min(query) AS query, min(top_k) AS top_k, min(session_id) AS session_id FROM ask_request GROUP BY 1"
LINES = f"regexp_replace(u, '{T.LINE_ENDS}', chr(10), 'g')"
HEADS = f"list_filter(list_transform(string_split({LINES}, chr(10)), lambda l: {_strip('l')}), lambda l: starts_with(l, '#'))"
SECTIONS = f"""
    docs AS (SELECT path, doc_id, {_unify("text")} AS u FROM documents WHERE text IS NOT NULL),
    marked AS (SELECT path, doc_id, u, string_split(regexp_replace(chr(10) || {LINES}, '\\n{B}*(#[^\\n]*)', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM docs),
    each AS (SELECT path, doc_id, u, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS p FROM marked),
    cut AS (SELECT path, doc_id, u, i, CASE WHEN i = 1 THEN '' ELSE {_strip(f"regexp_replace({_strip("split_part(p, chr(2), 1)")}, '^#+', '')")} END AS title,
        CASE WHEN i = 1 THEN p ELSE split_part(p, chr(2), 2) END AS body FROM each),
    counted AS (SELECT *, count(*) FILTER (WHERE body <> '') OVER (PARTITION BY path, doc_id) AS held FROM cut),
    section AS (SELECT path, doc_id, row_number() OVER (PARTITION BY path, doc_id ORDER BY i) - 1 AS sec, title, body FROM (
        SELECT path, doc_id, i, title, {_strip("body")} AS body FROM counted WHERE held > 0 AND u <> '' AND {_strip("body")} <> ''
        UNION ALL SELECT DISTINCT path, doc_id, 1 AS i, '' AS title, u AS body FROM counted WHERE held = 0 OR u = ''))"""
PIECES = f"""
    para AS (SELECT path, doc_id, sec, title, list_filter(list_transform(string_split_regex(body, '\\n{W}*\\n'), lambda p: {_strip("p")}), lambda p: p <> '') AS ps FROM section),
    pack AS (
        SELECT path, doc_id, sec, title, ps, 0 AS i, '' AS now, CAST([] AS VARCHAR[]) AS done FROM para
        UNION ALL SELECT path, doc_id, sec, title, ps, i + 1,
            CASE WHEN length(j) <= 720 THEN j WHEN length(p) <= 720 THEN p ELSE '' END,
            CASE WHEN length(j) <= 720 THEN done ELSE list_concat(done, CASE WHEN now <> '' THEN [now] ELSE [] END,
                CASE WHEN length(p) <= 720 THEN [] ELSE list_transform(range(0, 1 + CAST(ceil((length(p) - 720) / 630.0) AS BIGINT)), lambda k: substring(p, k * 630 + 1, 720)) END) END
        FROM (SELECT *, ps[i + 1] AS p, CASE WHEN now = '' THEN ps[i + 1] ELSE now || chr(10) || chr(10) || ps[i + 1] END AS j FROM pack WHERE i < len(ps))),
    packed AS (SELECT path, doc_id, sec, title, CASE WHEN now <> '' THEN list_concat(done, [now]) ELSE done END AS done FROM pack WHERE i = len(ps)),
    piece AS (SELECT path, doc_id, sec, title, unnest(range(1, len(done) + 1)) AS k, unnest(done) AS piece FROM packed)"""
TITLE = f"CASE WHEN len({HEADS}) > 0 THEN {_strip(f"regexp_replace({HEADS}[1], '^#+', '')")} ELSE {_title_case(_strip(f"translate({_stem('path')}, '_-', '  ')"))} END"
INDEX_TEXT = "coalesce(title, '') || chr(10) || coalesce(section, '') || chr(10) || coalesce(text, '')"
WORDS = """list_filter(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_\\-]+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: w <> '')"""


def _word_terms(x: str) -> str:
    return f"(SELECT list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM (SELECT {WORDS.format(x=x)} AS ws))"


def _char_terms(x: str) -> str:
    s = f"regexp_replace(lower({x}), '{W}{{2,}}', ' ', 'g')"
    return f"(SELECT list_concat({', '.join(f'list_transform(range(1, greatest(1, length(s) - {n} + 2)), lambda i: substring(s, i, {n}))' for n in (2, 3, 4))}) FROM (SELECT {s} AS s))"


def _space(name: str, terms: object) -> str:
    """Common tables of one space: weights of chunks and of queries, norms, cosines."""
    return f"""
    {name}_tf AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({terms(INDEX_TEXT)}) AS term FROM chunk) GROUP BY 1, 2),
    {name}_v AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM chunk)) / (1 + count(*))) + 1 AS idf FROM {name}_tf GROUP BY 1),
    {name}_w AS (SELECT ord, term, (1 + ln(tf)) * idf AS w FROM {name}_tf JOIN {name}_v USING (term)),
    {name}_n AS (SELECT ord, sqrt(sum(w * w)) AS n FROM {name}_w GROUP BY 1),
    {name}_q AS (SELECT query_id, term, (1 + ln(tf)) * idf AS wq FROM (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({terms("full_query")}) AS term FROM q) GROUP BY 1, 2) JOIN {name}_v USING (term)),
    {name}_c AS (SELECT query_id, ord, dot / (qn * n) AS cosine FROM (SELECT query_id, ord, sum(w * wq) AS dot FROM {name}_w JOIN {name}_q USING (term) GROUP BY 1, 2)
        JOIN (SELECT query_id, sqrt(sum(wq * wq)) AS qn FROM {name}_q GROUP BY 1) USING (query_id) JOIN {name}_n USING (ord))"""


Q = f"""q AS (SELECT query_id, query, k, full_query, {_terms("full_query")} AS terms FROM (
        SELECT query_id, query, greatest(1, least(12, coalesce(top_k, 6))) AS k, {_expanded("query")} AS full_query FROM ({ASKED}) WHERE query_id % 100 = 0 AND query IS NOT NULL))"""
VECTOR = f"""
    score AS (SELECT query_id, ord, sum(s) AS v FROM (SELECT query_id, ord, 0.68 * cosine AS s FROM char_c UNION ALL SELECT query_id, ord, 0.32 * cosine FROM word_c) GROUP BY 1, 2),
    every AS (SELECT query_id, ord, max(v) AS v, any_value(k) AS k FROM (SELECT query_id, ord, v FROM score UNION ALL SELECT query_id, ord, 0.0 FROM q, (SELECT ord FROM chunk ORDER BY ord LIMIT 48)) JOIN q USING (query_id) GROUP BY 1, 2),
    vec AS (SELECT query_id, ord, v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, ord) AS place FROM every) WHERE place <= greatest(4 * k, 24))"""
HELD = "len(list_filter(terms, lambda t: contains(lower({x}), t) OR contains({x}, t)))"
NAMES = "coalesce(title, '') || ' ' || coalesce(section, '')"
MATCH = f"""
    match AS (SELECT query_id, ord, kw / len(terms) AS kw, least(1.0, tt / 3.0) AS tt FROM (
        SELECT query_id, ord, terms, {HELD.format(x="tx")} AS kw, {HELD.format(x="nm")} AS tt FROM (SELECT ord, coalesce(text, '') AS tx, {NAMES} AS nm FROM chunk), q WHERE len(terms) > 0) WHERE kw > 0 OR tt > 0)"""
HYBRID = """
    pool AS (SELECT query_id, ord, coalesce(v, 0) AS v, coalesce(kw, 0) AS kw, coalesce(tt, 0) AS tt, v IS NOT NULL AS is_vector FROM vec FULL JOIN match USING (query_id, ord)),
    blend AS (SELECT *, 0.72 * v + 0.20 * kw + 0.08 * tt AS s FROM pool JOIN q USING (query_id)),
    stage AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, is_vector DESC, round(v, 9) DESC, ord) AS first_place FROM blend) WHERE first_place <= greatest(3 * k, 10))"""
RERANK = f"""
    bonus AS (SELECT stage.*, chunk.id, doc_id, title, section, source, text, s + least(0.08, 0.015 * len(list_intersect(terms, {_terms("coalesce(text, '')")})))
        + CASE WHEN regexp_matches(lower(coalesce(section, '')), '{"|".join(search.STRUCTURE)}') THEN 0.04 ELSE 0 END AS score FROM stage JOIN chunk USING (ord)),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_place) AS place FROM bonus) WHERE place <= k)"""
EVERY_Q = Q.replace("query_id % 100 = 0 AND ", "")
SEARCH = f"WITH {Q}, {_space('char', _char_terms)}, {_space('word', _word_terms)}, {VECTOR}, {MATCH}, {HYBRID}, {RERANK}"
GIVEN = """SELECT h.*, c.id, c.doc_id, c.title, c.section, c.source, c.text FROM (SELECT ask_id AS query_id, hit_rank AS place, min(ord) AS ord, coalesce(min(score), 0) AS score FROM search_hit GROUP BY 1, 2) h
    JOIN chunk c USING (ord)"""
HIT_QUERIES = f"SELECT * FROM (SELECT DISTINCT ask_id AS query_id FROM search_hit) JOIN ({ASKED}) USING (query_id)"
TURNS = "SELECT DISTINCT session_id, turn, role, content FROM session_message WHERE session_id IS NOT NULL AND turn IS NOT NULL"
LAST = f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, role DESC NULLS LAST, content DESC NULLS LAST) AS back FROM ({TURNS})"
TOPIC = f"SELECT session_id, coalesce(content, '') AS topic FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY back) AS n FROM ({LAST}) WHERE back <= 8 AND role = 'user') WHERE n = 1"


def _concepts(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9_\\-]+|[{T.HAN}]{{2,8}}'), lambda c: NOT list_contains({_list(T.STOP_CONCEPTS)}, c))"


def _top_concepts(rows: str, key: str, most: int) -> str:
    return f"""SELECT id, concept, n, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, concept) AS place FROM (
        SELECT id, concept, count(*) AS n FROM (SELECT {key} AS id, unnest({_concepts("text")}) AS concept FROM ({rows}) WHERE text IS NOT NULL) GROUP BY 1, 2)) WHERE place <= {most}"""


def _concept_lists(places: int, most: int) -> str:
    return f"SELECT id AS query_id, list(concept ORDER BY place) AS c FROM ({_top_concepts(f'SELECT * FROM ({GIVEN}) WHERE place <= {places}', 'query_id', most)}) GROUP BY 1"


SENTENCES = f"SELECT query_id, place, source, section, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM (SELECT *, {_sentences('text')} AS ss FROM ({GIVEN}) WHERE text IS NOT NULL)"
KEY_POINTS = f"SELECT query_id, n, {_compact('sentence', 120)} AS point FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) AS n FROM ({SENTENCES}) WHERE length(sentence) >= 24) WHERE n <= 5"
WANTED = f"CASE WHEN regexp_extract(coalesce(query, ''), '(\\d+){W}*(道|个)?{W}*(选择题|判断题|练习题|题目|题)', 1) = '' THEN 5 ELSE least(10, greatest(1, try_cast(regexp_extract(query, '(\\d+){W}*(道|个)?{W}*(选择题|判断题|练习题|题目|题)', 1) AS INTEGER))) END"
CONCEPT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(query), '{n}')" for n in names) + f" THEN '{k}'" for k, names in route.CONCEPTS.items()) + " END"
TOPICS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(query), '{t}') THEN '{t}' END" for t in route.TOPICS) + ", CASE WHEN regexp_matches(query, '简历|岗位') THEN 'resume' END], lambda x: x IS NOT NULL)"
RULED = "CASE " + " ".join(f"WHEN regexp_matches({'lower(query)' if low else 'query'}, '{p}') THEN '{i}'" for i, low, p in route.RULES) + f" WHEN {CONCEPT} IS NOT NULL THEN 'concept_explain' END"
CARD_ROWS = "(VALUES " + ", ".join(f"({k}, '{i}', '{d}')" for k, (i, d) in enumerate(route.CARDS.items())) + ") AS card(n, intent, description)"
ROUTED = f"""WITH c_tf AS (SELECT n, intent, term, count(*) AS tf FROM (SELECT n, intent, unnest({_char_terms("description")}) AS term FROM {CARD_ROWS}) GROUP BY ALL),
    v AS (SELECT term, ln(11.0 / (1 + count(*))) + 1 AS idf FROM c_tf GROUP BY 1),
    w AS (SELECT n, intent, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY n)) AS norm FROM c_tf JOIN v USING (term)),
    qs AS (SELECT query_id, query FROM ({ASKED}) WHERE query IS NOT NULL),
    qw AS (SELECT query_id, term, tf * idf AS wq, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS qn FROM (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_char_terms("query")}) AS term FROM qs) GROUP BY 1, 2) JOIN v USING (term)),
    sc AS (SELECT query_id, n, intent, sum(w * wq / (norm * qn)) AS score FROM qw JOIN w USING (term) GROUP BY ALL),
    best AS (SELECT query_id, intent AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, n) AS r FROM sc) WHERE r = 1),
    chosen AS (SELECT query_id, query, coalesce({RULED}, nearest, 'rag_answer') AS intent FROM qs LEFT JOIN best USING (query_id))
    SELECT query_id, query, intent, round(coalesce(score, 0), 6) AS confidence FROM chosen LEFT JOIN sc USING (query_id, intent)"""
STEP = f"(?:^|{W})\\d+[.、．]{W}*([^。；;]{{12,120}})"
STEPS = f"list_filter(list_transform(regexp_extract_all(regexp_replace(text, '{W}+', ' ', 'g'), '{STEP}', 1), lambda s: {_compact('s', 110)}), lambda s: NOT regexp_matches(s, '{'|'.join(T.STEP_NOISE)}'))"
MARKED = _strip(f"regexp_replace(text, '{W}+', ' ', 'g')")
STARTS, STOPS = _list(("实验原理", "Lab principle", "Procedure")), _list(("操作步骤", "思考题", "Questions", "##"))
PAYLOAD = f"regexp_replace(CASE WHEN starts_with(lower({_strip('content_base64')}), 'data:') AND contains(content_base64, ',') THEN content_base64[strpos(content_base64, ',') + 1:] ELSE content_base64 END, '[\\r\\n]', '', 'g')"

ABOUT = "coalesce(" + ", ".join(f"CASE WHEN length({x}) BETWEEN 1 AND 30 THEN {x} END" for x in (f"regexp_replace(regexp_extract(query, '{p}', 1), '^[ ？?。]+|[ ？?。]+$', '', 'g')" for p in ASKED_ABOUT)) + ")"
SQL = {
    "asked_concepts": f"SELECT query_id, {ABOUT} AS concept FROM ({ASKED}) WHERE query IS NOT NULL",
    "explanations": f"""WITH f AS (SELECT id AS query_id, concept AS first FROM ({_top_concepts(f"SELECT * FROM ({GIVEN}) WHERE place = 1", "query_id", 1)})),
        e AS (SELECT query_id, {_compact("t", 420)} AS evidence FROM (SELECT query_id, string_agg(coalesce(text, ''), ' ' ORDER BY place) AS t FROM ({GIVEN}) WHERE place <= 3 GROUP BY 1)),
        b AS (SELECT DISTINCT query_id FROM ({GIVEN}) WHERE place = 1)
        SELECT query_id, coalesce({ABOUT}, first, CASE WHEN b.query_id IS NOT NULL THEN '' END, '该概念') AS concept, coalesce(evidence, '') AS evidence
        FROM ({HIT_QUERIES}) LEFT JOIN f USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN b USING (query_id)""",
    "normalize_documents": f"SELECT doc_id, {_unify('text')} AS text FROM documents",
    "document_ids_titles": f"SELECT doc_id, {_slug('path')} AS slug, CASE WHEN u IS NOT NULL THEN {TITLE} ELSE {_title_case(_strip(f"translate({_stem('path')}, '_-', '  ')"))} END AS heading FROM (SELECT *, {_unify('text')} AS u FROM documents)",
    "document_sections": f"WITH {SECTIONS} SELECT doc_id, sec, title, body FROM section",
    "chunk_documents": f"""WITH RECURSIVE {SECTIONS}, {PIECES},
        kept AS (SELECT path, title, {_strip("piece")} AS text, row_number() OVER (PARTITION BY path ORDER BY sec, k) AS n FROM piece WHERE length({_strip("piece")}) >= 20),
        named AS (SELECT path, {_slug("path")} AS slug, {TITLE} AS heading FROM docs)
        SELECT path, n AS chunk_no, slug || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id, slug AS doc_id,
            CASE WHEN title = '' THEN heading ELSE title END AS section, parse_filename(path) AS source, text FROM kept JOIN named USING (path)""",
    "paragraph_windows": "SELECT ord, n, substring(text, n * 260 + 1, 300) AS piece FROM (SELECT ord, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 300) / 260.0) AS BIGINT)))) AS n FROM chunk WHERE text <> '')",
    "chunk_ordinals": "SELECT path, row_number() OVER (ORDER BY path) - 1 AS ord FROM documents",
    "dedupe_adjacent_lines": f"""SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i] <> l[i - 1]), lambda i: l[i]), chr(10)), '') AS text
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_strip(f"regexp_replace(s, '{W}+', ' ', 'g')")}), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL)""",
    "kb_stats": "SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(DISTINCT section) AS sections FROM chunk",
    "kb_documents": """SELECT doc_id, arg_min(coalesce(title, chr(0)), ord) AS title, arg_min(source, ord) AS source, count(*) AS chunks, coalesce(array_to_string(list_sort(list(DISTINCT section) FILTER (WHERE section IS NOT NULL)), '|'), '') AS sections, min(ord) AS first_ord
        FROM chunk GROUP BY 1""".replace("arg_min(coalesce(title, chr(0)), ord) AS title", "nullif(arg_min(coalesce(title, chr(1)), ord), chr(1)) AS title"),
    "search_terms": f"SELECT ord, coalesce(array_to_string(list_sort({_terms('text')}), '|'), '') AS terms FROM chunk WHERE text IS NOT NULL",
    "compact_texts": f"SELECT ord, {_compact('text', 220)} AS snippet FROM chunk WHERE text IS NOT NULL",
    "expanded_queries": f'SELECT query_id, {_expanded("query")} AS "full" FROM ({ASKED}) WHERE query IS NOT NULL',
    "requested_counts": f"SELECT query_id, {WANTED} AS wanted FROM ({ASKED}) WHERE query IS NOT NULL",
    "detected_topics": f"SELECT query_id, CASE WHEN len({TOPICS}) > 0 THEN array_to_string({TOPICS}, '|') ELSE 'knowledge_base' END AS topics, {CONCEPT} AS concept FROM ({ASKED}) WHERE query IS NOT NULL",
    "routed_intents": ROUTED,
    "word_idf": f"WITH {Q}, {_space('word', _word_terms)} SELECT term, df, round(idf, 6) AS idf FROM word_v",
    "char_idf": f"WITH {Q}, {_space('char', _char_terms)} SELECT term, df, round(idf, 6) AS idf FROM char_v",
    "word_norms": f"WITH {Q}, {_space('word', _word_terms)} SELECT ord, round(n, 6) AS norm FROM word_n",
    "word_cosines": f"WITH {Q}, {_space('word', _word_terms)} SELECT query_id, ord, round(cosine, 6) AS cosine FROM word_c",
    "vector_top": f"WITH {Q}, {_space('char', _char_terms)}, {_space('word', _word_terms)}, {VECTOR} SELECT query_id, ord, round(v, 6) AS vector_score FROM vec",
    "term_matches": f"WITH {Q}, {MATCH} SELECT query_id, ord, round(kw, 6) AS keyword_score, round(tt, 6) AS title_score FROM match",
    "search_hits": f"{SEARCH} SELECT query_id, place, ord, round(score, 6) AS score, round(v, 6) AS vector_score, round(kw, 6) AS keyword_score, round(tt, 6) AS title_score FROM hits",
    "cited_hits": f"""{SEARCH.replace(Q, EVERY_Q)} SELECT query_id, place, id, doc_id, title, section, source, round(score, 4) AS score, round(v, 4) AS vector_score, round(kw, 4) AS keyword_score, round(tt, 4) AS title_score,
        {_compact("text", 220)} AS snippet FROM hits WHERE place <= 4""",
    "evidence_guard": f"SELECT query_id, coalesce(h, 0) AS hits, round(t, 6) AS top_score, coalesce(t, 0) < 0.055 AS weak FROM (SELECT DISTINCT ask_id AS query_id FROM ask_request) LEFT JOIN (SELECT query_id, count(*) AS h, max(score) AS t FROM ({GIVEN}) GROUP BY 1) USING (query_id)",
    "nearest_vectors": """SELECT query_id, id, round(s, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS place FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE place <= 10""",
    "session_last8": f"SELECT * FROM ({LAST}) WHERE back <= 8",
    "session_recent4": f"SELECT * FROM ({LAST}) WHERE back <= 4",
    "last_user_topic": TOPIC,
    "topic_before": f"SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn, role NULLS LAST, content NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({TURNS})",
    "resolved_queries": f"""SELECT query_id, session_id, CASE WHEN regexp_matches(query, '{"|".join(REFERRING)}') AND topic IS NOT NULL THEN topic || chr(10) || '追问：' || query ELSE query END AS resolved
        FROM ({ASKED}) LEFT JOIN (SELECT * FROM ({TOPIC}) WHERE topic <> '') USING (session_id)""",
    "top_concepts": _top_concepts("SELECT doc_id, text FROM chunk", "doc_id", 12),
    "chunk_sentences": f"SELECT ord, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT ord, {_sentences('text')} AS s FROM chunk WHERE text IS NOT NULL)",
    "key_points": KEY_POINTS,
    "quiz_questions": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) AS n FROM ({SENTENCES}) JOIN (SELECT query_id, {WANTED} AS wanted FROM ({HIT_QUERIES})) USING (query_id) WHERE length(sentence) BETWEEN 35 AND 320),
        k AS (SELECT *, (n - 1) % 4 AS shift FROM s WHERE n <= wanted),
        c AS (SELECT query_id, n, arg_min(concept, (-m, concept)) AS concept FROM (SELECT query_id, n, concept, count(*) AS m FROM (SELECT query_id, n, unnest({_concepts("sentence")}) AS concept FROM k) GROUP BY ALL) GROUP BY ALL),
        o AS (SELECT k.*, coalesce(concept, '该知识点') AS concept, ['A', 'D', 'C', 'B'][shift + 1] AS answer FROM k LEFT JOIN c USING (query_id, n)),
        p AS (SELECT *, [{_compact("sentence", 90)}, concept || ' 与召回资料中的课程内容无关', concept || ' 只需要记住名词，不需要理解作用和边界', concept || ' 无法通过知识库定位到来源片段'] AS os FROM o)
        SELECT query_id, n, '关于“' || concept || '”，下列说法哪一项最符合资料内容？' AS question, array_to_string(list_concat(os[shift + 1:], os[:shift]), '|') AS options, answer,
            answer || ' 来自召回资料，可回看 ' || source || ' / ' || section || '；其余选项是干扰项。' AS explanation FROM p""",
    "focus_sources": f"""WITH h AS (SELECT g.*, q.query FROM ({GIVEN}) g JOIN ({HIT_QUERIES}) q USING (query_id)),
        t AS (SELECT query_id, source, sum(score + CASE WHEN len(list_filter(regexp_extract_all(coalesce(query, ''), '[A-Za-z][A-Za-z0-9_\\-]+|[{T.HAN}]{{2,}}'), lambda w: contains(lower(coalesce(title, '') || ' ' || coalesce(source, '')), lower(w)))) > 0 THEN 0.4 ELSE 0 END) AS total, min(place) AS seen FROM h GROUP BY 1, 2),
        b AS (SELECT query_id, source AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, seen) AS n FROM t) WHERE n = 1)
        SELECT query_id, place, ord, source FROM h JOIN b USING (query_id) WHERE source IS NOT DISTINCT FROM best""",
    "source_summaries": f"SELECT query_id, coalesce(string_agg(source || ' / ' || section, '；' ORDER BY place), '') AS sources FROM ({GIVEN}) WHERE place <= 3 AND score >= 0.055 GROUP BY 1",
    "evidence_bullets": f"""SELECT query_id, n, '- ' || snippet || '（来源：' || source || ' / ' || section || '）' AS bullet FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, snippet ORDER BY place) AS r FROM (SELECT query_id, place, source, section, {_compact("text", 150)} AS snippet FROM ({GIVEN}) WHERE text IS NOT NULL)) WHERE r = 1) WHERE n <= 3""",
    "review_plans": f"""WITH c AS (SELECT query_id, coalesce(c, ['核心概念', '关键流程', '典型题型', '错题复盘']) AS c FROM ({HIT_QUERIES}) LEFT JOIN ({_concept_lists(6, 12)}) USING (query_id))
        SELECT query_id, 1 AS day, array_to_string(c[1:3], '|') AS focus FROM c UNION ALL SELECT query_id, 2, array_to_string(CASE WHEN len(c) > 3 THEN c[4:6] ELSE c[1:3] END, '|') FROM c
        UNION ALL SELECT query_id, 3, '错题原因|相似题训练|复述总结' FROM c""",
    "weak_points": f"SELECT query_id, array_to_string(coalesce(c, ['资料理解不完整', '概念边界不清晰']), '|') AS points FROM ({HIT_QUERIES}) LEFT JOIN ({_concept_lists(5, 5)}) USING (query_id)",
    "summaries": f"""SELECT query_id, points, array_to_string(c, '|') AS concepts, sections FROM ({HIT_QUERIES}) LEFT JOIN (SELECT query_id, string_agg(point, '|' ORDER BY n) AS points FROM ({KEY_POINTS}) GROUP BY 1) USING (query_id)
        LEFT JOIN ({_concept_lists(5, 8)}) USING (query_id) LEFT JOIN (SELECT query_id, coalesce(string_agg(section, '|' ORDER BY place), '') AS sections FROM ({GIVEN}) WHERE place <= 4 GROUP BY 1) USING (query_id)""",
    "numbered_steps": f"SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(range(1, len(g) + 1), lambda i: list_position(g, g[i]) = i)[1:7], lambda i: g[i]), '|'), '') AS steps FROM (SELECT doc_id, {STEPS} AS g FROM documents WHERE text IS NOT NULL)",
    "between_markers": f"""WITH l AS (SELECT doc_id, {MARKED} AS l FROM documents WHERE text IS NOT NULL),
        a AS (SELECT *, list_min(list_filter(list_transform({STARTS}, lambda m: strpos(l, m)), lambda p: p > 0)) AS a FROM l),
        b AS (SELECT *, list_min(list_filter(list_transform({STOPS}, lambda m: CASE WHEN strpos(l[a + 1:], m) > 0 THEN a + strpos(l[a + 1:], m) ELSE 0 END), lambda p: p > 0)) AS b FROM a),
        c AS (SELECT doc_id, a, substring(l, a, coalesce(b, a + 420) - a) AS c FROM b)
        SELECT doc_id, CASE WHEN a IS NULL THEN '' ELSE {_compact("c", 420)} END AS part FROM c""",
    "retrieval_quality": f"""WITH h AS ({GIVEN}), b AS (SELECT query_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place) AS r FROM h) WHERE r = 1),
        f AS (SELECT query_id, min(place) AS place FROM h JOIN b USING (query_id, ord) WHERE place <= 6 GROUP BY 1)
        SELECT count(*) AS queries, round(avg(CASE WHEN place IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr FROM b LEFT JOIN f USING (query_id)""",
    "upload_payloads": f"SELECT upload_id, CASE WHEN regexp_matches({PAYLOAD}, '^([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?$') THEN octet_length(from_base64({PAYLOAD})) END AS bytes FROM upload_request",
    "safe_file_names": f"SELECT upload_id, {_safe('filename')} AS name FROM upload_request",
    "valid_documents": "SELECT request_id, coalesce(length(title), 0) BETWEEN 1 AND 120 AND coalesce(length(content), 0) >= 20 AND coalesce(length(source), 0) <= 120 AS valid FROM doc_request",
    "added_documents": f"SELECT request_id, '# ' || title || chr(10) || chr(10) || {_strip('content')} || chr(10) AS body FROM doc_request WHERE length(title) BETWEEN 1 AND 120 AND length(content) >= 20 AND coalesce(length(source), 0) <= 120",
    "delete_documents": f"""WITH d AS (SELECT path, title, {_slug("path")} AS slug FROM documents), g AS (SELECT slug, min(path) AS path FROM d WHERE slug IN (SELECT slug FROM d WHERE title IS NULL) GROUP BY 1)
        SELECT path FROM d WHERE (slug, path) NOT IN (SELECT slug, path FROM g)""",
}
