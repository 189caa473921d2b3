"""Template residue and error-page text (problem 8): partitioned SimHash tables and labels that spread through connected components.

1. Documents are taken in *units*, lines, or sentences of long lines.  Names, numbers and unfilled places are masked, so that units made from one template
   become alike; equal units, however many, are one from here on.
2. A unit's features are its words and, of Chinese, its pairs of characters.  Their SimHash of 64 bits is kept in BANDS tables, one for each band of its
   bits.  Two units whose SimHashes differ in at most MISSED bits, and most that differ in some more, have a band in common that differs in FLIPS bits at most.
3. Trusted labels start the search: units that follow a rule for unfilled places or for filler, and units of a given list of well-known messages.
4. Labels spread: each new labelled unit probes the tables with its bands and all changes of up to FLIPS bits of them; units found are held against it by Hamming
   distance, then by the resemblance of their features.  The next round starts from the newly labelled ones, until there are none: every unit of a
   connected component with a trusted unit is labelled then.  Pairs of units without label are never made.
5. A document with a labelled unit holds residue.

Resemblance is of sets of words and characters, LEAST or more, not of shingles of five words: messages of five to eight words in which one differs would
have none of those in common.

Defined results
    Null, empty and blank documents hold no residue.  Repeated documents give their id once.  Documents and lines of any length are taken whole.  An empty table
    gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut

BANDS, WIDTH, FLIPS = 4, 16, 2
#: Differing bits up to which two units surely meet; greatest number that is looked into; least resemblance.
MISSED, MOST, LEAST = (FLIPS + 1) * BANDS - 1, 16, 0.65
#: Lines longer than this are taken by sentences.
LONG = 240
SALTS = 16
BROADCAST_ROWS = 1_000_000

LINES = re.compile(r"[\r\n\x0b\x0c\x85  ]+")
SENTENCES = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+")
LEAD = re.compile(r"^(?:[\s>#*•·\-+]+|\d{1,3}[.、)]\s*|[（(]\d{1,3}[)）]\s*)+")
HAN = re.compile(r"[㐀-鿿]")
NAME = re.compile(r"(?<![^\W_])[A-Z][a-zß-ÿ]+(?:[_-]\d+)?(?:\.[a-z]{2,4})?(?!\w)")
SMALL = re.compile(r"(?<![^\W_])[a-zß-ÿ]{2,}(?!\w)")
NUMBER = re.compile(r"[0-9a-f]*\d[0-9a-f.,:]*")
FEATURE = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+|[\x00@]")

#: Forms of places that a template leaves to be filled.
SLOT = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|[$#]\{[^{}\n]{1,60}\}|<%=?[^%\n]{0,60}%>|%[^\W\d][\w.]{1,40}%|\[\[[^\[\]\n]{1,60}\]\]|@@[^@\n]{1,60}@@|__[A-Z][A-Z_]{1,40}__"
    r"|<(?:insert|enter|your|add|fill in|nom|name|hier|insérer)\b[^<>\n]{0,60}>|<[^<>\n]{0,20}(?:填写|填入|待补充)[^<>\n]{0,20}>|(?<![A-Za-z0-9$#{])\{[^\W\d][^{}\n:;=()\"']{1,40}\}"
    r"|[（(\[【](?:此处|在此|请在此|待)[^()（）\n]{0,30}[）)\]】]|X{2,}年X{1,}月(?:X{1,}日)?|X{2,}[/.-]X{2,}[/.-](?:20)?X{2,}|(?<![A-Za-z])(?:TBD|TODO|FIXME|TBA)(?![A-Za-z])|待补充|待填写"
    r"|×{2,}|(?<![A-Za-z])(?i:change[ _-]?me|your (?:title|name|text|content)(?: goes)? here|(?:insert|add|enter) (?:title|name|text|content) here)(?![A-Za-z])"
    r"|«[^\W\d]\w*[._]\w+»|«[一-鿿]{2,12}»|<[A-Z][A-Z_]{2,30}>|<[一-鿿]{2,12}>"
)
#: A label or a greeting with nothing but a bracketed word behind it.
LABEL = re.compile(r"(?:[^\W\d_][^:：\n]{0,16}[:：]|Welcome to|Dear|Hallo|Bonjour|Liebe[r]?|欢迎选修|欢迎|尊敬的)\s*(?:\[[^\W\d][^\[\]\n]{1,40}\]|【[^\W\d][^【】\n]{1,40}】|__[^\W\d][\w.]{1,40}__|<[^\W\d][^<>\n]{1,40}>|«\s?[^\W\d][^«»\n]{1,40}»|\{[^\W\d][^{}\n]{1,40}\})[.!。！]?")
#: Filler that says one thing over and over.
AGAIN = re.compile(r"(\D{2,18}?)\1{4,}.{0,18}")
#: Characters without which there is no unfilled place.
OPEN = re.compile(r"[\[\]{}<>«»%@_（(【]|××|XX|TBD|TODO|FIXME|TBA|待补充|待填写|(?i:change[ _-]?me| here)")
#: Beginnings of the words of the usual filler text.
FILLER = frozenset("lore ipsu dolo sit amet cons sadi adip elit sed diam nonu eirm temp invi ut labo et magn aliq erat volu at vero eos accu just duo duor ea rebu stet clit kasd gube no sea taki sanc est eosa".split())

#: Messages of servers and viewers, notices that scripts are needed, and texts of unfilled slides, as trusted examples.
MESSAGES = """
You need to enable JavaScript to run this app.
Please enable JavaScript to continue using this application.
Please enable JavaScript to view this page.
JavaScript is disabled in your browser. Please enable it.
JavaScript is disabled. This page cannot be displayed.
JavaScript is required to view this content.
This site requires JavaScript to be enabled.
This viewer requires scripts.
Turn scripting on in your browser, then reload the page.
This viewer requires scripts. Turn scripting on in your browser, then reload the page.
If nothing appears, check that JavaScript and cookies are allowed.
Your browser does not support scripts.
<noscript>JavaScript is disabled. This page cannot be displayed.</noscript>
Veuillez activer JavaScript pour afficher cette page.
Veuillez activer JavaScript pour afficher le cours Nom.
Bitte JavaScript aktivieren, um diese Seite anzuzeigen.
Bitte JavaScript aktivieren, um Name anzuzeigen.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
请启用 JavaScript 后刷新页面以查看内容。
请启用 JavaScript 后刷新页面以查看 Name 讲义。
您的浏览器禁用了脚本或版本过低，无法显示本页。
您的浏览器禁用了脚本或版本过低，无法显示“Name”。
您的浏览器不支持脚本，请更换浏览器。
本页面需要启用脚本才能正常显示。
400 Bad Request
401 Unauthorized
403 Forbidden
404 Not Found
500 Internal Server Error
Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
upstream closed the connection
The requested URL was not found on this server.
The requested document was not found on this server.
The requested document Name.md was not found on this server.
The page you are looking for does not exist.
The server encountered an internal error and was unable to complete your request.
The worker met an unexpected condition.
The export worker Name met an unexpected condition.
The export worker Name met an unexpected condition. Code 500.
Service temporarily unavailable
Service temporarily unavailable – maintenance window. Please come back later.
Service temporarily unavailable – maintenance window Name. Please come back later.
Request timed out after 30 s while loading the page.
Request timed out after 30 s while loading Name.
Access denied. You do not have permission to view this page.
Access denied. You do not have permission to view “Name”.
You do not have permission to access this resource.
Your session has expired. Please sign in again.
Too many requests. Please try again later.
Too many requests. Your quota resets in 6 minutes.
Too many requests. Your quota for Name resets in 6 minutes.
Oops! Something went wrong.
Something went wrong. Please try again later.
We could not load this page. Try refreshing the page.
We could not load Name. Try refreshing the page.
Traceback (most recent call last):
{"error": "not_found", "detail": "no item for Name", "trace": "0"}
{"error": "not_found", "detail": "no chunk for Name", "trace": "0"}
{"error": "internal_error", "message": "unexpected condition"}
{"detail": "Not Found"}
正在加载……若长时间无响应，请检查脚本设置。
正在加载Name……若长时间无响应，请检查脚本与 Cookie 设置。
页面不存在（404）
您访问的页面不存在。
您访问的页面已被删除或移动，请返回首页。
您访问的资料“Name”已被删除或移动，请返回首页。
服务器内部错误，请稍后再试。
服务器繁忙，请稍后再试。
您没有权限查看该课程，请先登录后重试。
您没有权限查看该课程，请先登录后重试。（会话 0 已过期）
您没有权限访问该页面，请先登录。
会话已过期，请重新登录。
验证码错误，请重新输入。
系统维护中，资料库暂停访问，敬请谅解。
系统维护中，Name 资料库暂停访问，敬请谅解。
导出失败：解析超时，未返回内容。
导出失败：资料 Name 解析超时，53 秒内未返回内容。
网络连接超时，请刷新页面重试。
页面加载失败，请刷新重试。
La page demandée est introuvable.
La page que vous cherchez n'existe pas.
Accès refusé. Vous n'avez pas la permission de consulter cette page.
Erreur interne du serveur.
Service momentanément indisponible, veuillez réessayer plus tard.
Die angeforderte Seite wurde nicht gefunden.
Die Seite konnte nicht gefunden werden.
Zugriff verweigert. Sie haben keine Berechtigung für diese Seite.
Interner Serverfehler. Bitte versuchen Sie es später erneut.
Click to edit Master title style
Click to edit Master text styles
Edit master styles
Click to add title
Click to add text
Click to add subtitle
单击此处编辑母版标题样式
单击此处编辑母版样式
单击此处编辑母版文本样式
单击此处添加标题
点击添加标题
点击添加文本
点击此处添加文字
这里是正文内容占位
此处为正文内容占位文字
请在此处输入正文内容
请在这里输入您的内容
请输入内容
Cliquez pour ajouter un titre
Titel durch Klicken hinzufügen
""".strip().splitlines()


def units(text: str) -> list[str]:
    """The units of a text, without marks of lists and headings; lines of code fences are units too."""
    out = []
    for line in LINES.split(text):
        for part in SENTENCES.split(line) if len(line) > LONG else (line,):
            part = LEAD.sub("", part).strip()
            if part:
                out.append(part)
    return out


def masked(unit: str) -> str:
    """A unit in lower case, unfilled places as ``\\0``, names as ``@``, numbers left out.  Of a few words, none is taken for a name."""
    if OPEN.search(unit):
        unit = SLOT.sub("\0", unit)
    if HAN.search(unit):
        unit = NAME.sub("@", unit)
    elif len(SMALL.findall(unit)) >= 3:
        first = re.match(r"\W*\w+", unit)
        at = first.end() if first else 0
        unit = unit[:at] + NAME.sub("@", unit[at:])
    return NUMBER.sub("", unit.lower())


@lru_cache(1 << 20)
def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature)


def features(mask: str) -> frozenset[str]:
    out = set()
    for x in FEATURE.findall(mask):
        if "㐀" <= x[0] <= "鿿":
            out.update(map("".join, zip(x, x[1:], strict=False)) if len(x) > 1 else x)
        else:
            out.add(x)
    return frozenset(out)


def trusted(unit: str) -> bool:
    """Whether a unit is residue by rule: a short line with an unfilled place that no code, quotation or sentence surrounds, or filler."""
    if len(unit) <= 80 and OPEN.search(unit) and LABEL.fullmatch(unit):
        return True
    found = len(unit) <= 80 and OPEN.search(unit) and SLOT.search(unit)
    if found and not re.search(r"[`“”\"‘’]|</?\w+>|[;=]\s*$", SLOT.sub("", unit)):
        rest = SLOT.sub(" ", unit)
        if len(HAN.findall(rest)) <= 12 and len(re.findall(r"[^\W\d_㐀-鿿]+", rest)) <= 8 and not re.search(r"[，,][^\n]{6,}", rest):
            return True
    again = AGAIN.fullmatch(unit)
    if again and len(set(filter(str.isalpha, again[1]))) > 1:
        return True
    if not unit[:32].isascii():
        return False
    words = re.findall(r"[a-z]+", unit.lower())
    if len(words) >= 4 and sum(w[:4] in FILLER for w in words) >= 0.7 * len(words):
        return sum(w[:4] in FILLER and len(w) > 3 for w in words) >= 3
    return False


def keys_and_simhashes(sets: list[frozenset[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The key and the 64-bit SimHash of each set of features; equal sets have equal keys."""
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([max(len(s), 1) for s in sets])
    flat = np.fromiter((h for s in sets for h in (map(_hash, s) if s else (0,))), np.uint64, int(size.sum()))
    ends = np.cumsum(size)
    keys = np.add.reduceat((flat ^ flat >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93), ends - size)
    out = np.empty(len(sets), np.uint64)
    at = 0
    while at < len(sets):  # in turns of bounded size
        begin = ends[at] - size[at]
        to = max(int(np.searchsorted(ends, begin + (1 << 18), "right")), at + 1)
        bits = np.unpackbits(flat[begin : ends[to - 1]].view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, ends[at:to] - size[at:to] - begin, axis=0, dtype=np.int32)
        out[at:to] = np.packbits(2 * sums > size[at:to, None], axis=1).view(np.uint64).reshape(-1)
        at = to
    return keys.view(np.int64), out.view(np.int64)


def _units(messages: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            rows, sets, masks, sure = [], [], [], []
            for r, s in enumerate(b.column(1).to_pylist()):
                for unit in units(s or ""):
                    mask = masked(unit)
                    f = features(mask)
                    if f:
                        rows.append(r), sets.append(f), masks.append(mask), sure.append(trusted(unit))
            keys, sims = keys_and_simhashes(sets)
            given = np.array(sure, bool) | np.isin(keys, messages)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys), pa.array(sims), pa.array(masks, pa.string()), pa.array(given)], names=["doc_id", "key", "sim", "mask", "sure"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            a, c = features(x), features(y)
            keep.append(len(a & c) >= LEAST * len(a | c))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["key"])


def _bands(df: DataFrame) -> DataFrame:
    """Rows of the tables: ``(band, key, sim)``."""
    each = F.array(*(F.shiftrightunsigned("sim", k * WIDTH).bitwiseAND((1 << min(WIDTH, 64 - k * WIDTH)) - 1).bitwiseOR(k << WIDTH) for k in range(BANDS)))
    return df.select(F.explode(each.cast("array<int>")).alias("band"), "key", "sim")


def _changes() -> list[int]:
    """All changes of up to FLIPS bits of a band."""
    return [sum(1 << i for i in bits) for n in range(FLIPS + 1) for bits in itertools.combinations(range(WIDTH), n)]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; beyond that, joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_units(found: DataFrame, messages: list[str]) -> DataFrame:
    """``(key)`` of the units that a trusted label reaches.  ``found`` is a table of units that was cut."""
    spark = found.sparkSession
    tables = _bands(found.select("key", "sim").distinct())
    given = [masked(m) for m in messages]
    rows = [(int(k), int(h), m) for k, h, m in zip(*keys_and_simhashes([features(m) for m in given]), given, strict=True)]
    trust = spark.createDataFrame(rows, "key bigint, sim bigint, mask string")
    front = cut(found.where("sure").groupBy("key").agg(F.first("sim").alias("sim"), F.first("mask").alias("mask")).unionByName(trust).dropDuplicates(["key"]))
    labelled = front.select("key")
    while True:
        probe = _bands(front.select("key", "sim")).select(F.explode(F.transform(F.array(*map(F.lit, _changes())), lambda x: F.col("band").bitwiseXOR(x))).alias("band"), F.col("key").alias("by"), F.col("sim").alias("by_sim"))
        near = F.bit_count(F.col("sim").bitwiseXOR(F.col("by_sim"))) <= MOST
        pairs = tables.join(small(cut(probe)), "band").where(near).select("key", "by").distinct().join(small(labelled), "key", "left_anti")
        pairs = cut(pairs)
        new = small(pairs.select("key").distinct())
        texts = found.join(new, "key", "left_semi").groupBy("key").agg(F.first("mask").alias("mask"), F.first("sim").alias("sim"))
        texts = cut(texts)
        checked = pairs.join(texts, "key").join(front.select(F.col("key").alias("by"), F.col("mask").alias("by_mask")), "by").select("key", "mask", "by_mask")
        front = cut(texts.join(checked.mapInArrow(_alike, "key bigint").distinct(), "key", "left_semi").select("key", "sim", "mask"))
        if not front.take(1):
            return labelled
        labelled = cut(labelled.unionByName(front.select("key")))


def residue_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", messages: list[str] = MESSAGES) -> DataFrame:
    """``(id)`` of the documents that hold residue in whole or in part."""
    kind = df.schema[id_col].dataType.simpleString()
    known, _ = keys_and_simhashes([features(masked(m)) for m in messages])
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = cut(rows.mapInArrow(_units(known), f"doc_id {kind}, key bigint, sim bigint, mask string, sure boolean"))
    labelled = labelled_units(found, messages).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = found.select("doc_id", "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return held.join(labelled, ["key", "salt"], "left_semi").select(F.col("doc_id").alias(id_col)).distinct()


def without_residue(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no residue; rows without id stay."""
    return df.join(residue_documents(df, id_col, text_col), id_col, "left_anti")
