"""Text functions of Columns.  All stay in the JVM; null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space, for regular expressions of any engine, and those of them that don't end a line.
SPACES = r" \t-\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACES}]"
BLANK = r"[ \t\r\x{1F}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
LINE_ENDS = r"[\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
HAN = r"\x{4E00}-\x{9FFF}"
#: Terms that say nothing about a question, and concepts that say nothing about a text.
STOP_TERMS = ("什么", "怎么", "如何", "一下", "这个", "那个", "项目", "系统", "可以", "需要")
STOP_CONCEPTS = ("可以", "这个", "系统", "资料", "用户", "问题", "项目", "知识", "来源", "回答")
#: What marks a numbered line as no step.
STEP_NOISE = ("来源文件", "成绩", "截图", "写到实验报告", "请参考")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def unify(c: Column) -> Column:
    """One kind of line end, single spaces, at most one empty line, none at the ends."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def compact(c: Column, limit: int = 220) -> Column:
    """On one line, cut to ``limit`` characters with an ellipsis."""
    line = strip(F.regexp_replace(c, f"{SPACE}+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, limit - 1), f"{SPACE}+$", ""), F.lit("…")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def document_slug(path: Column) -> Column:
    """Id of a document from its file name; a hash where no letter or digit is left."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(file_stem(path), r"[^\p{L}\p{N}_]+", "-"), "^[-_]+|[-_]+$", ""))
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("doc-"), F.substring(F.sha1(file_name(path).cast("binary")), 1, 10)))


def safe_file_name(c: Column) -> Column:
    """A name for a new file: letters and digits in lower case, 80 at most, ``document`` where there are none."""
    slug = F.substring(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-")), "^-+|-+$", ""), 1, 80)
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("document"))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first and small letters behind; words end at anything that isn't a letter."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def document_title(text: Column, path: Column) -> Column:
    """First heading of a unified text, else the file's name in words."""
    lines = F.split(F.regexp_replace(text, LINE_ENDS, "\n"), "\n")
    heads = F.filter(F.transform(lines, strip), lambda x: x.startswith("#"))
    named = title_case(strip(F.translate(file_stem(path), "_-", "  ")))
    return F.when(F.size(heads) > 0, strip(F.regexp_replace(F.get(heads, F.lit(0)), "^#+", ""))).otherwise(named)


def terms(c: Column) -> Column:
    """Distinct search terms: words of Latin letters in lower case, runs of Chinese characters, abbreviations; without stop terms."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9_\-]+)"), 1)
    han = F.regexp_extract_all(c, F.lit(f"([{HAN}]{{2,}})"), 1)
    short = F.transform(F.regexp_extract_all(c, F.lit("([A-Z]{2,})"), 1), F.lower)
    return F.array_except(F.array_distinct(F.concat(words, han, short)), F.array(*map(F.lit, STOP_TERMS)))


def concepts(c: Column) -> Column:
    """Candidates for concepts in their order, with repeats."""
    found = F.regexp_extract_all(c, F.lit(rf"([A-Za-z][A-Za-z0-9_\-]+|[{HAN}]{{2,8}})"), 1)
    return F.filter(found, lambda x: ~x.isin(*STOP_CONCEPTS))


def sentences(c: Column) -> Column:
    """Sentences in order, without marks of lists; only white space or a line end closes one."""
    broken = F.regexp_replace(c, f"([。！？.!?]){SPACE}+", "$1\n")
    parts = F.transform(F.split(broken, "\n+"), lambda x: strip(F.regexp_replace(x, rf"^[\-*0-9.、{SPACES}]+", "")))
    return F.filter(parts, lambda x: x != "")


def requested_count(c: Column, default: int = 5, most: int = 10) -> Column:
    """How many questions a request asks for; ``default`` where it gives no number, also for null."""
    number = F.regexp_extract(c, rf"(\d+){SPACE}*(道|个)?{SPACE}*(选择题|判断题|练习题|题目|题)", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(default)).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), F.try_to_number(F.substring(number, 1, 9), F.lit("999999999")).cast("int"))))


def numbered_steps(c: Column, limit: int = 7) -> Column:
    """Texts of numbered steps in order, without repeats and noise."""
    line = F.regexp_replace(c, f"{SPACE}+", " ")
    found = F.regexp_extract_all(line, F.lit(rf"(?:^|{SPACE})(\d+)[.、．]{SPACE}*([^。；;]{{12,120}})"), 2)
    good = F.filter(F.transform(found, lambda x: compact(x, 110)), lambda x: ~x.rlike("|".join(STEP_NOISE)))
    return F.slice(F.array_distinct(good), 1, limit)


def between(c: Column, starts: list[str], ends: list[str], limit: int) -> Column:
    """From the first of the start marks to the first end mark behind it, else ``limit`` characters; empty without a start mark."""
    line = strip(F.regexp_replace(c, f"{SPACE}+", " "))
    start = F.array_min(F.filter(F.array(*(F.locate(m, line) for m in starts)), lambda x: x > 0))
    behind = F.array_min(F.filter(F.array(*(F.call_function("locate", F.lit(m), line, start + 1) for m in ends)), lambda x: x > 0))
    stop = F.coalesce(behind, start + limit)
    return F.when(start.isNull(), F.lit("")).otherwise(compact(F.substring(line, start, stop - start), limit))


def match_share(query: Column, text: Column) -> Column:
    """Share of the words of a query, repeats counted, that stand in a text."""
    words = F.transform(F.regexp_extract_all(query, F.lit(rf"([A-Za-z][A-Za-z0-9_\-]+|[{HAN}]{{2,}})"), 1), F.lower)
    held = F.filter(words, lambda w: F.contains(F.lower(text), w))
    return F.when(F.size(words) > 0, F.size(held) / F.size(words)).otherwise(F.lit(0.0))
