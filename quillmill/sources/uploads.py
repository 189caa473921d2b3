"""Uploaded files: payloads, text of several formats, checks, names, and the tables that take them.

``payload_text`` reads text files as UTF-8, else GB18030, else GBK, else UTF-8 without its invalid bytes, and the visible text of DOCX files; PDF needs the optional
package pypdf.  What can't be read has null text and a reason.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_TEXT, THIN_TEXT = 20, 500
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def payload(c: Column) -> Column:
    """Bytes of a base64 payload or data URL; null where it is neither."""
    body = F.when(F.lower(T.strip(c)).startswith("data:") & F.contains(c, F.lit(",")), F.substring(c, F.locate(",", c) + 1, F.length(c))).otherwise(c)
    bare = F.regexp_replace(body, "[\r\n]", "")
    return F.when(bare.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.try_to_binary(bare, F.lit("base64")))


def decoded(raw: bytes) -> str:
    for encoding in ("utf-8", "gb18030", "gbk"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


def word_blocks(xml: bytes) -> list[str]:
    """Paragraphs of a WordprocessingML part, tabs as spaces, breaks as line ends, empty ones left out."""
    out = []
    text = {f"{WORD}tab": " ", f"{WORD}br": "\n"}
    for paragraph in ET.fromstring(xml).iter(f"{WORD}p"):
        body = "".join(node.text or "" if node.tag == f"{WORD}t" else text.get(node.tag, "") for node in paragraph.iter()).strip()
        if body:
            out.append(body)
    return out


def docx_text(raw: bytes) -> str:
    """Visible text of a DOCX file: body, headers, footers, notes; lines with single spaces, none twice in a row."""
    lines: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = sorted(archive.namelist())
        parts = [n for n in names if n == "word/document.xml"]
        for begin in ("word/header", "word/footer"):
            parts += [n for n in names if n.startswith(begin) and n.endswith(".xml")]
        parts += [n for n in names if n in ("word/endnotes.xml", "word/footnotes.xml")]
        for name in parts:
            for block in word_blocks(archive.read(name)):
                line = " ".join(block.split())
                if line and (not lines or lines[-1] != line):
                    lines.append(line)
    return "\n".join(lines)


def pdf_text(raw: bytes) -> str:
    """Text of a PDF file by pages that have some."""
    from pypdf import PdfReader  # optional

    pages = [(k, page.extract_text() or "") for k, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]
    return "\n".join(f"\n\n## Page {k}\n\n{s}" for k, s in pages if s.strip())


def file_text(name: str | None, raw: bytes | None) -> tuple[str | None, str | None]:
    """Text of a file, and why there is none."""
    suffix = "." + name.rsplit(".", 1)[-1].lower() if name and "." in name else ""
    if raw is None:
        return None, "payload"
    readers = {".md": decoded, ".txt": decoded, ".docx": docx_text, ".pdf": pdf_text}
    if suffix not in readers:
        return None, "format"
    try:
        return readers[suffix](bytes(raw)), None
    except Exception as problem:  # noqa: BLE001 - a broken file is a result
        return None, f"broken: {type(problem).__name__}"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [file_text(n, r) for n, r in zip(b["filename"], b["raw"], strict=True)]
        yield pd.DataFrame({"id": b["id"], "filename": b["filename"], "title": b["title"], "text": [t for t, _ in found], "problem": [p for _, p in found]})


def read_uploads(df: DataFrame, id_col: str = "upload_id", body_col: str = "content_base64") -> DataFrame:
    """``(id, filename, title, text, problem)`` of uploads ``(id, filename, title, payload)``."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), "filename", "title", payload(F.col(body_col)).alias("raw"))
    return rows.mapInPandas(_read, "id bigint, filename string, title string, text string, problem string")


def quality_warning(filename: Column, text: Column) -> Column:
    """Whether a DOCX or PDF file gave so little text that it may hold pictures."""
    return F.coalesce(F.lower(filename).rlike(r"\.(docx|pdf)$") & (F.length(T.strip(text)) < THIN_TEXT), F.lit(False))


def valid_documents(df: DataFrame) -> DataFrame:
    """Add-document requests ``(title, content, source, ...)`` with ``valid``: lengths of title 1 to 120, content 20 or more, source 120 at most."""
    title, content, source = (F.coalesce(F.length(c), F.lit(0)) for c in ("title", "content", "source"))
    return df.withColumn("valid", title.between(1, 120) & (content >= 20) & (source <= 120))


def unique_names(df: DataFrame, stem: Column, taken: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``name``: the stem, else with -2, -3 and so on, so that no two are equal and none is in ``taken(name)``.

    The n-th row of a stem takes the n-th free number: free numbers are counted by how many taken ones come before, so nothing is tried one by one.
    """
    rows = df.withColumn("_stem", stem).withColumn("_n", F.row_number().over(Window.partitionBy("_stem").orderBy(*order)))
    stems = rows.select("_stem").distinct()
    number = F.when(F.regexp_extract("name", r"-(\d{1,9})$", 1) != "", F.regexp_extract("name", r"-(\d{1,9})$", 1).cast("bigint"))
    used = taken.select(F.col("name").alias("_stem"), F.lit(1).alias("u")).unionByName(taken.select(F.regexp_replace("name", r"-\d{1,9}$", "").alias("_stem"), number.alias("u")).where("u >= 2")).distinct()
    gaps = used.join(stems, "_stem", "left_semi").withColumn("_before", F.col("u") - F.row_number().over(Window.partitionBy("_stem").orderBy("u")))
    lists = gaps.groupBy("_stem").agg(F.array_sort(F.collect_list("_before")).alias("_gaps"))
    both = rows.join(lists, "_stem", "left")
    place = F.col("_n") + F.coalesce(F.size(F.filter("_gaps", lambda g: g < F.col("_n"))), F.lit(0))
    return both.withColumn("name", F.when(place == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("-"), place.cast("string")))).drop("_stem", "_n", "_gaps")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of all Markdown and text files below a folder, decoded as UTF-8 without invalid bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[mM][dD],[tT][xX][tT]}").load(folder)
    udf = F.pandas_udf(lambda s: s.map(lambda raw: bytes(raw).decode("utf-8", "ignore")), "string")
    return files.select("path", udf("content").alias("text"))


def as_markdown(title: Column, text: Column, filename: Column | None = None) -> Column:
    """The file that a document is stored as."""
    note = F.lit("") if filename is None else F.concat(F.lit("来源文件："), filename, F.lit("\n\n"))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), note, T.strip(text), F.lit("\n"))


def delete_documents(docs: DataFrame, ids: DataFrame, path_col: str = "path") -> DataFrame:
    """The documents that stay: of each id in ``ids(doc_id)``, the first path is left out."""
    keyed = docs.withColumn("_id", T.document_slug(F.col(path_col)))
    gone = keyed.join(ids.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi").groupBy("_id").agg(F.min(path_col).alias(path_col))
    return keyed.join(gone, ["_id", path_col], "left_anti").drop("_id")
