"""Uploaded-file source: ``binaryFile`` scan, size / extension gate, text extraction.

The gate is native Spark (``length`` is pushed into the file listing, so files over the
limit are never read). Text files are decoded by column functions: a validity test for UTF-8, and
translations of single-byte code pages. Only docx files pass through Python (``mapInPandas`` with
``zipfile``). PDF text extraction needs a PDF library, which this build does not have: PDF files
pass the gate and come back with an error value.
"""

from __future__ import annotations

import io
import zipfile
from typing import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.session import ship_package
from learnlog.functions import text as T

FORMAT_DESCRIPTIONS = {
    "txt": "Pliki tekstowe (.txt)",
    "docx": "Dokumenty Word (.docx)",
    "pdf": "Dokumenty PDF (.pdf)",
}
READ_ERROR_PREFIX = "Błąd podczas odczytywania pliku: "
NO_CONTENT = "no content"
PDF_UNAVAILABLE = "PDF text extraction is not available in this build"


def supported_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMAT_DESCRIPTIONS.items()), "ext string, description string")


def list_files(spark: SparkSession, path: str, max_bytes: int | None = None,
               glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``binaryFile`` listing with name and extension; ``max_bytes`` filters in the source."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(path)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    name = F.substring_index("path", "/", -1)
    return df.withColumn("name", name).withColumn("ext", T.file_extension(name))


def megabytes(length):
    return (F.col(length) if isinstance(length, str) else length) / (1024 * 1024)


def gate(files: DataFrame, max_mb: float = K.MAX_FILE_SIZE_MB, keep: list[str] = ()) -> DataFrame:
    """Upload validation: size first (``> max_mb`` MB rejected), then the extension."""
    too_big = megabytes("length") > max_mb
    bad_ext = ~F.col("ext").isin(*K.SUPPORTED_FILE_TYPES)
    reason = (F.when(too_big, F.lit(K.MSG_FILE_TOO_LARGE))
              .when(bad_ext, F.concat(F.lit(K.MSG_UNSUPPORTED_FORMAT + ": "), F.col("ext")))
              .otherwise(F.lit("")))
    return files.select(*keep, "path", "name", "ext", "length", (reason == "").alias("ok"), reason.alias("reason"))


# --- contents --------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph_text(p) -> str:
    out = []
    for el in p.iter():
        if el.tag == _W + "t":
            out.append(el.text or "")
        elif el.tag == _W + "tab":
            out.append("\t")
        elif el.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def docx_text(data: bytes) -> str:
    """Top-level body paragraphs that are not blank, joined by newlines (table cells are
    not body paragraphs and are left out)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(_W + "body")
    paras = [] if body is None else [_paragraph_text(p) for p in body.findall(_W + "p")]
    return "\n".join(t for t in paras if t.strip())


def _single_byte(latin: Column, encoding: str) -> Column:
    """Text read as ISO-8859-1 (every byte a character) in a single-byte code page instead."""
    pairs = [(chr(b), bytes([b]).decode(encoding)) for b in range(256) if b not in _undefined(encoding)]
    pairs = [(a, c) for a, c in pairs if a != c]
    return F.translate(latin, "".join(a for a, _ in pairs), "".join(c for _, c in pairs))


def _undefined(encoding: str) -> list[int]:
    """The bytes that a code page doesn't define."""
    out = []
    for b in range(256):
        try:
            bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out.append(b)
    return out


def with_decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``text`` and ``encoding``: the first encoding of the ordered list that decodes the
    whole content, all in the JVM. Both are null where the content is, or where none does."""
    raw = F.col(content)
    latin = F.decode(raw, "ISO-8859-1")
    d = files.withColumn("_utf8", F.is_valid_utf8(raw.cast("string")))
    encoding, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(K.TXT_ENCODINGS):
        if name == "utf-8":
            ok, value = F.col("_utf8"), raw.cast("string")
        else:
            bad = _undefined(name)
            ok = ~latin.rlike("[" + "".join(f"\\x{b:02x}" for b in bad) + "]") if bad else raw.isNotNull()
            value = _single_byte(latin, name)
        encoding, text = F.when(ok, F.lit(name)).otherwise(encoding), F.when(ok, value).otherwise(text)
    return d.withColumn("text", text).withColumn("encoding", encoding).drop("_utf8")


def _extract_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, errs = [], []
        for content in pdf["content"]:
            try:
                texts.append(docx_text(bytes(content)))
                errs.append(None)
            except Exception as e:  # noqa: BLE001 - a bad file is a value, not a failed task
                texts.append(None)
                errs.append(READ_ERROR_PREFIX + str(e))
        yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "text": texts, "encoding": None, "error": errs})


def extract_txt(files: DataFrame) -> DataFrame:
    """``(path, length, content)`` of text files -> ``path, length, text, encoding, error``."""
    d = with_decoded(files.select("path", "length", "content"))
    error = (F.when(F.col("content").isNull(), F.lit(READ_ERROR_PREFIX + NO_CONTENT))
             .when(F.col("encoding").isNull(), F.lit(K.MSG_TXT_DECODE_FAILED)))
    return d.select("path", "length", "text", "encoding", error.alias("error"))


def extract_text(files: DataFrame) -> DataFrame:
    """``(path, length, content)`` -> ``path, length, text, encoding, error``. Only docx files pass
    through Python."""
    ship_package(files.sparkSession)
    rows = files.select("path", "length", "content", T.file_extension(F.substring_index("path", "/", -1)).alias("ext"))
    none = F.lit(None).cast("string")
    other = rows.where(~F.col("ext").isin("txt", "docx")).select(
        "path", "length", none.alias("text"), none.alias("encoding"),
        F.when(F.col("ext") == "pdf", F.lit(READ_ERROR_PREFIX + PDF_UNAVAILABLE))
        .otherwise(F.concat(F.lit(K.MSG_UNSUPPORTED_FORMAT + ": "), F.col("ext"))).alias("error"))
    docx = rows.where("ext = 'docx'").select("path", "length", "content").mapInPandas(
        _extract_docx, "path string, length long, text string, encoding string, error string")
    return extract_txt(rows.where("ext = 'txt'")).unionByName(docx).unionByName(other)


def read_texts(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Gate + extraction: one row per file. Only files that pass the gate are read and decoded; the
    others have the gate's reason as their error."""
    files = list_files(spark, path, max_bytes=K.MAX_FILE_SIZE_BYTES, **kw)
    read = extract_text(files.where(F.col("ext").isin(*K.SUPPORTED_FILE_TYPES)))
    none = F.lit(None).cast("string")
    rejected = gate(list_files(spark, path, **kw)).where(~F.col("ok")).select(
        "path", "length", none.alias("text"), none.alias("encoding"), F.col("reason").alias("error"))
    return read.unionByName(rejected).select(
        "path", F.substring_index("path", "/", -1).alias("name"), "length", "text",
        "encoding", "error", F.length("text").alias("n_chars"), T.preview("text").alias("preview"))
