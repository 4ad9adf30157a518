"""Readers of raw files: Word documents, web pages, PDFs (where a library is there), JSON samples, legacy vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafloom.functions.text import is_separator, normalize_space, slugify
from grafloom.sources.sqlite import sqlite_table

SKIPPED = ("script", "style", "nav", "footer", "form", "noscript")
#: Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def html_to_text(html: str | None) -> str | None:
    """The strings of the article, else main, else body, else page, a line each, without menus and code."""
    if html is None:
        return None
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.path: list[str] = []
            self.seen: dict[str, list[str]] = {"": []}
            self.first: dict[str, int] = {}

        def handle_starttag(self, tag, attrs):
            if tag in VOID:
                return
            self.path.append(tag)
            if tag in ("article", "main", "body") and tag not in self.first:
                self.first[tag] = len(self.path)
                self.seen[tag] = []

        def handle_endtag(self, tag):
            if tag in self.path:
                while self.path:
                    depth = len(self.path)
                    last = self.path.pop()
                    if self.first.get(last) == depth:
                        self.first[last] = -1
                    if last == tag:
                        break

        def handle_data(self, data):
            if any(t in SKIPPED for t in self.path) or not data.strip():
                return
            self.seen[""].append(data.strip())
            for root, depth in self.first.items():
                if 0 < depth <= len(self.path):
                    self.seen[root].append(data.strip())

    reader = Reader()
    reader.feed(html)
    reader.close()
    for root in ("article", "main", "body", ""):
        if root in reader.seen:
            return "\n".join(reader.seen[root])
    return ""


def html_text(c: Column) -> Column:

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(html_to_text)

    return read(c)


def docx_to_lines(content: bytes, tables: bool = True) -> list[str]:
    """Paragraphs, split into lines, then table rows with cells joined by a bar; separators left out."""
    import io
    import re
    import xml.etree.ElementTree as E
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = E.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")

    def text(paragraph) -> str:
        return "".join("\n" if x.tag in (f"{w}br", f"{w}cr") else "\t" if x.tag == f"{w}tab" else x.text or "" for x in paragraph.iter() if x.tag in (f"{w}t", f"{w}br", f"{w}cr", f"{w}tab"))

    clean = lambda s: re.sub(r"\s+", " ", s).strip()
    lines = [clean(line) for p in body.findall(f"{w}p") for line in text(p).split("\n")]
    if tables:
        for row in body.iterfind(f"{w}tbl/{w}tr"):
            cells = [clean("\n".join(text(p) for p in cell.iter(f"{w}p"))) for cell in row.findall(f"{w}tc")]
            lines.append(" | ".join(c for c in cells if c))
    return [x for x in lines if x and not re.fullmatch(r"[_=\-\s.]{3,}", x)]


def docx_lines(c: Column, tables: bool = True) -> Column:

    @F.pandas_udf("array<string>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else docx_to_lines(bytes(b), tables))

    return read(c)


def pdf_text(c: Column) -> Column:
    """Pages joined by blank lines; needs the optional library pypdf on the executors."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        import io

        from pypdf import PdfReader

        return s.map(lambda b: None if b is None else "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages))

    return read(c)


def text_lines(c: Column) -> Column:
    """The normalised lines of a plain text that are neither empty nor separators."""
    return F.filter(F.transform(F.split(c, "\n"), normalize_space), lambda x: (F.length(x) > 0) & ~is_separator(x))


def extractor(content_type: Column, path: Column) -> Column:
    """Which reader a download needs."""
    return F.when(F.contains(content_type, F.lit("pdf")) | F.contains(path, F.lit(".pdf")), "pdf").when(F.contains(content_type, F.lit("word")) | F.endswith(path, F.lit(".docx")), "docx").otherwise("html")


def file_names(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with the file's name, and the document id that it gives: the slug of its stem, which also orders files."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return paths.withColumn("filename", name).withColumn("doc_id", slugify(F.regexp_replace("filename", r"\.[^.]*$", "")))


def docx_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, filename, doc_id) of the Word documents of a folder; an empty folder is an error."""
    found = file_names(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content"))
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no .docx files in {path}")
    return found


SAMPLE = T.StructType().add("id", "string").add("question", "string").add("reference_answer", "string").add("question_type", "string").add("difficulty", "string").add("relevant_contexts", T.ArrayType(T.StructType().add("chunk_id", "string"))).add("ragas_fields", T.StructType().add("user_input", "string").add("reference", "string").add("response", "string").add("retrieved_contexts", T.ArrayType(T.StringType())))


def eval_samples(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Labelled questions, ordered by id; a slice if asked for.  The path's end tells what is read: JSON lines
    (``.jsonl``), a table ``samples`` of a database (``.db``, ``.sqlite``), whose nested columns are JSON texts, else a JSON
    list."""
    if path.endswith((".db", ".sqlite")):
        held = sqlite_table(spark, path, "samples")
        nested = lambda f: not isinstance(f.dataType, T.StringType)
        rows = held.select(*((F.from_json(f.name, f.dataType) if nested(f) else F.col(f.name)).alias(f.name) if f.name in held.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SAMPLE.fields))
    else:
        rows = spark.read.schema(SAMPLE).json(path, multiLine=not path.endswith(".jsonl"))
    rows = rows.orderBy("id")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def blob_vector(c: Column) -> Column:
    """Legacy little-endian float32 blobs as arrays."""

    @F.pandas_udf("array<float>")
    def read(s: pd.Series) -> pd.Series:
        import numpy as np

        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return read(c)
