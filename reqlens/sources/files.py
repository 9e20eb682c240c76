"""Chunks of DOCX files and paragraphs of page texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: non-blank paragraphs of DOCX files in order: path, pos, text. A file that is no DOCX gives none."""

    def paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                texts = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
                out += [(name, i, t) for i, t in enumerate(x for x in texts if x)]
            yield pd.DataFrame(out, columns=["path", "pos", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(paragraphs, "path string, pos int, text string")


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """SRC-9, second half: blank-line paragraphs of page texts (doc_id, page, text) in order."""
    each = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("i", "text"))
    return each.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " "))).where("text != ''").select("doc_id", "page", "i", "text")
