"""Plain-text books from files and ZIP archives, and back to files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_array
from ..operators.segment import split_chapters
from .codecs import file_text

MOST_IMPORT, MOST_ENTRY = 96 << 20, 160 << 20
_HEADER = re.compile(r"^『([^/『』]{1,60})/作者[:：]([^『』]{1,40})』$")


def entries(content: bytes) -> list[tuple[str, int, int, int]]:
    """(name, method, compressed size, size) of an archive's directory; encrypted members and unknown methods are errors."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content), metadata_encoding="gb18030") as z:
        for i in z.infolist():
            if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{i.filename}: encrypted or an unknown method")
            out.append((i.filename, i.compress_type, i.compress_size, i.file_size))
    return out


def first_text(content: bytes) -> tuple[str, bytes]:
    """Name and bytes of the first .txt member that is not empty."""
    for name, _, _, size in entries(content):
        if name.lower().endswith(".txt") and size:
            if size > MOST_ENTRY:
                raise ValueError(f"{name}: larger than {MOST_ENTRY} bytes")
            with zipfile.ZipFile(io.BytesIO(content), metadata_encoding="gb18030") as z:
                return name, z.read(name)
    raise ValueError("no text in the archive")


def _book(path: str, content: bytes) -> tuple:
    try:
        if len(content) > MOST_IMPORT:
            raise ValueError(f"larger than {MOST_IMPORT} bytes")
        name = path.rsplit("/", 1)[-1]
        if name.lower().endswith(".zip") or content[:4] == b"PK\x03\x04":
            name, content = first_text(content)
        text = file_text(content)
        title, author = re.sub(r"\.[^.]+$", "", name.rsplit("/", 1)[-1])[:40], None
        if header := _HEADER.match(text[:400].replace("\r", "").split("\n")[0].strip()):
            title, author = header[1].strip(), header[2].strip()
        return path, title, author, text, len(content), None
    except (ValueError, zipfile.BadZipFile, RuntimeError) as error:
        return path, None, None, None, len(content), str(error)


def import_books(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, title, author, text, bytes, error of .txt and .zip files. A file that can't be read is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_book(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "title", "author", "text", "bytes", "error"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, title string, author string, text string, bytes long, error string")


def import_chapters(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, chapter, title, paragraphs of imported books."""
    return split_chapters(import_books(spark, paths).filter("error is null"), "path").withColumnRenamed("doc_id", "path")


def export_text(toc: DataFrame, chapters: DataFrame, cleaned: bool = False) -> DataFrame:
    """book_id, order_key, value: what a book's file holds, chapter by chapter in the order of its contents; chapters not stored are skipped. ``cleaned``: as they are shown, without
    advertising and page breaks."""
    both = toc.select("book_id", "order_key", "chapter_id").join(chapters.select("book_id", "chapter_id", "title", "paragraphs"), ["book_id", "chapter_id"])
    own = clean_array(F.col("paragraphs")) if cleaned else F.col("paragraphs")
    return both.select("book_id", "order_key", F.concat(F.col("title"), F.lit("\n\n"), F.array_join(own, "\n"), F.lit("\n")).alias("value"))


def write_books(exported: DataFrame, path: str) -> None:
    """One folder per book. A book's chapters are dealt to ranges of their order, so a long one is written by several tasks; its files by name, and lines within them, are in order."""
    exported.repartitionByRange("book_id", "order_key").sortWithinPartitions("book_id", "order_key").select("book_id", "value").write.partitionBy("book_id").text(path)
