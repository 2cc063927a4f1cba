"""Character sets of pages and plain-text files."""

from __future__ import annotations

import codecs
import re
from urllib.parse import quote_from_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels that are taken, and what decodes them.
LABELS = {"utf-8": "utf-8", "utf8": "utf-8", "gbk": "gb18030", "gb2312": "gb18030", "gb18030": "gb18030", "x-gbk": "gb18030"}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.IGNORECASE)
_META = re.compile(r"<meta[^>]+charset\s*=\s*[\"']?[A-Za-z0-9_-]+[^>]*>", re.IGNORECASE)


def _label(said: str | None) -> str | None:
    found = _CHARSET.search(said or "")
    return LABELS.get(found[1].lower()) if found else None


def page_text(body: bytes | None, content_type: str | None) -> str | None:
    """By the header's character set, else that of a meta element in the first 2048 bytes, else UTF-8."""
    if body is None:
        return None
    label = _label(content_type)
    if not label and (meta := _META.search(body[:2048].decode("latin-1"))):
        label = _label(meta[0])
    return body.decode(label or "utf-8", "replace").removeprefix("﻿")


def file_text(body: bytes | None) -> str | None:
    """By byte-order mark, else strict UTF-8, else GB18030."""
    if body is None:
        return None
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("gb18030", "replace")


def decode_page(body: Column, content_type: Column) -> Column:
    @F.pandas_udf("string")
    def run(bodies: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([page_text(b, t) for b, t in zip(bodies, types, strict=True)], dtype=object)

    return run(body, content_type)


def decode_file(body: Column) -> Column:
    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([file_text(b) for b in bodies], dtype=object)

    return run(body)


def gbk_component(text: Column) -> Column:
    """Percent-encoded GBK; characters that it lacks as encoded numeric entities."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: quote_from_bytes(t.encode("gbk", "xmlcharrefreplace"), safe="-_.!~*'()"), na_action="ignore")

    return run(text)
