"""Responses of a fetch log (url, status, content_type, body, final_url): their class, and pages as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import parts
from .codecs import decode_page

MOST_BYTES = 4 << 20
# What pages look like that ask for a check of the browser; only the first characters are looked at.
HEAD = 8192
CHALLENGE = (
    r"(?i)<title>\s*(?:Just a moment\.\.\.|Attention Required! \| Cloudflare|请稍候…|正在验证浏览器)\s*</title>",
    r"""["']\?challenge=["']""",
    r"(?i)_cf_chl_opt|cf_chl_|cf-challenge",
)


def is_challenge(page: Column) -> Column:
    return F.left(page, F.lit(HEAD)).rlike("|".join(f"(?:{p})" for p in CHALLENGE))


def classified(log: DataFrame, hosts: list[str]) -> DataFrame:
    """The log with text, bytes, at_url (where the answer came from), class (ok, http, redirected, invalid, too_large, blocked), retryable, and outcome (ok, not_found, failed)."""
    text = decode_page(F.col("body"), F.col("content_type"))
    host = F.lower(parts(F.coalesce("final_url", "url"))["host"])
    kind = (
        F.when((F.col("status") != 200) & F.col("status").isin(403, 429, 503) & is_challenge(F.col("text")), "blocked")
        .when(F.col("status") != 200, "http")
        .when(~F.coalesce(host.isin(hosts), F.lit(False)), "redirected")
        .when((F.coalesce("content_type", F.lit("")) != "") & ~F.col("content_type").rlike("(?i)text/html|text/plain"), "invalid")
        .when(F.octet_length("body") > MOST_BYTES, "too_large")
        .when(is_challenge(F.col("text")), "blocked")
        .otherwise("ok")
    )
    out = log.withColumn("text", text).withColumn("class", kind).withColumn("bytes", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")).withColumn("at_url", F.coalesce("final_url", "url"))
    return out.withColumn("retryable", (F.col("class") == "http") & (F.col("status") >= 500)).withColumn("outcome", F.when(F.col("class") == "ok", "ok").when((F.col("class") == "http") & (F.col("status") == 404), "not_found").otherwise("failed"))
