"""From raw documents to packed sequences: each stage reads what its predecessor kept, whole.

run(spark, sf_dir) applies STAGES to the table of documents. A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontam, mil, minhash, packing, pii
from folioforge.llm.common import row_key, small_or_shuffled, stored
from folioforge.llm.queries import INSTRUCTION, quality_model, table
from folioforge.llm.spans import redacted

#: SQL can't express the trained models and the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """Rows whose id and text (``row_key``) are not in ``dropped`` (doc_id, row); ids may be null or stand for several texts. A counted,
    bounded list is broadcast, a longer one joined by shuffle."""
    dropped = stored(dropped.select(F.col("doc_id").alias("__id"), F.col("row").alias("__gone")).distinct(), name)
    own = docs.withColumn("__row", row_key(F.col("text")))
    same = (F.col("__row") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return own.join(small_or_shuffled(dropped, dropped.count()), same, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.3 or more stay. Null and empty texts get the score of a text without words; rows that
    repeat stay or go together; an empty table gives an empty one."""
    score = mil.scored(spark, quality_model(spark, sf_dir), F.col("text"))
    return docs.filter(score >= 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id (null ids come last, then texts decide); rows that repeat an
    id and a text count as one. Texts without words are in no group and stay; an empty table gives an empty one."""
    found = stored(minhash.near_duplicates(docs, size=5, percent=80).select("doc_id", "row", "group"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    first = found.filter("group is not null").groupBy("group").agg(F.count("*").alias("rows"), F.min(rank).alias("first")).filter("rows > 1")
    first = stored(first.select(F.col("group").alias("g"), "first"), "first-of-group")
    several = found.join(small_or_shuffled(first, first.count()), F.col("group") == F.col("g")).withColumn("rank", rank)
    out = _without(docs, several.filter(F.col("rank") != F.col("first")), "duplicates")
    # A shuffle of texts only where rows repeat an id and a text; their keys tell.
    repeated = found.groupBy("doc_id", "row").count().filter("count > 1").take(1)
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item (ten words, or a whole shorter item) go, each text of an id and each null id on its own. Null and
    empty texts stay; rows that repeat stay or go together; an empty table, of documents or items, is no error."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"), "contaminated")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text. Every row stays, those with null ids or
    texts and repeated ones too; an empty table gives an empty one."""
    found = pii.personal_data(docs, keep=tuple(docs.columns))
    text = F.when(F.col("row.text").isNotNull(), redacted(F.col("row.text"), F.col("spans")))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, eight documents and 1280 tokens of replies at most. Null texts are empty; rows that repeat are packed
    each; an empty table gives an empty one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keeps_spaces=True, end_id=1, limits=INSTRUCTION, loss=packing.reply_share, remembered=50_000)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
