"""Benchmark decontamination by winnowing.

A window of ``window`` words holds ``window - GRAM + 1`` grams of GRAM words. Each window keeps the gram of smallest hash; a
document keeps each gram that is the smallest of any window over it, so a window that document and benchmark share keeps
the same gram on both sides. Fingerprints are joined on the gram's hash, and each hit is extended to the whole window and
compared word for word. No shared window is missed and none is made up by equal hashes.

Benchmark items shorter than a window are one window of their own length; grams of those lengths (there are fewer than
``window`` of them) are joined whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored
from .spans import let, with_reach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
#: Benchmark windows are broadcast up to so many bytes (words, item ids and 64 for each window and id), which are counted; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def words(text: str | Column) -> Column:
    """Digits, letters and non-ASCII characters in runs, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _positions(n: Column, size: int) -> Column:
    """0 to n - size, or nothing."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, n: Column, size: int) -> Column:
    return F.transform(_positions(n, size), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]))


def _smallest(grams: Column, n: Column, window: int) -> Column:
    """The smallest gram of each window."""
    return F.transform(_positions(n, window), lambda i: F.least(*[F.get(grams, i + k) for k in range(window - GRAM + 1)]))


def _fingerprints(docs: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """Adds ``prints``: (at, key) for each kept gram and, for the lengths of short items, for each gram of that length."""
    n = F.col("n_words")
    docs = docs.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("grams", F.when(n >= window, _grams(F.col("hashes"), n, GRAM)).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("least", _smallest(F.col("grams"), n, window))
    # get() gives null outside the array, and greatest() skips nulls.
    kept = F.filter(
        F.transform("grams", lambda g, i: F.when(g == F.greatest(*[F.get("least", F.when(i >= k, i - k)) for k in range(window - GRAM + 1)]), F.struct(i.alias("at"), g.alias("key")))),
        lambda x: x.isNotNull(),
    )
    short = [F.transform(_grams(F.col("hashes"), n, size), lambda g, i: F.struct(i.alias("at"), g.alias("key"))) for size in lengths]
    return docs.withColumn("prints", F.concat(kept, *short) if short else kept).drop("hashes", "grams", "least")


def windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct benchmark windows: size, words, item_ids (as strings), and the key and place of the gram that is joined.

    Null, empty and wordless items and null ids have none; items that repeat count once; an empty table gives an empty one."""
    items = items.select(F.col(id_col).cast("string").alias("item_id"), words(text_col).alias("w")).withColumn("n", F.size("w")).filter("n > 0 and item_id is not null")
    size = F.least(F.col("n"), F.lit(window))
    each = items.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.slice("w", i, size))).alias("own"))
    each = each.groupBy("size", "own").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hashes = F.transform("own", lambda w: F.xxhash64(w))
    grams = F.transform(F.sequence(F.lit(0), F.lit(window - GRAM)), lambda i: F.xxhash64(F.lit(GRAM), *[F.get("hashes", i + k) for k in range(GRAM)]))
    full = each.filter(F.col("size") == window).withColumn("hashes", hashes).withColumn("grams", grams).withColumn("key", F.array_min("grams"))
    full = full.select("size", "own", "item_ids", "key", (F.array_position("grams", F.col("key")) - 1).cast("int").alias("shift"))
    whole = F.lit(None).cast("bigint")
    for s in range(1, window):
        whole = F.when(F.col("size") == s, F.xxhash64(F.lit(s), *[F.get("hashes", F.lit(k)) for k in range(s)])).otherwise(whole)
    few = each.filter(F.col("size") < window).withColumn("hashes", hashes).select("size", "own", "item_ids", whole.alias("key"), F.lit(0).alias("shift"))
    return full.unionByName(few)


def _merged(found: Column) -> Column:
    """Ranges (s, e) in order, at least one; those that overlap or touch become one. Each begins behind the reach of all before it and goes
    as far as those before the next one reach."""
    first = lambda x: F.filter(x, lambda r: (r["span"]["s"] > r["before"]) | (r["before"] == 0))
    end = F.aggregate(found, F.lit(0), lambda a, x: F.greatest(a, x["e"]))
    ends = lambda x: F.concat(F.transform(F.slice(x, F.lit(2), F.size(x)), lambda r: r["before"]), F.array(end))
    return let(first(with_reach(found, "e")), lambda x: F.zip_with(x, ends(x), lambda r, e: F.struct(r["span"]["s"].alias("s"), e.alias("e"))))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row (tells texts of one id apart, see ``row_key``), n_words, n_hit (words inside any occurrence of a benchmark window), item_ids (those with
    occurring windows, sorted as strings), spans (hit word ranges, end exclusive), contaminated.

    Null and empty texts have no words; items without words, or with a null id, are no windows; an empty benchmark hits nothing.
    Rows that repeat give equal rows. Other columns of either table are not read. Ids are cast to long: one that is no number stops the run.
    """
    if window < GRAM + 1:
        raise ValueError(f"a window has at least {GRAM + 1} words")
    found = stored(windows(items, window, item_id_col, item_text_col), "benchmark-windows")
    size = F.aggregate(F.concat("own", "item_ids"), F.lit(64).cast("long"), lambda a, x: a + F.octet_length(x) + 64)
    held, lengths = found.agg(F.sum(size)).first()[0] or 0, sorted(r["size"] for r in found.filter(F.col("size") < window).select("size").distinct().collect())
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row"), words(text_col).alias("words")).withColumn("n_words", F.size("words"))
    # Every document has one entry that stands for itself; its key is its own, so that these entries are dealt evenly.
    none = F.struct(F.lit(-1).alias("at"), F.xxhash64("doc_id", "row").alias("key"))
    prints = _fingerprints(base, window, lengths).select("doc_id", "row", "words", "n_words", F.explode(F.concat(F.array(none), "prints")).alias("p"))
    begin = F.col("p.at") - F.col("shift")
    if held <= BROADCAST_BYTES:
        near = prints.join(F.broadcast(found), F.col("p.key") == F.col("key"), "left")
        same = F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("size")) == F.col("own")
    else:
        # Each print takes along the words that a window around it can have.
        low = F.greatest(F.col("p.at") - (window - GRAM), F.lit(0))
        prints = prints.withColumn("low", low).withColumn("words", F.when(F.col("p.at") >= 0, F.slice("words", F.col("low") + 1, 2 * window)))
        near = prints.join(found, F.col("p.key") == F.col("key"), "left")
        same = F.slice("words", F.greatest(begin - F.col("low"), F.lit(0)) + 1, F.col("size")) == F.col("own")
    hit = (begin >= 0) & same
    first = F.col("p.at") < 0
    rows = near.filter(first | hit).select("doc_id", "row", "n_words", first.alias("first"), F.when(~first, F.struct(begin.alias("s"), (begin + F.col("size")).alias("e"))).alias("span"), "item_ids")
    grouped = rows.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.count_if("first").alias("copies"), F.array_sort(F.collect_set("span")).alias("found"), F.collect_set("item_ids").alias("sets"))
    start = F.array().cast("array<struct<s:int,e:int>>")
    grouped = grouped.withColumn("spans", F.when(F.size("found") > 0, _merged(F.col("found"))).otherwise(start))
    out = grouped.select(
        "doc_id",
        "row",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("item_ids"),
        "spans",
        "copies",
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
