"""Source divergence audit by joint count histograms.

Every source of a language has a smoothed share of each term that the language keeps. Two sources differ by the sum, over all kept terms,
of the distance of their shares. That distance depends on the two counts alone, so a pair of sources is described by its joint
histogram: how many terms have each combination of (count here, count there). The distance is evaluated once for each combination
and multiplied. Terms that only one of the two has, or none, are never paired: their cells follow by inclusion and exclusion from
the histograms of single sources and the number of kept terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, small_batches, small_or_shuffled, stored

#: A language keeps the terms of so many of its documents.
LEAST_DOCS = 30
#: Added to each count; shares are in parts of UNIT.
ADDED, UNIT = 5, 1_000_000_000
#: Terms of highest value that are reported for a group.
TOP_TERMS = 50
#: ASCII letters in small form, other bytes of ASCII as blanks, all others as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: A task hands its counts on when it holds so many, and pairs so many cells at once.
HELD, PAIRS = 600_000, 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_CELLS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("ca", pa.int64()), ("cb", pa.int64()), ("m", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), added up within the task."""
    held: defaultdict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, docs) in held.items():
            terms, n = pa.array(occurrences.keys(), pa.binary()).cast(pa.string()), len(occurrences)
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(occurrences.values(), pa.int64()), pa.array([docs[t] for t in occurrences], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
        held.clear()

    for batch in slices(batches, 100):
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, raw in zip(langs, sources, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            terms = raw.translate(_FOLD).split()
            occurrences, docs = held[lang, source]
            occurrences.update(terms)
            docs.update(set(terms))
        if sum(len(x) for x, _ in held.values()) >= HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and the group's documents (rows) with it; nulls are empty strings."""
    small_batches(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counts = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many terms have each combination of counts above zero, for each pair of sources (a before b), added up within the task."""
    held: list[pa.Table] = []

    def added(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(_CELLS.names[:5], use_threads=False).aggregate([("m", "sum")])
        return sums.rename_columns({"m_sum": "m"}).select(_CELLS.names).cast(_CELLS)

    for batch in batches:
        langs, parts = batch.column(0), batch.column(1)
        entries, sizes = parts.flatten(), np.diff(parts.offsets.to_numpy())
        if not len(entries):
            continue
        sources, n = entries.field(0), entries.field(1)
        after = np.cumsum(sizes)
        later = np.repeat(after, sizes) - 1 - np.arange(len(entries))  # entries of the same term that follow
        term = np.repeat(np.arange(len(sizes)), sizes)
        upto, at = np.cumsum(later), 0
        while at < len(later):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            left = np.repeat(np.arange(at, end), later[at:end])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[at:end]) - later[at:end], later[at:end])
            columns = [langs.take(pa.array(term[left])), sources.take(pa.array(left)), sources.take(pa.array(right)), n.take(pa.array(left)), n.take(pa.array(right)), pa.array(np.ones(len(left), np.int64))]
            held.append(added([pa.Table.from_arrays(columns, schema=_CELLS)]))
            if sum(t.num_rows for t in held) > 2 * PAIRS:
                held = [added(held)]
                if held[0].num_rows > PAIRS:
                    yield from held.pop().to_batches(100_000)
            at = end
    if held:
        yield from added(held).to_batches(100_000)
    release()


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * kept)), exactly; null where no term is kept."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    above, below = F.lit(UNIT).cast("decimal(10,0)") * (wide(count) + ADDED), F.nullif(wide(total) + wide(kept) * ADDED, F.lit(0).cast("decimal(20,0)"))
    return 1 + F.call_function("div", above, below)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of a language and a source how far each other source of the language is from it
    (part "pair"), and the ``top`` terms whose share there exceeds that of the language by most (part "term").

    Null texts, languages and sources are empty strings and form groups like others. Rows that repeat count each. A language that keeps
    no term has pairs of value 0 and no terms; an empty table gives no rows. Ties go by item, in order of UTF-8. Other columns are not read.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    entry = F.struct("source", "n")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("parts")).filter(F.col("docs") >= least_docs)
    # One row a kept term: its count, and the sources that have it (as many as a language has sources; the result has a row for each two of them).
    kept = stored(kept.select("lang", "term", "n", "parts"), "kept-terms")
    each = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("parts"))
    single = stored(each.groupBy("lang", "source", "n").agg(F.count("*").alias("h")), "histograms")

    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    sums = single.groupBy("lang", "source").agg(F.sum("h").alias("terms"), F.sum(F.col("n") * F.col("h")).alias("total"))
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    groups = groups.join(languages, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "terms", "total"])
    groups = stored(groups, "groups")
    few = small_or_shuffled(groups, groups.count())

    side = lambda x: few.select("lang", F.col("source").alias(x), F.col("terms").alias(f"terms_{x}"), F.col("total").alias(f"total_{x}"), *(["v"] if x == "a" else []))
    pairs = stored(side("a").join(side("b"), "lang").filter("a < b"), "pairs")
    zero = F.lit(0).cast("long")
    cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    ca, cb, m = F.col("ca"), F.col("cb"), F.col("m")
    both = kept.select("lang", "parts").mapInArrow(_joint, "lang string, a string, b string, ca long, cb long, m long")
    # A term that both have is in neither's zero cells.
    both = both.select("lang", "a", "b", F.inline(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))))
    ends = pairs.select("lang", "a", "b", cell(zero, zero, F.col("v") - F.col("terms_a") - F.col("terms_b")).alias("c")).select("lang", "a", "b", "c.*")
    ids = pairs.select("lang", "a", "b")
    one = ids.join(single.select("lang", F.col("source").alias("a"), F.col("n").alias("ca"), F.col("h").alias("m")), ["lang", "a"]).select("lang", "a", "b", "ca", zero.alias("cb"), "m")
    other = ids.join(single.select("lang", F.col("source").alias("b"), F.col("n").alias("cb"), F.col("h").alias("m")), ["lang", "b"]).select("lang", "a", "b", zero.alias("ca"), "cb", "m")
    tally = both.unionByName(ends).unionByName(one).unionByName(other).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).filter("m <> 0 or (ca = 0 and cb = 0)")
    tally = tally.join(small_or_shuffled(pairs, pairs.count()), ["lang", "a", "b"])
    f = F.abs(share("ca", "total_a", "v") - share("cb", "total_b", "v"))
    value = tally.groupBy("lang", "a", "b").agg(F.sum(F.coalesce(m * f, zero)).alias("value"))
    turned = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    far = value.select("lang", "value", turned).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    own, of_lang = share("n", "total", "v"), share("lang_n", "lang_total", "v")
    terms = each.join(few, ["lang", "source"]).withColumn("value", own - of_lang).filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return far.withColumn("rank", rank).select(*columns).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top).select(*columns))
