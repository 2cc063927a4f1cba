"""Values that are evaluated once, and folds over arrays in about linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that a running fold takes at once: an array that grows element by element is copied each time, so it is kept short.
FOLD = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """``posexplode`` of a column that costs much: the rows that it has none for go behind it, as the filter that an inner one infers computes the column again."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.posexplode_outer(column).alias(*names)).filter(F.col(names[0]).isNotNull())


def running(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` what ``first`` and those before it come to under an associative ``op`` (a sum, a maximum). Folds blocks on their own
    and then the blocks' results, so time grows hardly faster than the number of values."""

    def steps(a: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.slice(F.array(at), F.lit(1), F.lit(0)).alias("out"))
        return F.aggregate(a, begin, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def folded(blocks: Column) -> Column:
        before = steps(F.transform(blocks, lambda b: F.aggregate(b, first, op)), first)
        return F.flatten(F.zip_with(blocks, before, steps))

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / FOLD).cast("int")), lambda k: F.slice(a, k * FOLD + 1, F.lit(FOLD)))
    none = F.slice(F.array(first), F.lit(1), F.lit(0))
    return let(values, lambda a: F.when(F.size(a) > 0, let(cut(a), folded)).otherwise(none))


def replaced(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with ``change`` of each match of a pattern in its place: it is split at the matches and put together again."""

    def joined(m: Column, gaps: Column) -> Column:
        changed = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda gap, x: F.concat(gap, change(x)))
        return F.concat(F.array_join(changed, ""), F.get(gaps, F.size(m)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda gaps: joined(m, gaps))).otherwise(text))
