"""Matches of a pattern with their places, from DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
#: Characters of context kept on either side of a match.
BEFORE, AFTER = 40, 20


#: Elements that a running fold takes at once, and characters of a piece of text: an array that grows element by element is copied each time, and a
#: place in a text is counted from its beginning, so both are short.
FOLD, PIECE = 256, 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


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


def _placed(m: Column, s: Column) -> Column:
    """Matches m with their places among the pieces s between them."""
    n = F.size(m)
    before = running(F.zip_with(F.slice(s, F.lit(1), n), m, lambda gap, x: F.length(gap) + F.length(x)), F.lit(0), lambda a, x: a + x)
    around = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def one(x: Column, g: Column) -> Column:
        start = x["at"] + F.length(g["a"])
        return F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end"), x["text"].alias("text"), F.right(g["a"], F.lit(BEFORE)).alias("before"), F.left(g["b"], F.lit(AFTER)).alias("after"))

    own = F.zip_with(F.zip_with(m, before, lambda t, at: F.struct(t.alias("text"), at.alias("at"))), around, one)
    return F.when(n > 0, own).otherwise(F.array().cast(MATCH))


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds one column per pattern: its leftmost non-overlapping matches, as MATCH; places are code points, ends exclusive.

    ``patterns`` maps a column name to a Java pattern and a condition that is true wherever the pattern can match. Splitting at
    the pattern gives what lies between the matches, whose lengths add up to the places.
    """
    found = {n: F.when(gate, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for n, (p, gate) in patterns.items()}
    df = df.withColumns({f"{n}_m": c for n, c in found.items()})
    rest = {n: F.when(F.size(f"{n}_m") > 0, F.split(F.col(text), p, -1)).otherwise(F.array().cast("array<string>")) for n, (p, _) in patterns.items()}
    df = df.withColumns({f"{n}_s": c for n, c in rest.items()})
    placed = {n: _placed(F.col(f"{n}_m"), F.col(f"{n}_s")) for n in patterns}
    return df.withColumns(placed).drop(*[f"{n}_{x}" for n in patterns for x in "ms"])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs that have these fields."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_reach(spans: Column, end: str = "end") -> Column:
    """(span, before) of spans sorted by start: ``before`` is where the last of the spans before it ends, 0 for the first."""
    reach = running(F.transform(spans, lambda x: x[end]), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.zip_with(spans, reach, lambda x, at: F.struct(x.alias("span"), at.alias("before")))


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of a text in pieces of PIECE characters."""
    low, high = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    far = F.concat(F.substring(piece(low), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, low + 2, F.greatest(high - low - 1, F.lit(0))), ""), F.substring(piece(high), F.lit(1), b % PIECE))
    return F.when(low == high, F.substring(piece(low), a % PIECE + 1, F.greatest(b - a, F.lit(0)))).otherwise(far)


def redacted(text: Column, spans: Column) -> Column:
    """The text with the union of its spans (sorted by start) replaced by the kind of the first of those that overlap, in brackets."""

    def marked(pieces: Column) -> Column:
        first = F.filter(with_reach(spans), lambda x: x["span"]["start"] >= x["before"])
        said = F.transform(first, lambda x: F.concat(_between(pieces, x["before"], x["span"]["start"]), F.lit("["), F.upper(x["span"]["kind"]), F.lit("]")))
        rest = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        return F.concat(F.array_join(said, ""), _between(pieces, rest, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), marked)).otherwise(text)
