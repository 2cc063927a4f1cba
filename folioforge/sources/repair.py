"""Repair of untrusted JSON records by tables of rules: fields of a wrong kind get a default, numbers are clamped, strings cut, records without what they need dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.folds import let, running


@dataclass(frozen=True)
class Field:
    """A field of a record: its kind (string, long, double or boolean) and what holds for it.

    A value of another kind, an empty string where ``filled``, and one that ``pattern`` or ``choices`` don't admit count as absent. What is present is rounded (halves
    upwards; always for long), clamped to ``least`` and ``most``, and cut to ``longest`` characters. What is absent takes ``default``, a value or a function of the
    record; without ``default`` a ``required`` field drops the record.
    """

    name: str
    kind: str = "string"
    default: object = None
    required: bool = False
    filled: bool = False
    rounded: bool = False
    least: float | None = None
    most: float | None = None
    longest: int | None = None
    pattern: str | None = None
    choices: tuple[str, ...] = ()


def _kind_of(value: Column) -> Column:
    def said(kind: Column) -> Column:
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
        return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(number, "number")

    return let(F.schema_of_variant(value), said)


def _present(record: Column, f: Field) -> Column:
    """The field's value, or null if it counts as absent."""

    def filled(own: Column) -> Column:
        wrong = [own == ""] * f.filled + [~own.rlike(f.pattern or "")] * bool(f.pattern) + [~own.isin(*f.choices)] * bool(f.choices)
        for w in wrong:
            own = F.when(~w, own)
        return F.left(own, F.lit(f.longest)) if f.longest else own

    def clamped(own: Column) -> Column:
        bound = F.greatest(own, F.lit(float(f.least))) if f.least is not None else own
        bound = F.least(bound, F.lit(float(f.most))) if f.most is not None else bound
        return F.when(own.isNotNull(), bound).try_cast(f.kind)

    def finite(own: Column) -> Column:
        own = F.when(F.abs(own) < float("inf"), own)
        return F.floor(own + 0.5).cast("double") if f.rounded or f.kind == "long" else own

    def held(value: Column) -> Column:
        kind = _kind_of(value)
        if f.kind == "string":
            return let(F.when(kind == "string", F.try_variant_get(value, "$", "string")), filled)
        if f.kind == "boolean":
            return F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean"))
        return let(let(F.when(kind == "number", F.try_variant_get(value, "$", "double")), finite), clamped)

    return let(F.try_variant_get(record, f"$.{f.name}", "variant"), held)


def repaired(json: Column, fields: tuple[Field, ...]) -> Column:
    """A struct of the fields of a JSON text. Null if it is no object, if it is null, or if a required field is absent; a table without required fields gives
    its defaults then."""

    def whole(record: Column) -> Column:
        is_object = F.coalesce(F.startswith(F.schema_of_variant(record), F.lit("OBJECT")), F.lit(False))

        def built(own: Column) -> Column:
            values, needed = [], F.lit(True)
            for f in fields:
                default = f.default(record) if isinstance(f.default, Callable) else F.lit(f.default).cast(f.kind)
                values.append((own[f.name] if f.default is None else F.coalesce(own[f.name], default)).alias(f.name))
                needed = needed & own[f.name].isNotNull() if f.required else needed
            return F.when(needed, F.struct(*values))

        return let(F.when(is_object, F.struct(*[_present(record, f).alias(f.name) for f in fields])), built)

    return let(F.try_parse_json(json), whole)


def depth(json: Column) -> Column:
    """How deep objects and arrays of a JSON text nest; brackets within strings, and quotes that are escaped there, don't count."""
    bare = F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), r'"[^"]*"?', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), lambda b: F.when(b.isin("[", "{"), 1).otherwise(-1))
    reached = let(steps, lambda s: F.array_max(F.zip_with(running(s, F.lit(0), lambda a, x: a + x), s, lambda a, x: a + x)))
    return F.when(json.isNotNull(), F.greatest(F.coalesce(reached, F.lit(0)), F.lit(0)))


def _place(record: Column) -> Column:
    part = lambda name: F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit("0"))
    return F.concat_ws("-", *map(part, ("chapterId", "paragraph", "offset", "createdAt")))


# Ranges, lengths and defaults of the records.
SETTINGS = (
    Field("theme", default="light", choices=("light", "dark", "black", "eink", "paper")),
    Field("font", default="system", choices=("system", "hei", "serif", "kai")),
    Field("fontSize", "long", 18, least=14, most=28),
    Field("lineHeight", "double", 1.8, least=1.3, most=2.4),
    Field("paraGap", "double", 0.7, least=0, most=1.6),
    Field("margin", "long", 20, least=8, most=64),
    Field("maxWidth", "long", 36, least=24, most=60),
    *[Field(name, "boolean", default) for name, default in (("paperTexture", True), ("autoHideBars", True), ("prefetch", True), ("cleanSiteText", True), ("keepScreenAwake", False), ("hideStatusBar", False))],
)
PROGRESS = (Field("chapterId", required=True), Field("chapterIndex", "double"), Field("paragraph", "double", 0.0, least=0), Field("offset", "double", 0.0, least=0), Field("updatedAt", "double", 0.0))
BOOKMARK = (Field("id", default=_place, filled=True), Field("chapterId", required=True), Field("chapterTitle", default=""), Field("chapterIndex", "double"), Field("paragraph", "double", 0.0), Field("offset", "double", 0.0), Field("excerpt", default=""))
HISTORY = (Field("chapterId", required=True), Field("chapterTitle", default=""), Field("chapterIndex", "double"), Field("at", "double", 0.0))
BOOK = (
    Field("id", required=True, pattern=r"\A(?:[1-9][0-9]{0,8}|[a-z0-9]{1,12}-[1-9][0-9]{0,8})\z"),
    Field("title", required=True, filled=True, longest=100),
    Field("author", default="", longest=60),
    *[Field(name, filled=True, longest=n) for name, n in (("category", 100), ("status", 100), ("intro", 1000), ("latestChapter", 100))],
    Field("firstChapterId", pattern=r"\A[0-9]{1,12}\z"),
)
