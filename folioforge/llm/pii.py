"""Personal data by weak supervision.

Candidates are all matches of the base patterns, valid or not, and of wider patterns: forms that the base rules know nothing of, and
numbers that a base match swallowed together with something else. Labelers (the base rules' own checks, checksums, gazetteers, what
stands around a candidate) each vote for, against or not at all. Expectation-maximisation over the counts of vote patterns of each
kind estimates how reliable each labeler is and so how likely each pattern is personal data; a logistic span classifier is then
trained on these probabilities from the kind, votes and shape of a span. Both need only the counts of patterns, of which there are as
many as ways to vote, however large the corpus is. Spans of the base rules have a fixed definition and always stay; the
classifier decides on all other candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spans import let, running, with_matches

# Base kinds in the order in which they are listed, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("masked_email", "local_phone", "iban", "ssn", "name")
KINDS = BASE_KINDS + ADDED_KINDS
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Gazetteers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
FIRST_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "Hans", "Peter", "Anna", "Klaus", "Jean", "Pierre", "Marie", "Sophie", "Carlos", "María", "José", "Carmen")
DOMAINS = "(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)\\z"
IBAN_COUNTRIES = "^(DE|FR|ES|GB|IT|NL|AT|BE|CH)"
#: First digits of card issuers, and country codes of telephone numbers.
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6(011|5))"
COUNTRIES = r"^\+(1|33|34|39|4[0-9]|81|86|91)(?![0-9])"
CUES = ("phone", "tel", "call", "mobile", "fax", "mail", "contact", "iban", "account", "konto", "compte", "cuenta", "ssn", "social", "name", "telefon", "téléphone", "teléfono", "write to", "reach", "card", "visa", "host", "server", "address")
AGAINST = ("version", "isbn", "fig", "section", "page", "model", "serial", "order", "price", "€", "$", "no.", "token", "key", "hash", "id")

# Possessive repeats and look-behinds keep long runs linear; with \G they allow what follows a match directly.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "masked_email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[({{]at[\])}}] ?{_HOST}++(?: ?(?:\.|[\[({{]dot[\])}}]) ?{_HOST}++)++",
    "number": r"(?<![0-9A-Za-z+-])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z-])",
    "name": rf"(?<![\p{{L}}])(?=[{''.join(sorted({n[0] for n in TITLES + FIRST_NAMES}))}])(?:(?:{'|'.join(TITLES)})\.? |(?:{'|'.join(FIRST_NAMES)}) )\p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?",
    # Card and telephone numbers with edges of their own, also beside other numbers.
    "lone_card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z-])",
    "lone_phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z-])",
}
LABELERS = ("rule", "checksum", "gazetteer", "cue", "against", "edges", "plain_digits")
FEATURES = ("long", "spaced", "mostly_digits", "starts_line", "ends_sentence")
#: Digits that a base card match has at least to be a candidate.
LEAST_DIGITS = 12
#: What is held of labelers before seeing votes: how often each class gets -1, 0 and 1, as so many observations. The first two, which compute
#: rather than look around, count for TRUST of all candidates besides, so that no chance agreement of the others can outvote them.
PRIOR = ((4.0, 2.0, 1.0), (1.0, 2.0, 4.0))
TRUSTED, TRUST = 2, 0.25
TRUSTED_PRIOR = ((0.8, 0.15, 0.05), (0.02, 0.18, 0.8))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        own = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(own > 4, own * 2 - 9).otherwise(own * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(own)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x["text"].rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.when(F.length(_digits(x["text"])).between(14, 19), _luhn(_digits(x["text"]))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x["text"])).between(10, 15)
    return F.lit(True)


def _ranked(kind: str, rank: int) -> Column:
    """The valid matches of a base kind."""
    return F.transform(F.filter(kind, lambda x: _valid(kind, x)), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 neither."""
    return F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)


def _judged(kind: Column, x: Column, is_base: bool) -> Column:
    """start, end, kind, whether it is a match of a base pattern, votes and features of a candidate."""
    text, before, digits = x["text"], F.lower(x["before"]), _digits(x["text"])
    luhn = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    is_card, is_phone, is_number = kind == "card", (kind == "phone") | (kind == "local_phone"), ~kind.isin("email", "masked_email", "name")
    rule = (
        F.when(kind == "ip", text.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"))
        .when(is_card, F.length(digits).between(14, 19) & luhn)
        .when(is_phone, F.length(digits).between(10, 15))
        .when(kind == "iban", text.rlike(r"\A[A-Z]{2}[0-9]{2}( [A-Z0-9]{4})+"))
        .when(kind == "masked_email", text.rlike("(?i)dot|\\."))
        .when(kind == "name", text.rlike(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+\z"))
        .otherwise(F.lit(True))
    )
    checked = F.when(is_card, luhn).when(kind == "ssn", ~text.rlike("^(000|666|9)")).when(kind == "local_phone", ~digits.rlike("^[01]")).when(kind == "ip", ~text.rlike(r"^0+\."))
    listed = (
        F.when(is_card, digits.rlike(ISSUERS))
        .when(kind == "phone", text.rlike(COUNTRIES))
        .when(kind == "iban", text.rlike(IBAN_COUNTRIES))
        .when((kind == "email") | (kind == "masked_email"), text.rlike(DOMAINS))
        .when(kind == "name", _any_of(text, FIRST_NAMES))
    )
    # Base patterns have no edges of their own: a match within a longer run of letters and digits is a part of something else.
    torn = x["before"].rlike(r"[0-9A-Za-z]\z") | x["after"].rlike(r"\A[0-9A-Za-z]")
    votes = F.array(
        _vote(rule, ~rule),
        _vote(F.coalesce(checked, F.lit(False)), F.coalesce(~checked, F.lit(False))),
        _vote(F.coalesce(listed, F.lit(False)), F.coalesce(~listed, F.lit(False))),
        _vote(_any_of(before, CUES)),
        _vote(F.lit(False), _any_of(F.right(before, F.lit(15)), AGAINST)),
        _vote(~torn, torn),
        _vote(F.lit(False), is_number & (digits.rlike(r"([0-9])\1{5}") | _any_of(digits, ("123456",)))),
    )
    features = F.array(
        F.length(text) > 16,
        F.contains(text, F.lit(" ")),
        F.length(digits) * 2 > F.length(text),
        x["before"].rlike(r"(\A|\n)\z"),
        x["after"].rlike(r"\A[.!?\n]|\A\z"),
    )
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), F.lit(is_base).alias("is_base"), votes.alias("votes"), features.alias("features"))


def _apart(found: Column, base: Column) -> Column:
    """Those of ``found`` that overlap no span of ``base``: with both in order, none before reaches into it, and the next begins behind it."""
    own = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("new"), b["end"].alias("end"), F.get(F.slice(found, F.lit(1), F.lit(0)), F.lit(0)).alias("c")))
    new = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("new"), c["end"].alias("end"), c.alias("c")))

    def kept(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: F.when(x["new"] == 0, x["end"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        most = F.lit(2**31 - 1)
        ahead = F.reverse(running(F.transform(F.reverse(both), lambda x: F.when(x["new"] == 0, x["start"]).otherwise(most)), most, lambda a, x: F.least(a, x)))
        free = F.zip_with(both, F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), a.alias("ahead"))), lambda x, y: F.when((x["new"] == 1) & (y["reach"] <= x["start"]) & (y["ahead"] >= x["end"]), x["c"]))
        return F.filter(free, lambda c: c.isNotNull())

    return let(F.array_sort(F.concat(own, new)), kept)


def _outermost(spans: Column) -> Column:
    """Spans without those that lie inside another or equal one before them."""
    longest = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["rank"].alias("rank"), x.alias("own"))))
    reach = lambda a: F.zip_with(a, running(F.transform(a, lambda x: -x["back"]), F.lit(0), lambda m, x: F.greatest(m, x)), lambda x, at: F.when(-x["back"] > at, x["own"]))
    return F.filter(let(longest, reach), lambda x: x.isNotNull())


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, row (a struct of the columns of ``keep``, if any), base (valid spans of the base kinds) and found (judged candidates: all
    matches of base patterns, and those of wider ones that overlap no valid span of a base kind).

    Null texts are empty and have no candidates; rows that repeat give equal rows; an empty table gives an empty one.
    """
    text = F.col("__text")
    long_number = text.rlike("[0-9](?:[ -]?[0-9]){11}")
    gates = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        "card": long_number,
        "phone": F.contains(text, F.lit("+")),
        "masked_email": text.rlike(r"[\[({]at[\])}]"),
        "number": text.rlike("[0-9]{2}"),
        "name": F.lit(True),
        "lone_card": long_number,
        "lone_phone": F.contains(text, F.lit("+")),
    }
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    own = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    own = with_matches(own, "__text", {k: (PATTERNS[k], gates[k]) for k in PATTERNS})
    own = own.withColumn("card", F.filter("card", lambda x: F.length(_digits(x["text"])) >= LEAST_DIGITS))
    base = [_ranked(k, r) for r, k in enumerate(BASE_KINDS)]
    own = own.withColumn("base", F.array_sort(F.concat(*base)))
    kind_of = lambda x: F.when(x["text"].rlike("^[A-Z]"), F.lit("iban")).when(x["text"].rlike("^[0-9]{3}-[0-9]{2}-"), F.lit("ssn")).otherwise(F.lit("local_phone"))
    of = lambda column, kind, is_base=False: F.transform(column, lambda x: _judged(kind(x) if callable(kind) else F.lit(kind), x, is_base))
    wide = F.concat(of("masked_email", "masked_email"), of("number", kind_of), of("name", "name"), of("lone_card", "card"), of("lone_phone", "phone"))
    own = own.withColumn("wide", wide)
    found = F.concat(*[of(k, k, True) for k in BASE_KINDS], F.when((F.size("base") == 0) | (F.size("wide") == 0), F.col("wide")).otherwise(_apart(F.col("wide"), F.col("base"))))
    return own.withColumn("found", found).select("doc_id", *["row"] * bool(keep), "base", "found")


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Dawid and Skene's estimates from vote patterns (-1, 0, 1) and their counts: the probability of each pattern, P(vote | class) by labeler, the prior."""
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))  # the majority, softly, to begin with
    table, prior = np.zeros((2, votes.shape[1], 3)), 0.5
    before = np.repeat(np.array(PRIOR)[:, None, :], votes.shape[1], axis=1)
    before[:, :TRUSTED] += TRUST * counts.sum() * np.array(TRUSTED_PRIOR)[:, None, :]
    for _ in range(rounds):
        for c, weight in enumerate(((1 - p) * counts, p * counts)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = ((votes == v) * weight[:, None]).sum(axis=0) + before[c, :, v + 1]
            table[c] /= table[c].sum(axis=1, keepdims=True)
        prior = float(np.clip((p * counts).sum() / max(counts.sum(), 1), 0.05, 0.95))
        logs = [np.log(table[c, np.arange(votes.shape[1]), votes + 1]).sum(axis=1) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -50, 50)))
    return p, table, prior


def fit_logistic(x: np.ndarray, p: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) of a logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (q - p)) + ridge * w
        hess = (x * (counts * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def _inputs(kind: str, votes: list[int], features: list[bool]) -> list[float]:
    """Kind, votes, features, and the two first votes of each kind on their own."""
    own = [float(v) if kind == k else 0.0 for k in KINDS for v in votes[:2]]
    return [float(kind == k) for k in KINDS] + [float(v) for v in votes] + [float(f) for f in features] + own


def fit(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier from ``candidates``' found; zero with a negative bias if there are none."""
    rows = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").count().collect()  # as many as patterns
    rows.sort(key=lambda r: (r.kind, r.votes, r.features))
    if not rows:
        return np.array([0.0] * len(_inputs("", [0] * len(LABELERS), [False] * len(FEATURES))) + [-1.0])
    counts, p = np.array([r["count"] for r in rows], float), np.zeros(len(rows))
    for kind in {r.kind for r in rows}:
        own = np.array([r.kind == kind for r in rows])
        p[own], _, _ = reliabilities(np.array([r.votes for r in rows if r.kind == kind]), counts[own])
    # Counts are damped, so that the rules of one frequent kind don't drown what the others have learned.
    return fit_logistic(np.array([_inputs(r.kind, r.votes, r.features) for r in rows]), p, np.sqrt(counts), ridge=0.1)


def _score(c: Column, w: np.ndarray) -> Column:
    """The classifier's log-odds of a candidate."""
    weights = iter(w.tolist())
    out = F.lit(float(w[-1]))
    for k in KINDS:
        out = out + F.when(c["kind"] == k, next(weights)).otherwise(0.0)
    for j in range(len(LABELERS)):
        out = out + F.get(c["votes"], F.lit(j)) * next(weights)
    for j in range(len(FEATURES)):
        out = out + F.when(F.get(c["features"], F.lit(j)), next(weights)).otherwise(0.0)
    for k in KINDS:
        out = out + F.when(c["kind"] == k, F.get(c["votes"], F.lit(0)) * next(weights) + F.get(c["votes"], F.lit(1)) * next(weights)).otherwise(0.0)
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (a struct of the columns of ``keep``, if any), base and spans (base ones and those that the classifier
    accepts), arrays of (start, rank, kind, end) sorted by start, then order of kinds.

    Null and empty texts have no spans; rows that repeat give equal rows; an empty table gives an empty one.
    Other columns are not read.
    """
    found = stored(candidates(docs, id_col, text_col, keep), "personal-data")
    w = fit(found)
    cut = float(np.log(threshold / (1 - threshold)))
    rank = F.array(*[F.lit(k) for k in KINDS])
    span = lambda c: F.struct(c["start"].alias("start"), (F.array_position(rank, c["kind"]).cast("int") - 1).alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))
    # A match of a base pattern that failed its check can only come back in parts; valid ones are there already, and others overlap none. A number is added once.
    added = _outermost(F.transform(F.filter("found", lambda c: ~c["is_base"] & (_score(c, w) >= cut)), span))
    return found.select("doc_id", *["row"] * bool(keep), "base", F.array_sort(F.concat("base", added)).alias("spans"))
