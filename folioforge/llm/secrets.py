"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds which rule versions have scanned which
blob and what they found; a scan takes only pairs of blob and rule version that it lacks, each blob once however many paths
or versions have it, and joins findings back to all of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LARGE, stored
from .spans import let, with_matches


@dataclass(frozen=True)
class Rule:
    """A Java pattern, the literals of which a text must hold one, and the least length of a match (or of a group in it)."""

    name: str
    pattern: str
    holds: tuple[str, ...] = ()
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        said = f"{self.pattern}|{self.group}|{self.least}"
        return f"{self.name}@{hashlib.sha256(said.encode()).hexdigest()[:12]}"

    def gate(self, text: Column) -> Column:
        out = F.lit(not self.holds)
        for part in self.holds:
            out = out | F.contains(text, F.lit(part))
        return out

    def valid(self, match: Column) -> Column:
        if not self.least:
            return F.lit(True)
        own = match["text"] if not self.group else F.regexp_extract(match["text"], self.pattern, self.group)
        return F.length(own) >= self.least

    def findings(self) -> Column:
        """The valid matches in the column that has the rule's name."""
        return F.transform(F.filter(self.name, self.valid), lambda x: F.struct(x["start"].alias("start"), F.lit(self.name).alias("kind"), x["end"].alias("end"), F.lit(self.version).alias("rule_version")))


# The base rules, in the order in which they are listed, then rules for public key formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (":", "="), 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA",), 0, 20),
    # Runs of hex digits are maximal, so asking for 24 drops the same runs as measuring them afterwards.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
)
MORE = (
    # Digests in capitals, which the rule for small ones leaves out.
    Rule("hex_upper", r"(?<![0-9A-Za-z])(?=[0-9]*[A-F])[0-9A-F]{24,}+(?![0-9A-Za-z])"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", ("-----BEGIN ",)),
    Rule("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", ("xox",)),
    Rule("google", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}+", ("AIza",)),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+", ("eyJ",)),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{1,100}@", ("://",)),
)
#: Blobs that are scanned where they are not as all others are listed, and broadcast up to so many bytes.
LIST_BYTES = 64 << 20
LEDGER = "blob string, rule_versions array<string>, findings array<struct<start:int,kind:string,end:int,rule_version:string>>"


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rule_versions (those of ``todo``) and findings of blobs with ``text`` and ``todo``."""
    wanted = {r.name: F.array_contains("todo", r.version) for r in rules}
    found = with_matches(blobs, "text", {r.name: (r.pattern, wanted[r.name] & r.gate(F.col("text"))) for r in rules})
    return found.select("blob", F.col("todo").alias("rule_versions"), F.concat(*[r.findings() for r in rules]).alias("findings"))


def scan(versions: DataFrame, path_cols: list[str], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): one row per row of ``versions`` with its path columns, blob and findings (sorted by start, then rule order); the
    ledger, with what was scanned now.

    ``versions`` has every historical version of every path. Null content is that of an empty file. Rows that repeat give equal
    rows; an empty table scans nothing; columns other than the path and the content are not read. Findings of rule versions that are not asked for stay in the ledger and out of the result.
    """
    versions = versions.select(*path_cols, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    addressed = versions.withColumn("blob", F.sha2("__text", 256))
    all_rules = F.array(*[F.lit(r.version) for r in rules])
    # Counts and one path of each blob; texts stay where they are.
    one = F.min(F.struct(*[F.col(c) for c in path_cols])).alias("path")
    blobs = addressed.groupBy("blob").agg(F.count("*").alias("rows"), one)
    if ledger is None:
        blobs = blobs.withColumn("todo", all_rules)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rule_versions"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.when(F.col("seen").isNull(), all_rules).otherwise(F.array_except(all_rules, "seen"))).drop("seen")
    blobs = stored(blobs, "blobs")
    fresh = stored(_scan(_unseen(addressed, blobs, path_cols, all_rules), rules).dropDuplicates(["blob"]), "ledger")
    whole = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    names = [r.name for r in rules]
    asked = F.filter(F.flatten(F.collect_list("findings")), lambda f: F.array_contains(all_rules, f["rule_version"]))
    rank = lambda f: F.struct(f["start"].alias("start"), F.array_position(F.array(*[F.lit(n) for n in names]), f["kind"]).alias("rank"), f["kind"].alias("kind"), f["end"].alias("end"))
    by_blob = whole.filter(F.size("findings") > 0).groupBy("blob").agg(_once(F.array_sort(F.transform(asked, rank))).alias("findings"))
    by_blob = stored(by_blob.join(blobs.select("blob", "rows"), "blob"), "by-blob")
    # Findings of blobs with many paths are broadcast, of which there are BROADCAST_ROWS at most; their rows are dealt by path, not by blob.
    from_rows = max(LARGE, -(-(blobs.agg(F.sum("rows")).first()[0] or 0) // BROADCAST_ROWS))
    large = F.broadcast(by_blob.filter(F.col("rows") >= from_rows).select("blob", F.col("findings").alias("common")))
    paths = addressed.select(*path_cols, "blob").join(large, "blob", "left")
    key = F.when(F.col("common").isNull(), F.col("blob")).otherwise(F.md5(F.to_json(F.struct(*path_cols))))
    few = by_blob.filter(F.col("rows") < from_rows).select(F.col("blob").alias("__key"), "findings")
    none = F.array().cast("array<struct<start:int,rank:bigint,kind:string,end:int>>")
    out = paths.withColumn("__key", key).join(few, "__key", "left").select(*path_cols, "blob", F.coalesce("common", "findings", none).alias("findings"))
    return out, whole


def _unseen(addressed: DataFrame, blobs: DataFrame, path_cols: list[str], all_rules: Column) -> DataFrame:
    """(blob, text, todo) of the blobs that lack rule versions, one row each (several where rows repeat a path and a blob).

    Most blobs have one path and lack all versions, or lack none, so only those that differ are listed: blobs with several paths, of which one scans, and blobs that
    lack some versions or, if these are fewer, that lack any. A list of LIST_BYTES at most is broadcast, and texts are scanned where they are. A longer one is joined by
    shuffle, with one text of each blob from each task, so copies meet in no task.
    """
    some, everything = F.size("todo") > 0, F.col("todo") == all_rules
    listed = blobs.select("blob", "path", "rows", some.alias("some"), F.when(~everything, F.col("todo")).alias("rest"))
    size = F.sum(64 + F.octet_length("blob") + F.length(F.to_json("path")) + F.coalesce(F.size("rest"), F.lit(0)) * 64)
    lacking, differing = listed.filter("some"), listed.filter("rows > 1 or not some or rest is not null")
    bytes_ = [part.agg(F.coalesce(size, F.lit(0))).first()[0] for part in (lacking, differing)]
    whole = F.coalesce("rest", all_rules).alias("todo")
    if min(bytes_) > LIST_BYTES:
        texts = addressed.select("blob", F.col("__text").alias("text")).dropDuplicates(["blob"])
        return texts.join(lacking.select("blob", "rest"), "blob").select("blob", "text", whole)
    path = F.struct(*[F.col(c) for c in path_cols])
    own = addressed.select("blob", F.col("__text").alias("text"), path.alias("own"))
    first = F.col("own").eqNullSafe(F.col("path"))
    if bytes_[0] <= bytes_[1]:
        return own.join(F.broadcast(lacking.select("blob", "path", "rest")), "blob").filter(first).select("blob", "text", whole)
    found = own.join(F.broadcast(differing.select("blob", "path", "some", "rest")), "blob", "left")
    return found.filter(F.col("some").isNull() | (F.col("some") & first)).select("blob", "text", whole)


def _once(spans: Column) -> Column:
    """Sorted values without repeats."""
    return let(spans, lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1) != x)))
