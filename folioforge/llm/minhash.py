"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give every signature coordinate: the first scatters a shingle to a position, the second is read from
that position on, circularly shifted by one for each coordinate. A shingle's contribution to all coordinates is thus one
contiguous slice, and the signature is the minimum over the slices.

Equal shingle sets are one class first, so copies never become pairs. Members of a band's bucket are compared with a few
pivots of the bucket, not with each other; links found so join classes to components. Only classes of buckets that still hold
several components are left, and these go through a prefix filter: with all shingles in one order, those that only one
component has first, two sets with the wanted similarity share a shingle within the first few of both, so only pairs of different components that
do are compared. Every comparison is on full sets. Banding is the only step that can miss a link, with probability
(1 - 0.8**5)**34, about one in 700,000, at a similarity of exactly 0.8 and less above it.

Sets of over about a million shingles fill most positions of the permutations, so they share buckets with others more often; that
costs comparisons and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LARGE, mix, row_key, slices, small_batches, small_or_shuffled, stored, window_hashes, words_of

#: Signature layout: BANDS bands of ROWS coordinates; positions of the two permutations.
BANDS, ROWS, UNIVERSE = 34, 5, 1 << 20
PIVOTS = 3
_ring: list[np.ndarray] = []


def _slices() -> np.ndarray:
    """Row p holds the second permutation from position p on, circularly: what a shingle at p gives to each coordinate."""
    if not _ring:
        order = np.random.default_rng(20).permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([order, order[: BANDS * ROWS]])
        _ring.append(np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS))
    return _ring[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash of 64-bit shingle hashes (at least one)."""
    at = (mix(shingles + np.uint64(0x51ED270B)) >> np.uint64(64 - UNIVERSE.bit_length() + 1)).astype(np.int64)
    out = np.full(BANDS * ROWS, np.iinfo(np.int32).max, np.int32)
    for k in range(0, len(at), 4096):
        np.minimum(out, _slices()[at[k : k + 4096]].min(axis=0), out=out)
    return out


_WEIGHTS = np.random.default_rng(21).integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_SEEDS = np.random.default_rng(22).integers(1, 1 << 63, BANDS, dtype=np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    return mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64) + _SEEDS).view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sets, bands = [], [], []
            for text in batch.column(2).to_pylist():
                s = np.unique(window_hashes(words_of(text), size))
                n.append(len(s))
                sets.append(_set_key(s))
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row", "n_shingles", "set_key", "bands"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(window_hashes(words_of(t), size)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_key", "items"])

    return run


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the smallest node that can be reached. Repeated edges count once; no edges
    give no rows.

    A node that finds a smaller label gives it to the node of its old label as well, so what shared the old label moves together; a
    pointer jump follows. Labels only get smaller, and rounds go on until none changes: then neighbours have equal labels. On chains of
    n nodes (rising, rising then falling, random ids) that took about log2(n) rounds, 18 for 300,000. Each round is written out; joins
    on hub nodes are ones that adaptive execution can split.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    for k in count():
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooks = better.filter("label < old").select(F.col("old").alias("node"), F.lit(None).cast("long").alias("old"), "label")
        moved = better.union(hooks).groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label"))
        jump = moved.select(F.col("node").alias("via"), F.col("label").alias("to"))
        done = stored(moved.join(jump, moved.label == jump.via).select("node", "old", F.col("to").alias("label")), f"{name}-{k}")
        labels = done.select("node", "label")
        if not done.filter("label <> old").take(1):
            return labels


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ia").alias("na"), F.size("ib").alias("nb"), F.size(F.array_intersect("ia", "ib")).alias("n"))
    return both.filter(F.col("n") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _late_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of sets (node, label, items) with different labels that can have 100 * intersection >= percent * union.

    Shingles are ordered as those that only sets of one label have, which find no partner, then all others, rare before frequent. Of a
    set of n, the smaller of a pair shows its first n - ceil(2 * percent * n / (100 + percent)) + 1, the larger its first
    n - ceil(percent * n / 100) + 1; two sets without a common one among these can't be that similar. Nor can those whose first
    common one leaves too few behind it for the intersection. Per shingle, members of its most frequent label meet only those of other labels.
    """
    each = sets.select("node", "label", F.explode("items").alias("item"))
    mixed = each.groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.floor(F.log2(F.count("*")) * 2).alias("often")).filter("lo <> hi").select("item", "often")
    theirs = each.select("node", "item").join(mixed, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("shared"))
    shared = sets.select("node", "label", F.size("items").alias("n")).join(theirs, "node").withColumn("open", F.size("shared"))
    alone = F.col("n") - F.col("open")
    show = lambda share: F.greatest(F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    shared = shared.select("node", "label", "n", "open", show(percent / 100).alias("most"), show(2 * percent / (100 + percent)).alias("few"), "shared").filter("most > 0")
    shown = shared.select("node", "label", "n", "open", "few", F.posexplode(F.slice("shared", F.lit(1), F.col("most"))).alias("at", "s"))
    shown = stored(shown.select("node", "label", "n", (F.col("open") - F.col("at")).alias("behind"), (F.col("at") < F.col("few")).alias("first"), F.col("s.item").alias("item")), "shown")
    labels = shown.groupBy("item", "label").agg(F.count("*").alias("k"))
    met = labels.groupBy("item").agg(F.max_by("label", "k").alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("item", "main")
    shown = stored(shown.join(met, "item").withColumn("rare", F.col("label") != F.col("main")), "met")
    x, y = (shown.select("item", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "behind", "first", "rare")]) for s in "xy")
    smaller = F.struct("n_x", "node_x") < F.struct("n_y", "node_y")
    enough = F.least("behind_x", "behind_y") * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    fits = (F.col("label_x") != F.col("label_y")) & F.col("first_x") & smaller & enough
    both = x.filter("rare_x").join(y, "item").filter(fits).unionByName(x.filter("not rare_x").join(y.filter("rare_y"), "item").filter(fits))
    return both.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, row (tells texts of one id apart, see ``row_key``), n_shingles, component_id, kept, group (a number of
    the component; null without shingles).

    Words are between ASCII white space, A-Z lower-cased; shingles are ``size`` words, or the whole sequence of a shorter text.
    Null, empty and blank texts have no shingles and are their own component. Rows that repeat give equal rows; texts that share an id
    are linked each on its own; a null id is never the smallest of a component, nor kept, and a component of null ids alone
    has the id null. Other columns of ``docs`` are not read. An empty table gives an empty one. Ids are cast to long: one that is no
    number stops the run.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    rows = stored(docs.mapInArrow(_sketches(size), "doc_id long, row long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    # Copies are one class with a number of its own, which is fixed once it is written; its bands are those of any member.
    member = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    classes = rows.filter("set_key is not null").groupBy("set_key").agg(F.min(member).alias("m"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    classes = stored(classes.select("set_key", F.col("m.doc_id").alias("least_id"), "m.row", "rows", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    # Buckets of one class are the many; the others keep their members and a few pivots, the first by PIVOTS orders.
    orders = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("r"), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members"), *orders).filter("members > 1")
    shared = shared.select("bucket", F.array_distinct(F.array(*[f"p{k}.node" for k in range(PIVOTS)])).alias("pivots"))
    members = stored(buckets.join(shared, "bucket"), "members")
    pairs = stored(members.select("node", F.explode("pivots").alias("pivot")).filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")
    # One text of each class that takes part, that of its first member: no text moves but those.
    nodes = stored(classes.join(members.select("node").distinct(), "node").select("node", "set_key", "least_id", F.col("row").alias("own")), "nodes")
    n_nodes = nodes.count()
    wanted = small_or_shuffled(nodes.select("least_id", "own"), n_nodes)
    chosen = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.least_id) & (docs.row == wanted.own), "left_semi")
    full = chosen.select("text").mapInArrow(_full_sets(size), "set_key binary, items array<long>")
    sets = stored(full.join(small_or_shuffled(nodes.select("set_key", "node"), n_nodes), "set_key").select("node", "items").dropDuplicates(["node"]), "sets")
    links = stored(_linked(pairs, sets, percent), "links")
    labels = components(links)
    # What is left: classes that share a bucket but no component yet.
    labelled = members.select("node", "bucket").join(labels, "node", "left").select("node", "bucket", F.coalesce("label", "node").alias("label"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rest = labelled.join(split, "bucket", "left_semi").select("node", "label").distinct()
    late = _late_pairs(stored(sets.join(rest, "node"), "rest"), percent)
    late = stored(_linked(stored(late.join(pairs, ["a", "b"], "left_anti"), "late-pairs"), sets, percent), "late")
    if late.take(1):
        labels = components(links.union(late), "all")
    joined = classes.select("set_key", "least_id", "rows", "node").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    ids = joined.groupBy("group").agg(F.min("least_id").alias("component_id"))
    named = stored(joined.join(ids, "group").select("set_key", "rows", "group", "component_id"), "named")
    # Names of large classes are broadcast: there are BROADCAST_ROWS of them at most. Their rows are dealt by row, not by class.
    from_rows = max(LARGE, -(-rows.count() // BROADCAST_ROWS))
    large = F.broadcast(named.filter(F.col("rows") >= from_rows).select("set_key", F.col("group").alias("g"), F.col("component_id").alias("c")))
    own = rows.select("doc_id", "row", "n_shingles", "set_key").join(large, "set_key", "left")
    spread = F.unhex(F.md5(F.concat_ws(" ", "doc_id", "row").cast("binary")))
    own = own.withColumn("key", F.when(F.col("g").isNull() & F.col("set_key").isNotNull(), F.col("set_key")).otherwise(spread))
    small = named.filter(F.col("rows") < from_rows).select(F.col("set_key").alias("key"), "group", "component_id")
    out = own.join(small, "key", "left").select("doc_id", "row", "n_shingles", F.coalesce("g", "group").alias("group"), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("c", "component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
