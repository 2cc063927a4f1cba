"""Token-id storage: a shared zstandard dictionary, one compressed frame per document, an offset index.

A store is a folder with two Parquet tables, so that any file system Spark writes to will do and a lost executor's files
are written again:

* ``dictionary``: dict_sha256, width (bytes of a serialized id), content (of no bytes where there was too little to train on), samples. One row.
* ``blocks``: shard, block, dict_sha256, first_id and last_id, payload (frames in a row), and the offset index of the block: doc_ids,
  offsets, lengths (bytes of each frame) and counts (ids of each document). Shards and blocks ascend with doc_id.

A document is read by its index entry alone: one slice of one payload, and the dictionary.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import slices, small_batches
from .encode import UnitEncoder, encoder

#: The dictionary is trained on so many documents at most, of each its first so many characters, in pieces of so many bytes.
SAMPLE_DOCS, SAMPLE_CHARS, PIECE_BYTES = 2000, 16_384, 1024
DICT_BYTES = 64 * 1024
#: Texts are encoded in portions of about so many characters where the words to remember are bounded.
PORTION_CHARS = 256 << 10
#: A block holds frames of about so many bytes.
BLOCK_BYTES = 2 << 20
LEVEL = 3
#: Ranges of ids that a fetch asks for at most.
MOST_RANGES = 50

BLOCKS = "shard long, block long, dict_sha256 string, first_id long, last_id long, payload binary, doc_ids array<long>, offsets array<long>, lengths array<long>, counts array<long>"


def token_ids(texts: list[str | None], path: str, keeps_spaces: bool, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all whole texts in a row, each with the end id behind it, where each ends); null is empty."""
    own, counts = encoder(path, keeps_spaces).encode([t or "" for t in texts])
    ends = np.cumsum(counts + 1)
    ids, within = np.full(len(own) + len(ends), end_id, np.uint32), np.ones(len(own) + len(ends), bool)
    within[ends - 1] = False
    ids[within] = own
    return ids, ends


def token_arrays(texts: list[str | None], path: str, keeps_spaces: bool, end_id: int, remembered: int | None = None) -> list[np.ndarray]:
    """Ids of each whole text (null: empty) with the end id appended, each in an array of its own. Where ``remembered`` bounds the words, texts are
    encoded in portions, as the bound is only kept between them."""
    if remembered:
        ends = np.cumsum([len(t or "") for t in texts]) // PORTION_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        portions = [texts[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    else:
        portions = [texts]
    return [own for part in portions for own in _arrays(part, encoder(path, keeps_spaces, remembered), end_id)]


def _arrays(texts: list[str | None], units: UnitEncoder, end_id: int) -> list[np.ndarray]:
    ids, counts = units.encode([t or "" for t in texts])
    out, at = [], 0
    for n in counts.tolist():
        own = np.empty(n + 1, np.uint32)
        own[:n], own[n] = ids[at : at + n], end_id
        out.append(own)
        at += n
    return out


def train_dictionary(docs: DataFrame, path: str, keeps_spaces: bool, end_id: int, width: int) -> tuple[bytes, int]:
    """(a zstandard dictionary, samples that it was trained on) from the serialized ids of a bounded sample: of the SAMPLE_DOCS documents with the smallest id hash
    the first SAMPLE_CHARS characters each, in pieces of PIECE_BYTES at most. Too few or too like samples give a dictionary of no bytes, and an empty table none."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    found = docs.select("doc_id", F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    texts = sorted(r.text for r in found.select("text").limit(2 * SAMPLE_DOCS).collect())
    whole = [a.astype(f"<u{width}").tobytes() for a in token_arrays(texts, path, keeps_spaces, end_id)]
    samples = [w[k : k + PIECE_BYTES] for w in whole for k in range(0, len(w), PIECE_BYTES)]
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    if size < 1024 or len(samples) < 16:
        return b"", len(samples)  # too little to train on
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes(), len(samples)
    except zstandard.ZstdError:  # samples too alike or too short for the trainer
        return b"", len(samples)


def _dictionary(content: bytes, compress: bool = False) -> dict:
    if not content:
        return {}
    own = zstandard.ZstdCompressionDict(content)
    if compress:
        own.precompute_compress(level=LEVEL)  # else each document digests the dictionary anew
    return {"dict_data": own}


def write(docs: DataFrame, store: str, tokenizer: str, keeps_spaces: bool, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the store in ascending doc_id order (null ids first; equal ids in order of their text).

    ``width`` is the bytes of a serialized id (2 for vocabularies up to 65,536); an id that needs more is an error. An empty table gives
    an empty store. Other columns are not read. Document ids are cast to long: one that is no number stops the run.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    content, samples = train_dictionary(docs, tokenizer, keeps_spaces, end_id, width)
    sha = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(sha, width, bytearray(content), samples)], "dict_sha256 string, width int, content binary, samples int").coalesce(1).write.parquet(f"{store}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        made: list[tuple[int | None, bytes, int]] = []
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **_dictionary(content, compress=True))

        def out() -> pa.RecordBatch:
            ids, frames, counts = zip(*made, strict=True)
            lengths = np.array([len(f) for f in frames], np.int64)
            rows = [[shard], [block], [sha], [next((i for i in ids if i is not None), None)], [ids[-1]], [b"".join(frames)], [list(ids)], [np.cumsum(lengths) - lengths], [lengths], [list(counts)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

        held = 0
        for batch in slices(batches):
            ids, ends = token_ids(batch.column(1).to_pylist(), tokenizer, keeps_spaces, end_id)
            if int(ids.max(initial=0)) >> (8 * width):
                raise ValueError(f"id {ids.max()} does not fit in {width} bytes")
            raw, at = memoryview(ids.astype(f"<u{width}").tobytes()), 0
            for i, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                made.append((i, compressor.compress(raw[at * width : end * width]), end - at))
                at = end
                held += len(made[-1][1])
                if held >= BLOCK_BYTES:
                    yield out()
                    made, held, block = [], 0, block + 1
        if made:
            yield out()

    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{store}/blocks")


_BLOCK_NAMES = ["shard", "block", "dict_sha256", "first_id", "last_id", "payload", "doc_ids", "offsets", "lengths", "counts"]
_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]


def _open(spark: SparkSession, store: str) -> tuple[DataFrame, str, int, bytes]:
    found = spark.read.parquet(f"{store}/dictionary").first()
    content = bytes(found.content)
    if hashlib.sha256(content).hexdigest() != found.dict_sha256:
        raise ValueError(f"the dictionary of {store} does not have the hash it is stored under")
    return spark.read.schema(BLOCKS).parquet(f"{store}/blocks"), found.dict_sha256, found.width, content


def index(spark: SparkSession, store: str) -> DataFrame:
    """The offset index: doc_id, shard, block, offset, length, n_tokens. Payloads are not read."""
    rows, *_ = _open(spark, store)
    zipped = F.explode(F.arrays_zip("doc_ids", "offsets", "lengths", "counts")).alias("e")
    return rows.select("shard", "block", zipped).select(
        F.col("e.doc_ids").alias("doc_id"), "shard", "block", F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("length"), F.col("e.counts").alias("n_tokens")
    )


def fetch(spark: SparkSession, store: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents. Blocks are found by their first and last id, which Parquet's statistics prune, so other payloads
    are not read; of those that are, only the wanted frames are cut out and decompressed. Unknown ids give no row, a repeated id all of its."""
    rows, _, width, content = _open(spark, store)
    ids = sorted(set(ids))
    step = -(-len(ids) // MOST_RANGES) or 1
    near = F.lit(False)
    for k in range(0, len(ids), step):
        near = near | ((F.col("first_id") <= ids[min(k + step, len(ids)) - 1]) & (F.col("last_id") >= ids[k]))
    rows = rows.filter(near)
    entries = rows.select("payload", F.explode(F.arrays_zip("doc_ids", "offsets", "lengths")).alias("e")).filter(F.col("e.doc_ids").isin(ids))
    frames = entries.select(F.col("e.doc_ids").alias("doc_id"), F.expr("substring(payload, cast(e.offsets + 1 as int), cast(e.lengths as int))").alias("frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor(**_dictionary(content))
        for b in batches:
            out = [np.frombuffer(d.decompress(f), f"<u{width}").astype(np.int64) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return frames.mapInArrow(run, "doc_id long, ids array<long>")


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """Decode every frame: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of ids as little-endian unsigned 32 bits).

    Repeated and null ids have a row for each stored document; an empty store gives none. A block of another dictionary is an error."""
    rows, sha, width, content = _open(spark, store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor(**_dictionary(content))
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(7)]  # as selected below
            out: list[tuple] = []
            for shard, block, own, payload, ids, offsets, lengths in zip(*cols, strict=True):
                if own != sha:
                    raise ValueError("a block was written with another dictionary")
                before, view = 0, memoryview(payload)
                for i, at, n in zip(ids, offsets, lengths, strict=True):
                    a = np.frombuffer(d.decompress(view[at : at + n]), f"<u{width}")
                    out.append((shard, block, i, before, len(a), zlib.crc32(a.astype("<u4").tobytes())))
                    before += len(a)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], ["shard", "block", "doc_id", "before", "n_tokens", "ids_crc32"])

    # Ids before each block: within a shard over its blocks, and over the shards' sums, of which there are as many as write tasks.
    sums = rows.select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = sums.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("block_start"))
    starts = within.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("at"))
    decoded = rows.select("shard", "block", "dict_sha256", "payload", "doc_ids", "offsets", "lengths").mapInArrow(run, "shard long, block long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["shard", "block"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
