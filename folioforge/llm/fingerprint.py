"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a text is cut, so equal passages are cut alike wherever they stand. Cuts are normalised:
before the usual length a strict condition must hold, behind it a loose one, so that lengths keep near to it. A fingerprint lists the
text's distinct chunks in order, each as 16 hexadecimal digits of its digest and two of its length less one; how much of
one text lies in another is the length of the chunks that both have over that of all its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, small_batches, stored

#: Bytes that the gear hash sees, at most those of the shortest chunk: what stands before a chunk never counts. Usual and longest chunk.
REACH = 32
LEAST, USUAL, MOST = REACH, 80, 256
#: Highest bits that must be zero for a cut, before and behind the usual length.
STRICT, LOOSE = 9, 4
#: Bytes hashed at once, and rows.
PIECE, ROWS = 1 << 20, 200
_GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, dtype=np.uint32)


def _places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a chunk could end by the strict and by the loose condition: numbers of bytes before the cut, and one beyond all."""
    strict, loose = [], []
    for at in range(0, len(data), PIECE):
        low = max(0, at - REACH + 1)
        h = _GEAR[data[low : at + PIECE]]
        for k in (1, 2, 4, 8, 16):  # the hash over 2k bytes from those over k
            h[k:] += h[:-k] << np.uint32(k)
        h = h[at - low :]
        found = np.flatnonzero(h < 1 << (32 - LOOSE))
        loose.append(found + at + 1)
        strict.append(found[h[found] < 1 << (32 - STRICT)] + at + 1)
    beyond = np.array([np.iinfo(np.int64).max])
    return np.concatenate([*strict, beyond]), np.concatenate([*loose, beyond])


def cuts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each chunk, in order; places count over all texts in a row. Empty texts have none."""
    ends = np.cumsum([len(t) for t in texts])
    strict, loose = _places(np.frombuffer(b"".join(texts), np.uint8))
    text = np.flatnonzero(np.diff(ends, prepend=0))
    at = np.concatenate([[0], ends])[text]
    made = []
    while len(text):  # one chunk of each unfinished text at a time
        early, late = strict[np.searchsorted(strict, at + LEAST)], loose[np.searchsorted(loose, at + USUAL)]
        end = np.minimum(np.minimum(np.where(early < at + USUAL, early, late), at + MOST), ends[text])
        made.append((text, at, end))
        more = end < ends[text]
        text, at = text[more], end[more]
    if not made:
        return (np.zeros(0, np.int64),) * 3
    text, start, end = (np.concatenate(c) for c in zip(*made, strict=True))
    order = np.argsort(start, kind="stable")
    return text[order], start[order], end[order]


def chunk_sets(texts: list[bytes]) -> list[dict[str, int]]:
    """Each text's distinct chunks in order, as entry (digest and length) and length."""
    out: list[dict[str, int]] = [{} for _ in texts]
    data = memoryview(b"".join(texts))
    for k, a, b in zip(*(c.tolist() for c in cuts(texts)), strict=True):
        out[k][f"{xxhash.xxh3_64_intdigest(data[a:b]):016x}{b - a - 1:02x}"] = b - a
    return out


def _held(own: dict[str, int], other: dict[str, int]) -> float:
    """The share of a text, by length of its chunks, that another has; 1 for two empty ones, 0 if one is empty."""
    if not own:
        return float(not other)
    return sum(own[x] for x in own.keys() & other.keys()) / sum(own.values())


def contained(own: Column, other: Column) -> Column:
    """``_held`` of two fingerprints: 0 to 1; null if one is null."""
    entries = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    weight = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.conv(F.substring(x, 17, 2), 16, 10).cast("long") + 1)
    share = weight(F.array_intersect(entries(own), entries(other))) / weight(entries(own))
    return F.when(own.isNull() | other.isNull(), F.lit(None)).when(own == "", (other == "").cast("double")).otherwise(share)


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars (code points), fingerprint. Equal texts have equal ones; null and empty texts have
    the empty one. Rows that repeat give equal rows; an empty table gives an empty one; other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            texts = batch.column(1).to_pylist()
            found = [",".join(s) for s in chunk_sets(list(map(_utf8, texts)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(found, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its second half (rounded down) replaced by as much of the beginning of the following one, or all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprints string, near_edited double, near_next double"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _compared(ids: list[int | None], texts: list[str], following: list[str], own: list[dict], after: list[dict]) -> list[tuple]:
    """Rows of _FOUND for texts, those that follow them, and the chunk sets of both."""
    new = [_utf8(edited(t, f)) for t, f in zip(texts, following, strict=True)]
    rows = zip(ids, texts, new, own, chunk_sets(new), after, strict=True)
    # Both fingerprints in one value: they begin alike, which compresses.
    return [(i, len(t), hashlib.sha256(raw).hexdigest(), f"{','.join(o)}\n{','.join(e)}", _held(o, e), _held(o, a)) for i, t, raw, o, e, a in rows]


def _columns(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each but the last is compared with the one that follows; the first and the last are passed on as
    ``head`` and ``tail`` with their texts."""
    part, types = TaskContext.get().partitionId(), [pa.int32(), pa.string(), pa.string(), *_FOUND_TYPES]
    names = ["part", "kind", "text", *_FOUND_NAMES]
    held: list[tuple[int | None, str, dict]] = []
    edge = lambda kind, row: (part, kind, row[1], row[0], *[None] * 5)
    for batch in slices(batches, ROWS):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [*held, *zip(ids, texts, chunk_sets(list(map(_utf8, texts))), strict=True)]
        out = [] if held or not rows else [edge("head", rows[0])]
        ids, texts, sets = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
        out += [(part, "row", None, *r) for r in _compared(ids[:-1], texts[:-1], texts[1:], sets[:-1], sets[1:])]
        held = rows[-1:]
        yield pa.RecordBatch.from_arrays(_columns(out, types), names)
    yield pa.RecordBatch.from_arrays(_columns([edge("tail", r) for r in held], types), names)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each range with the first one of the next."""
    for batch in slices(batches, ROWS):
        ids, texts, following = (batch.column(k).to_pylist() for k in range(3))
        own, after = (chunk_sets(list(map(_utf8, t))) for t in (texts, following))
        yield pa.RecordBatch.from_arrays(_columns(_compared(ids, texts, following, own, after), _FOUND_TYPES), _FOUND_NAMES)
    release()


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A text is compared with its
    edited form (see ``edited``) and with the next text by descending id; after the last comes the first.

    Null texts are empty: the empty text lies in an empty one (1) and in no other (0). Null ids come last; equal ids go by a hash of
    their text, rows that repeat follow each other. A single row follows itself; an empty table gives an empty one. Other columns are not
    read. Ids are cast to long: one that is no number stops the run.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.desc("doc_id"), F.xxhash64("text")]
    # Texts move once, into ranges; only the first and last text of each range move again.
    passed = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"part int, kind string, text string, {_FOUND}")
    passed = stored(passed, "neighbours", compression="zstd")
    heads = passed.filter("kind = 'head'").select("part", F.col("text").alias("following"))
    parts = passed.filter("kind = 'head'").select("part")
    whole = Window.orderBy("part")  # over one row a range
    after = parts.select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(whole), F.first("part").over(whole)).alias("part"))
    tails = passed.filter("kind = 'tail'").select(F.col("part").alias("before"), "doc_id", "text")
    ends = tails.join(after, "before").join(heads, "part").select("doc_id", "text", "following").mapInArrow(_met, _FOUND)
    both = F.split("fingerprints", "\n")
    out = passed.filter("kind = 'row'").select(*_FOUND_NAMES).unionByName(ends)
    return out.select("doc_id", "n_chars", "edited_sha256", both[0].alias("fingerprint"), both[1].alias("edited_fingerprint"), "near_edited", "near_next")
