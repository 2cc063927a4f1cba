"""Packing by vector bin packing: sequences limited in tokens, segments and loss-bearing tokens at once.

What can be taken of an example, whole or cut to what a sequence has left, is its demand; the example of largest dot product
between demand and room, both relative to the limits, comes next. Whole examples go before cut ones, but the last segment that a
sequence may have is the one that fills it best. A sequence that can't be filled is cut to a power of two, so no sequence needs
padding; what is cut off goes back to the examples. Windows of documents are packed on their own: nothing is shuffled, memory is
that of one window.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .tokenstore import token_arrays

#: A window ends at so many documents or characters, whichever comes first.
WINDOW_DOCS, WINDOW_CHARS = 1024, 4 << 20
_SEQUENCES_PER_TASK = 1 << 36


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens (a power of two), segments, and tokens that bear loss. All of an example's tokens but
    the first of each segment bear loss, unless its loss share says that fewer do."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


def pack_window(sizes: np.ndarray, shares: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Pieces (example, start, length, sequence, offset) that hold each token of each example exactly once.

    ``shares`` is the part of an example's tokens that bears loss, from 0 to 1.
    """
    size = sizes.astype(np.int64).copy()
    start = np.zeros(len(size), np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    tokens, loss = limits.tokens, float(limits.loss)

    def demand(n: np.ndarray, share: np.ndarray, room: int, slack: float) -> np.ndarray:
        """The most tokens of each example that fit; the first of a segment bears no loss."""
        return np.minimum(np.minimum(n, room), np.floor(slack / share + 1e-9) + 1).astype(np.int64)

    def bearing(n, share):
        return np.ceil((n - 1) * share - 1e-9)

    every = np.maximum(shares, 1e-12)
    # Whole sequences of one long example need no choice.
    for k in np.flatnonzero(size > tokens):
        full = 1 << (int(demand(size[k : k + 1], every[k : k + 1], tokens, loss)[0]).bit_length() - 1)
        for _ in range((size[k] - 1 - tokens) // full + 1):
            pieces.append((int(k), int(start[k]), full, sequence, 0))
            start[k], size[k], sequence = start[k] + full, size[k] - full, sequence + 1
    # Examples that are left, with their sizes, shares and loss-bearing tokens, in the first ``count`` places of four arrays.
    ids = np.flatnonzero(size > 0)
    n, share = size[ids], every[ids]
    need = bearing(n, share)
    count = len(ids)
    while count:
        room, segments, slack = tokens, limits.segments, loss
        chosen: list[tuple[int, int]] = []
        while room and segments and count:
            left, wanted = n[:count], need[:count]
            # Every example takes one segment, so that dimension adds the same to each product.
            by_room, by_slack = room / tokens**2, slack / max(loss, 1.0) ** 2
            whole = (left <= room) & (wanted <= slack)
            at = int(np.argmax((left * by_room + wanted * by_slack + 1e-9) * whole)) if segments > 1 else 0
            take = int(left[at])
            if segments == 1 or not whole[at]:
                part = demand(left, share[:count], room, slack)
                at = int(np.argmax(part * by_room + bearing(part, share[:count]) * by_slack))
                take = int(part[at])
            k = int(ids[at])
            chosen.append((k, take))
            room, segments, slack = room - take, segments - 1, slack - float(bearing(take, share[at]))
            size[k] -= take
            if size[k]:
                n[at], need[at] = size[k], bearing(size[k], share[at])
                break  # it was cut to what was left
            count -= 1
            for a in (ids, n, share, need):
                a[at] = a[count]
        used = sum(t for _, t in chosen)
        over = used - (1 << (used.bit_length() - 1))
        for j in range(len(chosen) - 1, -1, -1):  # cut off what exceeds a power of two
            k, take = chosen[j]
            back = min(over, take)
            chosen[j], over = (k, take - back), over - back
            if back:
                at = count if not size[k] else int(np.flatnonzero(ids[:count] == k)[0])
                size[k] += back
                ids[at], n[at], share[at], need[at] = k, size[k], every[k], bearing(size[k], every[k])
                count = max(count, at + 1)
        offset = 0
        for k, take in chosen:
            if take:
                pieces.append((k, int(start[k]), take, sequence, offset))
                start[k], offset = start[k] + take, offset + take
        sequence += 1
    return pieces


def reply_share(text: str) -> float:
    """The loss share of a text read as a dialogue whose every second line is a reply: the characters of those lines by those of all lines;
    1 for a text of one line or none."""
    lines = list(map(len, text.split("\n")))
    return sum(lines[1::2]) / sum(lines) if len(lines) > 1 and sum(lines) else 1.0


def pack(docs: DataFrame, tokenizer: str, keeps_spaces: bool, end_id: int, limits: Limits = Limits(), loss: Column | Callable[[str], float] | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if asked, ids.

    Every whole text (null: empty) is encoded with ``end_id`` appended. ``loss`` is the share of loss-bearing tokens, as
    a column (null: all) or a function of the text. Rows are packed as they come, so repeated ids stay apart; a null id stays null. Sequence ids
    are unique, not dense. ``remembered`` bounds the distinct words whose ids a worker keeps, which trades memory for time. An empty table gives an empty one. Ids are cast to long: one that is no number stops the run.
    """
    small_batches(docs.sparkSession)
    share = F.coalesce(loss.cast("double"), F.lit(1.0)) if isinstance(loss, Column) else F.lit(1.0)
    of_text = loss if callable(loss) and not isinstance(loss, Column) else None
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * _SEQUENCES_PER_TASK
        for batch in slices(batches, WINDOW_DOCS):
            ids, texts, shares = (batch.column(k).to_pylist() for k in range(3))
            if of_text:
                shares = [of_text(t or "") for t in texts]
            sums = np.cumsum([len(t or "") + 1 for t in texts])
            a = 0
            while a < len(ids):
                b = max(a + 1, min(len(ids), int(np.searchsorted(sums, (sums[a - 1] if a else 0) + WINDOW_CHARS))))
                tokens = token_arrays(texts[a:b], tokenizer, keeps_spaces, end_id, remembered)
                pieces = pack_window(np.array([len(x) for x in tokens]), np.array(shares[a:b]), limits)
                cols: list[list] = [[] for _ in range(9)]
                for k, at, n, sequence, offset in pieces:
                    own = tokens[k][at : at + n]
                    row = (ids[a + k], at, n, zlib.crc32(own.astype("<u4").tobytes()), len(tokens[k]), first + sequence, offset, int(np.ceil((n - 1) * shares[a + k] - 1e-9)), own.astype(np.int32) if with_ids else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                first += 1 + max((p[3] for p in pieces), default=-1)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.list_(pa.int32()))], _NAMES)
                a = b

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids array<int>").drop(*[] if with_ids else ["ids"])


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
