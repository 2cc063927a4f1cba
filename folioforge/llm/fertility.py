"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: one with byte fallback gives characters per token, the share of tokens that are fallback bytes and
the entropy of its token distribution, a byte-level one characters per token once more. Texts of one language (or script, where no
language is given) and like length should measure alike; each group's quartiles over all documents, each distinct measure once, give
bands. A text is rejected if one measure is far out of its band, or two are out of it by less. Groups of few rows and short texts take a
wider band of the whole language or script, and fixed limits hold for every text, whatever the bands are. Plain rules on words,
symbols and repeats come first.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored, window_hashes

WINDOW = 8
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: A text is rejected if one measure is FAR interquartile ranges beyond the quartiles of its group, or two are NEAR. Ranges count as so wide at
#: least (LEAST_RANGE). Groups of fewer distinct measures than LEAST_ROWS, and texts of fewer than LEAST_TOKENS tokens, take the band of their
#: language or script, WIDER times as wide; a language or script of fewer has none.
FAR, NEAR = 5.0, 2.5
WIDER = 4.0
LEAST_ROWS = 30
LEAST_RANGE = {"chars_per_token": 0.03, "bytes_chars_per_token": 0.03, "byte_share": 0.01, "entropy": 0.2}
LEAST_TOKENS = 50
#: Fixed limits. Characters per token and bytes have a lower and an upper one in Latin script only: the vocabulary may lack other scripts.
#: Entropy grows with the number of tokens, so texts under LEAST_TOKENS are not judged by it.
LATIN_LEAST_CHARS, MOST_CHARS, LATIN_MOST_BYTES, LEAST_ENTROPY = 1.2, 10.0, 0.3, 2.0
#: Words remembered by a worker.
REMEMBERED = 400_000

# Lead bytes of the UTF-8 forms of scripts, as ranges; letters of ASCII and other lead bytes below are Latin.
SCRIPTS = (("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4), ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0), ("cjk", 0xE3, 0xE9), ("hangul", 0xEA, 0xED))


def script(raw: bytes) -> str:
    """The script with the most characters, judged by lead bytes; Latin if there are none."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    best = {"latin": int(n[65:91].sum() + n[97:123].sum() + n[0xC3:0xCA].sum())} | {name: int(n[a : b + 1].sum()) for name, a, b in SCRIPTS}
    return max(best, key=best.get)


class Pieces:
    """Piece ids of words by a SentencePiece model, and their numbers of byte-level tokens, each distinct word encoded once for a while."""

    def __init__(self, path: str, bytes_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.bytes = Tokenizer.from_file(bytes_path)
        self.bytes.encode_special_tokens = True  # words are only measured here
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        # Ids of all known words in a row, where each begins, how many it has, and its number of byte-level tokens.
        self.ids, (self.starts, self.lengths, self.sizes) = np.zeros(0, np.int32), (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, fresh: list[str]) -> None:
        own = self.model.encode(fresh, num_threads=1)
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        sizes = [len(e.ids) for k in range(0, len(fresh), 2000) for e in self.bytes.encode_batch_fast([" " + w for w in fresh[k : k + 2000]], add_special_tokens=False)]
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(own), np.int32, int(lengths.sum()))])
        self.lengths, self.sizes = np.concatenate([self.lengths, lengths]), np.concatenate([self.sizes, np.array(sizes, np.int64)])

    def of(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[int]]:
        """Each text's piece ids, and its number of byte-level tokens."""
        if len(self.known) > REMEMBERED:
            self._forget()
        numbers = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in texts]
        if len(self.known) > len(self.sizes):
            self._learn(list(islice(self.known, len(self.sizes), None)))
        every = np.concatenate([*numbers, np.zeros(0, np.int64)])
        owner, lengths = np.repeat(np.arange(len(texts)), [len(n) for n in numbers]), self.lengths[every]
        before = np.cumsum(lengths) - lengths
        ids = self.ids[np.repeat(self.starts[every] - before, lengths) + np.arange(lengths.sum())]
        ends = np.cumsum(np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], np.bincount(owner, weights=self.sizes[every], minlength=len(texts)).astype(np.int64).tolist()


_pieces: dict[tuple[str, str], Pieces] = {}


def base_counts(text: str | None) -> tuple[list[bytes], list[int]]:
    """The words of a text, and word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    covered = 0
    if len(words) >= WINDOW:
        _, own, n = np.unique(window_hashes(words, WINDOW), return_inverse=True, return_counts=True)
        edge = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(n[own] > 1)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        covered = int((np.cumsum(edge[:-1]) > 0).sum())
    return words, [chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), covered]


def measures(docs: DataFrame, vocabulary: str, bytes_vocabulary: str, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """doc_id, n_words, the base counts, script, band (the value of ``group_col``, else the script), n_tokens, chars_per_token, byte_share and entropy
    (bits) by the first vocabulary, bytes_chars_per_token by the second, of every whole text.

    Null, empty and blank texts have no words and measure 0; rows that repeat give equal rows; an empty table gives an empty one. Other
    columns are not read. Ids are cast to long: one that is no number stops the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, bytes_vocabulary)
        if key not in _pieces:
            _pieces[key] = Pieces(*key)
        pieces = _pieces[key]
        for batch in batches:
            ids, texts, groups = (batch.column(k).to_pylist() for k in range(3))
            for k in range(0, len(texts), 500):
                rows, words = [], []
                for i, t, g in zip(ids[k : k + 500], texts[k : k + 500], groups[k : k + 500], strict=True):
                    own, base = base_counts(t)
                    words.append(b"\n".join(own).decode("utf-8", "replace").split("\n") if own else [])
                    of = script((t or "").encode("utf-8", "replace"))
                    rows.append([i, len(own), *base, of, of if g is None else g])
                for row, p, n_bytes in zip(rows, *pieces.of(words), strict=True):
                    n = np.unique(p, return_counts=True)[1] / max(len(p), 1)
                    row += [len(p), row[2] / max(len(p), 1), row[2] / max(n_bytes, 1), float(pieces.is_byte[p].mean()) if len(p) else 0.0, float(-(n * np.log2(n)).sum()) + 0.0]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), group.alias("band"))
    return own.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, band string, n_tokens long, chars_per_token double, bytes_chars_per_token double, byte_share double, entropy double")


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "band", "n_tokens", "chars_per_token", "bytes_chars_per_token", "byte_share", "entropy"]
_TYPES = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4]


def judged(docs: DataFrame, vocabulary: str, bytes_vocabulary: str, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """``measures`` with base_failed (fewer than 20 words, or over 30 % of them in repeated windows), outside (measures are out of their
    bands) and kept.

    Bands come from all rows of the same language or script and like number of tokens (a power of four), those of small groups and short
    texts from all rows of the language or script; fixed limits hold besides. Null and empty texts have no words and fail. Rows that
    repeat give equal rows; other columns are not read; an empty table gives an empty one.
    """
    found = stored(measures(docs, vocabulary, bytes_vocabulary, id_col, text_col, group_col), "fertility")
    found = found.withColumn("scale", F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 2).cast("int"))
    names = list(LEAST_RANGE)
    # Copies count once; texts that fail the base rules set no bands.
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    distinct = found.filter((F.col("n_tokens") >= LEAST_TOKENS) & ~failed).select("band", "scale", "n_tokens", *names).distinct()

    def quartiles(prefix: str, *keys: str) -> DataFrame:
        of = [F.percentile_approx(c, [0.25, 0.75], 2000).alias(f"{prefix}_{c}") for c in names]
        own = stored(distinct.groupBy(*keys).agg(F.count("*").alias("n"), *of).filter(F.col("n") >= LEAST_ROWS).drop("n"), f"quartiles-{prefix}")
        return small_or_shuffled(own, own.count())

    def beyond(prefix: str, c: str, wider: float) -> Column:
        """How many ranges a measure is beyond the quartiles; null without a band."""
        low, high = F.get(f"{prefix}_{c}", F.lit(0)), F.get(f"{prefix}_{c}", F.lit(1))
        return F.greatest(low - F.col(c), F.col(c) - high) / (F.greatest(high - low, F.lit(LEAST_RANGE[c])) * wider)

    long = F.col("n_tokens") >= LEAST_TOKENS
    out = (F.col("script") == "latin") & ((F.col("chars_per_token") < LATIN_LEAST_CHARS) | (F.col("byte_share") > LATIN_MOST_BYTES))
    out = (F.col("n_tokens") > 0) & (out | (F.col("chars_per_token") > MOST_CHARS) | (long & (F.col("entropy") < LEAST_ENTROPY)))
    off = {}
    for c in names:
        band_wide = F.when((F.col("n_tokens") > 0) & (long if c == "entropy" else F.lit(True)), beyond("s", c, WIDER))
        off[c] = F.coalesce(F.when(long, beyond("q", c, 1.0)), band_wide, F.lit(0.0))
    far = F.greatest(*off.values()) > FAR
    near = sum(((x > NEAR).cast("int") for x in off.values()), F.lit(0)) >= 2
    both = found.join(quartiles("q", "band", "scale"), ["band", "scale"], "left").join(quartiles("s", "band"), "band", "left")
    return both.withColumn("base_failed", failed).withColumn("outside", out | far | near).withColumn("kept", ~F.col("base_failed") & ~F.col("outside")).select(*_NAMES, "base_failed", "outside", "kept")
