"""Toxicity by subword bags: character n-gram vectors, averaged, into a linear softmax, trained jointly.

A word's vector is the mean of its n-gram vectors, so a misspelling that was never seen shares most of what its word has
learned. A passage's vector is the mean over PASSAGE places, in which each distinct word counts once and repeats count as
nothing. One toxic remark in a long document would vanish in a mean over
all of it, so a document is scored by passages: training weighs them by how toxic they look so far (all alike at first), and the
score is that of the most toxic one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, mix, sigmoid

WORDS = re.compile(r"\w+")
SIZES = (3, 4, 5)
BUCKETS, DIMENSIONS = 1 << 16, 8
#: Words of a passage; each starts half a passage after the one before.
PASSAGE = 16
#: The training sample: rows of each label at most, and characters of a text.
PER_CLASS, MAX_CHARS = 1500, 6000
#: Documents of the sample that a word must occur in to be learned from.
LEAST_DOCS = 3
#: What the mean is multiplied by before the softmax.
TEMPERATURE = 16.0
STEPS, RATE, RIDGE = 60, 0.03, 1e-4
#: Words remembered by a worker.
REMEMBERED = 400_000


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words (as <word>, bytes) and of the words themselves, and the word that each belongs to."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), lengths)
    ends = np.cumsum(lengths)
    out, of = [], []
    for n in SIZES:
        h = np.full(max(len(data) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + data[k : len(data) - n + 1 + k]
        inside = np.arange(len(h)) + n <= ends[owner[: len(h)]]
        out.append(mix(h[inside]))
        of.append(owner[: len(h)][inside])
    whole = np.zeros(len(raw), np.uint64)
    np.add.at(whole, owner, mix(data + np.uint64(1000) * (np.arange(len(data)) - (ends - lengths)[owner]).astype(np.uint64)))
    out.append(mix(whole))
    of.append(np.arange(len(raw)))
    buckets = (np.concatenate(out) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    return buckets, np.concatenate(of).astype(np.int32)


def fresh_words(words: np.ndarray) -> np.ndarray:
    """Whether each word (as a number) did not occur among the PASSAGE - 1 words before it."""
    order = np.argsort(words, kind="stable")
    again = np.zeros(len(words), bool)
    again[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (order[1:] - order[:-1] < PASSAGE)
    return ~again


def passages(n: int) -> list[tuple[int, int]]:
    """Word ranges of the passages of n words: all words are covered."""
    if n <= PASSAGE:
        return [(0, n)]
    starts = list(range(0, n - PASSAGE, PASSAGE // 2))
    return [(s, s + PASSAGE) for s in starts] + [(n - PASSAGE, n)]


@dataclass
class Model:
    """The log-odds that each n-gram bucket adds to the mean, the bias, and the scale and shift that make a document's largest log-odds a probability."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.values = np.zeros(0)

    def words(self, texts: list[str | None]) -> list[np.ndarray]:
        """The log-odds of each word of each text, 0 for a word that the passage has already."""
        if len(self.known) > REMEMBERED:
            self._forget()
        found = [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in (WORDS.findall((t or "").lower()) for t in texts)]
        fresh = list(islice(self.known, len(self.values), None))
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            buckets, owner = ngrams(part)
            sums = np.bincount(owner, weights=self.model.weights[buckets], minlength=len(part)) / np.bincount(owner, minlength=len(part))
            self.values = np.concatenate([self.values, sums])
        return [self.values[n] * fresh_words(n) for n in found]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for v in self.words(texts):
            total = np.concatenate([[0.0], np.cumsum(v)])
            spans = np.array(passages(len(v)))
            out.append(((total[spans[:, 1]] - total[spans[:, 0]]) * (TEMPERATURE / PASSAGE)).max() + self.model.bias)
        return sigmoid(np.array(out) * self.model.scale + self.model.shift)


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Row sums by owner."""
    return np.column_stack([np.bincount(owner, weights=values[:, d], minlength=n) for d in range(values.shape[1])])


def fit(texts: list[str], labels: np.ndarray, prior: float) -> Model:
    """Train on texts with 0/1 labels, four fifths of them for the vectors and the rest to turn log-odds into probabilities at the given
    share of label 1; with fewer than two classes every text gets the share of label 1."""
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(texts)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    learned = [t for t, h in zip(texts, held, strict=True) if not h]
    known_texts, known = ([t for t, h in zip(texts, held, strict=True) if h], labels[held]) if held.any() else (learned, labels[~held])
    weights, bias = _fit_vectors(learned, labels[~held])
    plain = Scorer(Model(weights, bias, 1.0, 0.0)).scores(known_texts)
    best = np.log(plain) - np.log1p(-plain)
    c = {"scale": np.ones(1), "shift": np.zeros(1)}
    spread, middle = float(best.std()) or 1.0, float(best.mean())
    balance = np.where(known == 1, prior / (known == 1).sum(), (1 - prior) / (known == 0).sum())

    def calibration(step: int) -> dict[str, np.ndarray]:
        error = (sigmoid((best - middle) / spread * c["scale"][0] + c["shift"][0]) - known) * balance
        return {"scale": np.array([(error * (best - middle) / spread).sum() + 1e-4 * c["scale"][0]]), "shift": np.array([error.sum()])}

    adam(c, calibration, 400, 0.05)
    scale = max(float(c["scale"][0]), 0.0) / spread
    return Model(weights, bias, scale, float(c["shift"][0]) - middle * scale)


def _fit_vectors(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The log-odds that each n-gram bucket adds (its vector times the difference of the softmax's two columns), and the bias."""
    found = [WORDS.findall(t.lower()) for t in texts]
    seen = Counter(w for ws in found for w in set(ws))
    vocabulary: dict[str, int] = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCS))} or {"": 0}
    buckets, owner = ngrams(list(vocabulary))
    per_word = np.bincount(owner, minlength=len(vocabulary))
    word_of, passage_of, doc_of, n_passages = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for d, ws in enumerate(found):
        numbers: dict[str, int] = {}
        own = fresh_words(np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.int64))
        words = np.array([vocabulary.get(w, -1) for w in ws], np.int64)
        for a, b in passages(len(ws)):
            kept = words[a:b][own[a:b] & (words[a:b] >= 0)]
            word_of.append(kept)
            passage_of.append(np.full(len(kept), n_passages))
            doc_of.append(d)
            n_passages += 1
    word_of, passage_of, doc_of = np.concatenate(word_of), np.concatenate(passage_of), np.array(doc_of)
    first = np.concatenate([[0], np.flatnonzero(np.diff(doc_of)) + 1])
    rng = np.random.default_rng(8)
    p = {"vectors": rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), "out": rng.normal(0, 0.5, (DIMENSIONS, 2)), "bias": np.zeros(2)}
    wanted = np.eye(2)[labels]
    balance = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())[:, None]

    def gradients(step: int) -> dict[str, np.ndarray]:
        words = _sums(p["vectors"][buckets], owner, len(vocabulary)) / per_word[:, None]
        bags = _sums(words[word_of], passage_of, n_passages) / PASSAGE
        logits = bags @ p["out"] * TEMPERATURE + p["bias"]
        # Passages count by how toxic they look, from all alike at first to the most toxic one alone.
        odds = logits[:, 1] - logits[:, 0]
        e = np.exp(np.minimum(odds - np.maximum.reduceat(odds, first)[doc_of], 0))
        share = (e / np.add.reduceat(e, first)[doc_of])[:, None]
        document = np.add.reduceat(share * logits, first)
        softmax = np.exp(document - document.max(axis=1, keepdims=True))
        error = share * (((softmax / softmax.sum(axis=1, keepdims=True)) - wanted) * balance)[doc_of]
        bag_grad = error @ p["out"].T * (TEMPERATURE / PASSAGE)
        per_word_grad = _sums(bag_grad[passage_of], word_of, len(vocabulary)) / per_word[:, None]
        vectors = _sums(per_word_grad[owner], buckets, BUCKETS) + RIDGE * p["vectors"]
        return {"vectors": vectors, "out": bags.T @ error * TEMPERATURE + 1e-4 * p["out"], "bias": error.sum(axis=0)}

    adam(p, gradients, STEPS, RATE)
    return (p["vectors"] @ (p["out"][:, 1] - p["out"][:, 0])).astype(np.float32), float(p["bias"][1] - p["bias"][0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts, which have no words, get the score of no evidence.

    Rows that repeat give equal rows; other columns are not read; an empty table gives an empty one. Ids are cast to long: one that is
    no number stops the run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [scorer.scores(texts[k : k + 500]) for k in range(0, len(texts), 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0)]))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
