"""Language identification by nearest centroid.

Texts are normalised TF-IDF vectors of hashed byte n-grams of the lower-cased text, with runs of other ASCII
than letters as one space. Each language has several centroids, by
spherical k-means on its part of a bounded sample; a text gets the language of the centroid of largest cosine, and is
rejected if its distance to that centroid is beyond what the sample of that language shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import class_sample, slices

SIZES = (1, 2, 3)
BUCKETS = 1 << 12
CENTROIDS, ROUNDS = 4, 8
#: The training sample: rows of each language at most, and characters of a text.
PER_LANGUAGE, MAX_CHARS = 600, 10_000
#: A text is rejected if its distance exceeds this quantile of the sample's distances, and this much more.
QUANTILE, MARGIN = 0.999, 0.15
#: All ASCII but letters is a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def counts(texts: list[str | None]) -> np.ndarray:
    """n-gram counts by bucket, one row per text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
        data = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
        for n in SIZES:
            if len(data) >= n:
                h = np.full(len(data) - n + 1, n, np.uint32)
                for k in range(n):
                    h = h * _FACTORS[0] + data[k : len(data) - n + 1 + k] * _FACTORS[1]
                h = ((h ^ (h >> np.uint32(15))) * _FACTORS[2]) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                row += np.bincount(h, minlength=BUCKETS)
    return out


def _normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    reach: dict[str, float]  # the largest distance that is not rejected

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return _normalised(np.log1p(counts(texts)) * self.idf)


def fit(texts: list[str], languages: list[str]) -> Model:
    """Without any text there is no language, and every text is ``und``."""
    if not texts:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], {})
    x = np.log1p(np.concatenate([counts(texts[k : k + 500]) for k in range(0, len(texts), 500)]))
    idf = np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = _normalised(x * idf)
    labels, rng = np.array(languages), np.random.default_rng(5)
    all_, names, reach = [], [], {}
    for name in sorted(set(languages)):
        own = x[labels == name]
        c = own[rng.choice(len(own), min(CENTROIDS, len(own)), replace=False)]
        for _ in range(ROUNDS):
            near = (own @ c.T).argmax(axis=1)
            c = _normalised(np.stack([own[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))]))
        distance = 1 - (own @ c.T).max(axis=1)
        reach[name] = float(np.quantile(distance, QUANTILE)) + MARGIN
        all_.append(c)
        names += [name] * len(c)
    return Model(idf, np.concatenate(all_), names, reach)


def training_sample(docs: DataFrame, training: Column) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of the rows that may be learned from: PER_LANGUAGE of each language at most (see ``class_sample``)."""
    own = docs.filter(training).select("doc_id", F.col("lang").alias("key"), "text")
    found = class_sample(own.select("doc_id", "key", F.length("text").alias("n")), own, PER_LANGUAGE, MAX_CHARS)
    return [r.text for r in found], [r["key"] for r in found]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of the nearest centroid's language in a softmax of cosines), distance, rejected (by
    distance, or without a letter) of every whole text.

    lang_pred is ``und`` for null texts and texts without a letter, with score 0, and else the nearest language, rejected or not. Rows
    that repeat give equal rows; other columns are not read; an empty table gives an empty one. Ids are cast to long: one that is no number
    stops the run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = sorted(set(m.languages))
        owner = np.array([names.index(n) for n in m.languages])
        reach = np.array([m.reach[n] for n in names])
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if not names:
                none = [pa.array([v] * len(texts), t) for v, t in (("und", pa.string()), (0.0, pa.float64()), (1.0, pa.float64()), (True, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *none], ["doc_id", "lang_pred", "score", "distance", "rejected"])
                continue
            cosine = m.vectors(texts) @ m.centroids.T
            best = np.stack([cosine[:, owner == j].max(axis=1) for j in range(len(names))], axis=1)
            top = best.argmax(axis=1)
            share = np.exp(20 * (best - best.max(axis=1, keepdims=True)))
            score = share.max(axis=1) / share.sum(axis=1)
            distance = 1 - best.max(axis=1)
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
            lang = [names[j] if ok else "und" for j, ok in zip(top, letters, strict=True)]
            cols = [batch.column(0), pa.array(lang), pa.array(np.where(letters, score, 0.0).astype(float)), pa.array(distance.astype(float)), pa.array((distance > reach[top]) | ~letters)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "distance", "rejected"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, distance double, rejected boolean")
