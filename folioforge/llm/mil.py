"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from what its characters and words are like; a gated attention
(tanh times sigmoid) learned from document labels alone says how much each passage counts, and the weighted mean of the
encodings gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import adam, release, sigmoid, small_batches, window_hashes

#: Words of a passage.
PASSAGE = 64
HIDDEN, ATTENTION = 16, 8
#: The training sample: rows of each label at most, and characters of a text.
PER_CLASS, MAX_CHARS = 1500, 20_000
STEPS, RATE = 250, 0.02
_MORE = 6


def features(text: str | None) -> np.ndarray:
    """One row per passage (one of zeros for a text without words): shares of ASCII characters and of others, and how words and lines repeat."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, 129 + _MORE), np.float32)
    hashes = window_hashes(words, 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = -(-len(words) // PASSAGE)
    of_word = np.arange(len(words)) // PASSAGE
    data = np.frombuffer(b"".join(words), np.uint8)
    of_byte = np.repeat(of_word, lengths)
    counts = np.bincount(of_byte * 129 + np.minimum(data, 128), minlength=n * 129).reshape(n, 129).astype(np.float64)
    sizes, in_passage = counts.sum(axis=1), np.bincount(of_word, minlength=n)
    _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
    seen = np.ones(len(words), bool)
    seen[first] = False
    local = np.unique(of_word * len(first) + own)
    pairs = np.bincount(of_word[1:], weights=hashes[1:] == hashes[:-1], minlength=n)
    more = np.column_stack(
        [
            np.bincount(of_word, weights=seen, minlength=n) / in_passage,
            1 - np.bincount(local // len(first), minlength=n) / in_passage,
            pairs / in_passage,
            np.log1p(sizes / in_passage) / 3,
            np.log1p(in_passage) / 4,
            np.full(n, min(np.log1p(len(words)) / 10, 1.5)),
        ]
    )
    return np.column_stack([np.sqrt(counts / sizes[:, None]), more]).astype(np.float32)


def _reduce(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, axis=0)


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    """Encodings, gates, attention and log-odds of bags whose passages stand in a row."""
    z = (x - p["mean"]) / p["spread"]
    h = np.maximum(z @ p["encode"] + p["encode_bias"], 0)
    t, g = np.tanh(h @ p["value"]), sigmoid(h @ p["gate"])
    a = (t * g) @ p["weigh"]
    e = np.exp(a - np.maximum.reduceat(a, first)[owner])
    share = e / _reduce(e, first)[owner]
    bag = _reduce(h * share[:, None], first)
    return {"z": z, "h": h, "t": t, "g": g, "share": share, "bag": bag, "logit": bag @ p["out"] + p["out_bias"][0]}


def fit(texts: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Train on texts with 0/1 labels, both classes weighing the same; with only one class every text gets that one."""
    bags = [features(t) for t in texts] or [features(None)]
    labels = labels if len(texts) else np.array([1])
    x = np.concatenate(bags).astype(np.float64)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    rng = np.random.default_rng(10)
    d = x.shape[1]
    p = {
        "mean": x.mean(axis=0),
        "spread": x.std(axis=0) + 0.02,
        "encode": rng.normal(0, d**-0.5, (d, HIDDEN)),
        "encode_bias": np.zeros(HIDDEN),
        "value": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "weigh": rng.normal(0, ATTENTION**-0.5, ATTENTION),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "out_bias": np.zeros(1),
    }
    if len(set(labels.tolist())) < 2:
        p["out"][:] = 0
        p["out_bias"][:] = 5.0 if labels[0] else -5.0
        return p
    balance = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())

    def gradients(step: int) -> dict[str, np.ndarray]:
        f = forward(p, x, first, owner)
        error = (sigmoid(f["logit"]) - labels) * balance
        bag = np.outer(error, p["out"])
        to_share = (f["h"] * bag[owner]).sum(axis=1)
        to_a = f["share"] * (to_share - _reduce(to_share * f["share"], first)[owner])
        to_t = np.outer(to_a, p["weigh"]) * f["g"] * (1 - f["t"] ** 2)
        to_g = np.outer(to_a, p["weigh"]) * f["t"] * f["g"] * (1 - f["g"])
        to_h = bag[owner] * f["share"][:, None] + to_t @ p["value"].T + to_g @ p["gate"].T
        to_h *= f["h"] > 0
        out = {
            "encode": f["z"].T @ to_h,
            "encode_bias": to_h.sum(axis=0),
            "value": f["h"].T @ to_t,
            "gate": f["h"].T @ to_g,
            "weigh": (f["t"] * f["g"]).T @ to_a,
            "out": f["bag"].T @ error,
            "out_bias": np.array([error.sum()]),
        }
        for k in ("encode", "value", "gate", "weigh", "out"):
            out[k] = out[k] + 1e-3 * p[k]
        return out

    learned = {k: v for k, v in p.items() if k not in ("mean", "spread")}
    adam(learned, gradients, STEPS, RATE)
    return p


def scores(p: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    bags = [features(t) for t in texts]
    if not bags:
        return np.zeros(0)
    sizes = [len(b) for b in bags]
    return sigmoid(forward(p, np.concatenate(bags).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), np.repeat(np.arange(len(bags)), sizes))["logit"])


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text, null and empty ones included.

    Rows that repeat give equal rows; other columns are not read; an empty table gives an empty one.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scored(docs.sparkSession, model, F.col(text_col)).alias("score"))


def scored(spark: SparkSession, model: dict[str, np.ndarray], text: Column) -> Column:
    """The score of a text column, in Arrow batches."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [scores(shared.value, texts.iloc[k : k + 200].to_list()) for k in range(0, len(texts), 200)]
            yield pd.Series(np.concatenate([*out, np.zeros(0)]))
        release()

    return run(text)
