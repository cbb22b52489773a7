"""A quality classifier from positive and unlabelled texts.

Only trusted positives are labelled; web text is unlabelled. The share of good texts in it is estimated first (the smallest ratio, over score thresholds, of the unlabelled to the positive texts
above the threshold), then a small network minimises the non-negative unbiased risk: the loss of positives,
weighted by the prior, and the loss of unlabelled as negatives less the part that positives in it explain, held at zero or more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import in_fold, per_text, sample_ids, table

#: Bounds of the training sample.
POSITIVES, UNLABELLED = 4000, 8000
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 900, 512, 0.01, 7

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".", b",;:", b"\n", b"\"'()[]{}=/\\_~^`@+-")
_URL = re.compile(rb"https?://|www\.")
N_FEATURES = 8 + len(_CLASSES)


def features(text: str | None) -> list[float]:
    """Shares of character classes among the words' bytes, lengths, and how much repeats. An empty text has zeros but for the mark of emptiness."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    n, size = len(words), len(raw)
    distinct = len(set(words))
    lines = raw.split(b"\n")
    return [
        0.0,
        np.log1p(n) / 5,
        size / n / 10,
        np.log(distinct) / np.log(n) if n > 1 else 1.0,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, words))) / 3,
        len(_URL.findall(raw)) / n,
        *(((size - len(raw.translate(None, c))) / n) ** 0.5 for c in _CLASSES),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled from held-out scores: the ratio of the two tails where its upper confidence bound is least."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / len(unlabelled))
    ok = p > 0
    best = np.argmin((u[ok] + slack) / p[ok])
    return float(np.clip(u[ok][best] / p[ok][best], 0.05, 0.95))


def risk(weights: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative unbiased risk under the sigmoid loss, and the step to take for each weight.

    That is its gradient; where the unlabelled part less what positives explain has gone under zero, that part counts as zero and the step goes back along it.
    """
    x, n = np.concatenate([positive, unlabelled]), len(positive)
    h = np.tanh(x @ weights[0] + weights[1])
    s = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30)))
    # the loss of a positive is 1 - s, of a negative s; the slope of s is s(1 - s)
    negative = s[n:].mean() - prior * s[:n].mean()
    value = prior * (1 - s[:n].mean()) + max(negative, 0.0)
    g = np.empty_like(s)
    if negative >= 0:
        g[:n], g[n:] = -2 * prior / n, 1 / len(unlabelled)
    else:
        g[:n], g[n:] = prior / n, -1 / len(unlabelled)
    g *= s * (1 - s)
    back = np.outer(g, weights[2]) * (1 - h * h)
    return value, [x.T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ g + 1e-4 * weights[2], g.sum(keepdims=True)]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = STEPS, seed: int = SEED) -> Model:
    """The network of least non-negative risk; without ``prior``, it is estimated by a first network on half of the rows."""
    rng = np.random.default_rng(seed)
    if prior is None:
        first = train(positive[::2], unlabelled[::2], 0.5, max(steps // 3, 1), seed)
        prior = class_prior(first.score(positive[1::2]), first.score(unlabelled[1::2]))
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    n = max(1, len(u) // BATCH)
    for _ in range(-(-steps // n)):
        orders = rng.permutation(len(p)), rng.permutation(len(u))
        for bp, bu in zip(np.array_split(orders[0], n), np.array_split(orders[1], n)):
            if not len(bp) or not len(bu):
                continue
            _, grads = risk(weights, p[bp], u[bu], prior)
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                weights[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *weights[:3], float(weights[3][0]), prior)


def fit(docs: DataFrame, positives: DataFrame, most_positive: int = POSITIVES, most_unlabelled: int = UNLABELLED) -> Model:
    """A model from ``docs`` (``doc_id, text``, all unlabelled) and ``positives`` (``doc_id``). Both samples are bounded by the parameters, of repeated ids one row counts; only features reach the driver."""

    def sampled(rows: DataFrame, most: int) -> np.ndarray:
        ids = sample_ids(rows, None, most)
        texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
        rows = per_text(texts, lambda: lambda t: [[features(x) for x in t]], "x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
        return np.array([r.x for r in rows]).reshape(-1, N_FEATURES)

    p, u = sampled(positives, most_positive), sampled(docs, most_unlabelled)
    if len(p) < 2 or len(u) < 2:  # nothing to learn from: everything scores 1
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 30.0, 1.0)
    return train(p, u)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``doc_id``, the columns of ``keep`` and ``score``: one for each row of ``docs``.

    Null and empty texts are scored by the model as texts without words, very long ones whole. Null ids stay, repeated rows get the same score, a score of exactly a threshold
    counts as above it; an empty table gives no rows. Other columns are not read."""

    def run(texts: list) -> list:
        return [model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES))]

    return per_text(docs, lambda: run, "score double", id_col, text_col, keep)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the query and of the pipeline: labels of good texts, outside the held-out fold, are the trusted positives."""
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    return fit(docs.where(~in_fold(F.col("doc_id"), 3, 1)), labels.where(~in_fold(F.col("doc_id"), 3, 1)))


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = classify(docs, trained(spark, docs, sf_dir))
    return rows.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
