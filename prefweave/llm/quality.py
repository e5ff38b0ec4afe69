"""Quality by positive-unlabelled learning: non-negative unbiased risk with an estimated class prior."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.columns import text_function
from prefweave.llm.sample import draw_order, first_by_order
from prefweave.llm.words import NOT_BLANK, joined, word_hashes, word_places

# Rows that are drawn to fit, at most: trusted positives, and unlabelled rows.
POSITIVES, UNLABELLED = 8_000, 16_000
BINS, STEPS, RATE, DECAY, SEED = 12, 400, 0.05, 1e-4, 11

_ALL = np.arange(256)
_LOWER = (_ALL >= 0x61) & (_ALL <= 0x7A)
_UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
_DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
_HIGH = _ALL >= 0x80
_STOP = np.isin(_ALL, [ord(c) for c in ".!?"])
_COMMA = np.isin(_ALL, [ord(c) for c in ",;:"])
_QUOTE = np.isin(_ALL, [ord(c) for c in "\"'()-"])
_SYMBOL = (_ALL > 0x20) & (_ALL < 0x7F) & ~(_LOWER | _UPPER | _DIGIT | _STOP | _COMMA | _QUOTE)
CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _HIGH, _STOP, _COMMA, _QUOTE, _SYMBOL, _ALL == 0x0A]).astype(np.float32)
FEATURES = len(CLASSES) + 12


def features(texts: list[str]) -> np.ndarray:
    """FEATURES numbers per text about its form: kinds of characters, lengths, repetition. All zero for no words."""
    data, offsets = joined(texts)
    starts, ends = word_places(data, NOT_BLANK)
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    sizes = np.diff(offsets) - 1
    sums = np.zeros(len(data) + 1)
    table = np.zeros((len(texts), FEATURES))
    for i, members in enumerate(CLASSES):
        np.cumsum(members[data], out=sums[1:])
        table[:, i] = sums[offsets[1:] - 1] - sums[offsets[:-1]]
    table[:, : len(CLASSES)] /= np.maximum(1, sizes)[:, None]
    symbol = _SYMBOL[data]
    np.cumsum(symbol, out=sums[1:])
    marked = (sums[ends] - sums[starts]) > 0
    np.cumsum((_LOWER | _UPPER | _HIGH)[data], out=sums[1:])
    wordless = (sums[ends] - sums[starts]) == 0
    lengths = ends - starts
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        n = b - a
        if not n:
            continue
        own, long = hashes[a:b], lengths[a:b]
        _, counts = np.unique(own, return_counts=True)
        pairs = own[1:] * np.uint64(3) + own[:-1]
        table[row, len(CLASSES) :] = (
            np.log1p(n),
            long.mean(),
            long.std(),
            (long > 20).mean(),
            marked[a:b].mean(),
            wordless[a:b].mean(),
            (own[1:] == own[:-1]).mean() if n > 1 else 0,
            len(counts) / n,
            len(counts) / np.sqrt(n),
            counts.max() / n,
            len(np.unique(pairs)) / len(pairs) if n > 1 else 1,
            np.log1p(n / (1 + table[row, 8] * sizes[row])),
        )
    return table


def _describer():
    def describe(texts: list[str]) -> list:
        return [list(features(texts))]

    return describe


def described(text: Column) -> Column:
    """The features of whole texts as an array; null reads as empty."""
    return text_function("x array<double>", {"x": pa.list_(pa.float64())}, _describer)(text)["x"]


@dataclass
class QualityModel:
    """An additive model: each feature adds the weight of the bin that its value falls in."""

    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features, BINS)
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, edges in enumerate(self.edges):
            total += self.weights[j][np.searchsorted(edges, x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _one_hot(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    places = np.stack([np.searchsorted(e, x[:, j], side="right") + j * BINS for j, e in enumerate(edges)], 1)
    hot = np.zeros((len(x), len(edges) * BINS), np.float32)
    hot[np.arange(len(x))[:, None], places] = 1
    return hot


def _descend(gradient, width: int) -> tuple[np.ndarray, float]:
    """Adam over all rows at once; `gradient` gives the direction for (weights, bias)."""
    w = np.zeros(width + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = gradient(w[:-1], w[-1]) + np.append(DECAY * w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Upper bound of the share of positives: no region can hold a smaller part of the unlabelled than this share of the part
    of the positives that it holds. Regions are the tops of a ranking that tells positives from unlabelled rows; one
    standard error is allowed for."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(u * (1 - u) / len(unlabelled)) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(((u + slack) / p).min(), 0.05, 0.99))


def fit_non_negative(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under logistic loss.

    Where the second part falls below zero the rows of it are unlearned instead, as negative risk is overfitting.
    """

    def gradient(w: np.ndarray, b: float) -> np.ndarray:
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        plus = -prior * (1 - _sigmoid(zp)) / len(p)
        of_p, of_u = -prior * _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
        if negative < 0:
            gp, gu = -of_p, -of_u
        else:
            gp, gu = plus + of_p, of_u
        return np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum())

    return _descend(gradient, p.shape[1])


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """Bins from the unlabelled rows, the prior from a ranking of positives against unlabelled, then the risk above."""
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(unlabelled, steps, axis=0).T
    edges = np.maximum.accumulate(edges + np.arange(BINS - 1) * 1e-12, axis=1)
    p, u = _one_hot(positive, edges), _one_hot(unlabelled, edges)

    def ranking(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, float]:
        """What tells positives from unlabelled rows."""

        def apart(w: np.ndarray, b: float) -> np.ndarray:
            gp, gu = -(1 - _sigmoid(p @ w + b)) / len(p), _sigmoid(u @ w + b) / len(u)
            return np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum())

        return _descend(apart, p.shape[1])

    # Each half is ranked by what the other half taught: a ranking sets the rows that it was fitted on too far apart.
    priors = []
    for fold in (0, 1):
        w, b = ranking(p[fold::2], u[fold::2])
        other_p, other_u = p[1 - fold :: 2], u[1 - fold :: 2]
        if len(other_p) and len(other_u):
            priors.append(estimated_prior(other_p @ w + b, other_u @ w + b))
    prior = float(np.mean(priors)) if priors else 0.5
    w, b = fit_non_negative(p, u, prior)
    return QualityModel(edges, w.reshape(len(edges), BINS), float(b), prior)


def _drawn(docs: DataFrame, id_column: str, text_column: str, limit: int, ids: DataFrame | None = None) -> DataFrame:
    """At most `limit` rows (order, text) by a hash of id and text, the same on every run; with `ids`, rows of these ids only.
    Ids and orders alone meet the `ids`: texts stay where they are."""
    rows = docs.select(
        F.col(id_column).alias("_id"), F.lit(0).alias("label"), draw_order(id_column, text_column).alias("order"), F.col(text_column).alias("text")
    )
    among = None
    if ids is not None:
        among = rows.select("_id", "label", "order").join(ids.select(F.col(ids.columns[0]).alias("_id")), "_id", "left_semi")
    return first_by_order(rows.drop("_id"), limit, among).select("order", "text")


def fit_quality(
    docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> QualityModel | None:
    """Fit on at most `positives` rows of the `trusted` ids (one column) and `unlabelled` rows of `docs`.

    Only the features of drawn rows come to the driver. None if either sample is empty.
    """
    def collected(limit: int, ids: DataFrame | None = None) -> np.ndarray:
        found = _drawn(docs, id_column, text_column, limit, ids).select("order", described(F.col("text")).alias("x")).toPandas()
        return np.stack(found.sort_values("order", kind="stable")["x"]) if len(found) else np.zeros((0, FEATURES))

    p, u = collected(positives, trusted), collected(unlabelled)
    return fit_pu(p, u) if len(p) and len(u) else None


def quality_score(text: Column, model) -> Column:
    """Probability of good quality by a broadcast QualityModel; empty texts are scored like others. Without a model 0.5."""

    def make():
        m: QualityModel | None = model.value

        def score(texts: list[str]) -> list:
            return [m.score(features(texts)) if m is not None else np.full(len(texts), 0.5)]

        return score

    return text_function("score double", {"score": pa.float64()}, make)(text)["score"]
