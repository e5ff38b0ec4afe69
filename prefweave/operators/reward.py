"""Linear Bradley-Terry reward model: the chance that a story is preferred is sigma(score - other score).

For a linear score this is logistic regression, without intercept, on the difference of the two stories' features. The
solvers at hand scale every feature by its spread, which a penalty on plain coefficients turns into thousands of steps for
rare words, so the few lines of a solver are here.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.durable import durable
from prefweave.functions.text import tokens
from prefweave.operators.dictionary import bound_batches

# Functions of this module travel to the executors by value, which need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 1 << 14


@dataclass(frozen=True)
class LinearScorer:
    """Coefficients by feature. There is no intercept, as it would cancel out of every pair."""

    coefficients: np.ndarray
    intercept: float = 0.0


def bucket(token: Column, size: int) -> Column:
    """The feature of a token: the first 32 bits of its MD5, which other engines have too, as a number below `size`."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % size


def _terms(text: Column, size: int) -> Column:
    """The `bucket` of every token, as text. A batch hashes each of its words once, however often it stands there."""

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            coded = batch.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            terms = pa.array([str(int.from_bytes(md5(w).digest()[:4]) % size) for w in words], pa.string())
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(ends, terms.take(coded.indices), mask=pc.is_null(batch))

    return F.arrow_udf(hashed, "array<string>")(tokens(text))


def fit_features(df: DataFrame, text_column: str, size: int = FEATURES) -> PipelineModel:
    """R1, fit: hashed token counts weighted by how rare a token is, ln((stories + 1) / (stories that hold it + 1)), and scaled
    to length 1, so that a long story weighs as much as a short one and the solver converges soon."""
    bound_batches(df.sparkSession)
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="_terms", outputCol="_counts")
    weighted = IDF(inputCol="_counts", outputCol="_weighted")
    scaled = Normalizer(inputCol="_weighted", outputCol="features")
    prepared = df.filter(F.col(text_column).isNotNull()).select(_terms(F.col(text_column), size).alias("_terms"))
    return PipelineModel([counted, weighted.fit(counted.transform(prepared)), scaled])


def _size(model: PipelineModel) -> int:
    return len(model.stages[1].idf)


def features(df: DataFrame, text_column: str, model: PipelineModel, name: str = "features") -> DataFrame:
    """R1. Add the sparse feature vector of a story; a row without a story stays, with the vector of no words."""
    bound_batches(df.sparkSession)
    size = _size(model)
    prepared = df.withColumn("_terms", F.coalesce(_terms(F.col(text_column), size), F.array().cast("array<string>")))
    return model.transform(prepared).drop("_terms", "_counts", "_weighted").withColumnRenamed("features", name)


def _by_feature(vector: str) -> Column:
    """A sparse vector as a map from feature to value."""
    told = F.unwrap_udt(F.col(vector))
    return F.map_from_arrays(told["indices"], told["values"])


def _vectors(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """Complete pairs with the features of their stories as `_chosen` and `_rejected`."""
    complete = pairs.filter(F.col("chosen_story").isNotNull() & F.col("rejected_story").isNotNull())
    return features(features(complete, "chosen_story", model, "_chosen"), "rejected_story", model, "_rejected")


def _difference() -> Column:
    """`_chosen` - `_rejected` as entries, without those that are 0."""
    zero = F.lit(0.0)
    minus = F.map_zip_with(_by_feature("_chosen"), _by_feature("_rejected"), lambda _, c, r: F.coalesce(c, zero) - F.coalesce(r, zero))
    return F.array_sort(F.map_entries(F.map_filter(minus, lambda _, x: x != 0)))


def pair_differences(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """Complete pairs with the `difference` of their features, chosen - rejected: an array of (key, value) by key.

    Only features that differ are in it: it is as long as the two stories have different words, whatever the number of features.
    """
    return _vectors(pairs, model).withColumn("difference", _difference()).drop("_chosen", "_rejected")


def _sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(feature, value) of the rows of one task: the gradient of their losses, and the losses themselves as feature -1."""
    gradient, total = np.zeros(len(weights)), 0.0
    for batch in batches:
        entries = batch.column(0)
        flat = entries.flatten()
        keys, values = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row = np.repeat(np.arange(len(entries)), pc.list_value_length(entries).to_numpy())
        margins = np.bincount(row, values * weights[keys], len(entries))
        total += float(np.logaddexp(0, -margins).sum())
        share = np.exp(-np.logaddexp(0, margins))  # 1 / (1 + e^margin), whatever its size
        gradient -= np.bincount(keys, share[row] * values, len(weights))
    used = np.flatnonzero(gradient)
    features = np.concatenate([[-1], used]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(np.concatenate([[total], gradient[used]]))], ["feature", "value"])


def _evaluated(differences: DataFrame, weights: np.ndarray, rows: int, regularization: float) -> tuple[float, np.ndarray]:
    """Mean loss and penalty at the weights, and their gradient: each task sums its rows, and one row per feature comes back."""
    shipped = differences.sparkSession.sparkContext.broadcast(weights)
    sums = differences.select("difference").mapInArrow(lambda batches: _sums(batches, shipped.value), "feature int, value double")
    told = sums.groupBy("feature").agg(F.sum("value").alias("value")).toPandas()
    shipped.destroy()
    by_feature = told.set_index("feature")["value"]
    gradient = regularization * weights
    used = by_feature.index[by_feature.index >= 0].to_numpy()
    gradient[used] += by_feature[used].to_numpy() / rows
    return float(by_feature[-1]) / rows + regularization / 2 * float(weights @ weights), gradient


def fit_bt(
    pairs: DataFrame, model: PipelineModel, regularization: float = 0.01, iterations: int = 200, tolerance: float = 1e-4
) -> LinearScorer:
    """R2. Fit the scorer: the least mean loss plus regularization / 2 * |coefficients|^2, up to a gradient of length `tolerance`.

    The differences are written once, sparse; each step is one pass over them. Steps are those of L-BFGS with a
    line search, on the driver, which holds a few vectors of one number per feature. Which way round a pair is given does
    not matter: its loss is that of the difference.
    """
    differences = durable(pair_differences(pairs, model).select("difference"))
    rows, size = differences.count(), _size(model)
    at = np.zeros(size)
    if not rows:
        return LinearScorer(at)
    value, gradient = _evaluated(differences, at, rows, regularization)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if np.linalg.norm(gradient) <= tolerance:
            break
        direction = -_preconditioned(gradient, memory)
        slope, step = float(direction @ gradient), 1.0
        while True:
            there = at + step * direction
            new_value, new_gradient = _evaluated(differences, there, rows, regularization)
            # The loss is convex, so a short enough step lowers it; below rounding there is nothing left to gain.
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        moved, turned = there - at, new_gradient - gradient
        if moved @ turned > 0:
            memory = [*memory[-9:], (moved, turned)]
        at, value, gradient = there, new_value, new_gradient
    return LinearScorer(at)


def _preconditioned(gradient: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse of the curvature that the remembered steps (moved, turned) have shown."""
    found, shares = gradient.copy(), []
    for moved, turned in reversed(memory):
        share = (moved @ found) / (moved @ turned)
        shares.append(share)
        found -= share * turned
    if memory:
        moved, turned = memory[-1]
        found *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(memory, reversed(shares)):
        found += moved * (share - (turned @ found) / (moved @ turned))
    return found


def penalised_gradient(
    pairs: DataFrame, model: PipelineModel, scorer: LinearScorer, regularization: float = 0.01
) -> DataFrame:
    """(feature, gradient) of the mean loss plus regularization / 2 * |coefficients|^2, at the scorer's coefficients.

    It is worked out from the pairs, not taken from a solver: where all of it is near 0, no other coefficients do better, as
    the loss is convex. A norm g bounds the distance to the best coefficients by g / regularization. Features that no
    pair differs in and that have no coefficient are left out.
    """
    # One row per coefficient that is not 0, at most as many as there are features.
    weights = [(i, float(w)) for i, w in enumerate(np.asarray(scorer.coefficients)) if w]
    known = pairs.sparkSession.createDataFrame(weights, "feature int, weight double")
    # Each story's features are worked out once, for its score and for the difference.
    both = _vectors(pairs, model)
    for side in ("chosen", "rejected"):
        both = _with_total(both, f"_{side}", scorer, f"{side}_score")
    share = 1 / (1 + F.exp(F.col("chosen_score") - F.col("rejected_score")))
    summed = (
        both.select(share.alias("_share"), F.explode(_difference()).alias("_e"))
        .groupBy(F.col("_e.key").alias("_feature"))
        .agg(F.sum(-F.col("_share") * F.col("_e.value")).alias("_sum"))
    )
    complete = pairs.filter(F.col("chosen_story").isNotNull() & F.col("rejected_story").isNotNull()).count()
    both = summed.join(known, F.col("_feature") == F.col("feature"), "full")
    value = F.coalesce("_sum", F.lit(0.0)) / max(1, complete) + regularization * F.coalesce("weight", F.lit(0.0))
    return both.select(F.coalesce("feature", "_feature").alias("feature"), value.alias("gradient"))


def gradient_norm(gradient: DataFrame) -> float:
    """The length of the gradient; 0 only at the best coefficients."""
    return gradient.agg(F.sqrt(F.coalesce(F.sum(F.col("gradient") ** 2), F.lit(0.0)))).first()[0]


def steepest_scorer(pairs: DataFrame, model: PipelineModel) -> LinearScorer:
    """The scorer after one step of length 1 against the gradient, from coefficients of 0: a baseline without a solver."""
    size = _size(model)
    coefficients = np.zeros(size)
    # At most one row per feature.
    for row in penalised_gradient(pairs, model, LinearScorer(np.zeros(size))).collect():
        coefficients[row["feature"]] = -row["gradient"]
    return LinearScorer(coefficients)


def score(
    df: DataFrame, text_column: str, model: PipelineModel, scorer: LinearScorer, name: str = "score"
) -> DataFrame:
    """R3. One score per story; higher is better. A row without a story has a null score."""
    scored = _with_total(features(df, text_column, model, "_features"), "_features", scorer, name)
    return scored.withColumn(name, F.when(F.col(text_column).isNotNull(), F.col(name))).drop("_features")


def _with_total(df: DataFrame, vector: str, scorer: LinearScorer, name: str) -> DataFrame:
    """Add the sum of a vector's features, each times its coefficient."""
    product = ElementwiseProduct(scalingVec=Vectors.dense(scorer.coefficients), inputCol=vector, outputCol="_product")
    total = F.aggregate(F.unwrap_udt(F.col("_product"))["values"], F.lit(0.0), lambda a, x: a + x)
    return product.transform(df).withColumn(name, total).drop("_product")


def score_pairs(pairs: DataFrame, model: PipelineModel, scorer: LinearScorer) -> DataFrame:
    """R3 on both stories of every pair; a missing story has a null score."""
    chosen = score(pairs, "chosen_story", model, scorer, "chosen_score")
    return score(chosen, "rejected_story", model, scorer, "rejected_score")


def pair_metrics(scored: DataFrame) -> DataFrame:
    """R4. Pairs, share of pairs that put the chosen story first, and mean loss -log sigma(chosen - rejected).

    The loss is taken as max(-m, 0) + log(1 + exp(-|m|)), which does not overflow for a margin m of any size.
    """
    margin = F.col("chosen_score") - F.col("rejected_score")
    loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return scored.filter(margin.isNotNull()).agg(
        F.count("*").alias("pairs"),
        F.avg((margin > 0).cast("double")).alias("accuracy"),
        F.avg(loss).alias("mean_loss"),
    )
