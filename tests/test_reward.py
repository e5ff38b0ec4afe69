"""The linear Bradley-Terry model: learns, is antisymmetric, and its metrics are right for any margin."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefweave.operators import reward

GOOD, POOR = ["bright", "vivid", "clever"], ["dull", "flat", "bland"]


@pytest.fixture(scope="module")
def pairs(spark):
    draw = random.Random(2)

    def story(kind):
        return " ".join(draw.choices(kind, k=4) + draw.choices(["the", "and", "of", "it"], k=8))

    rows = [(i, story(GOOD), story(POOR)) for i in range(80)] + [(80, None, "x"), (81, "x", None)]
    return spark.createDataFrame(rows, "pair_id int, chosen_story string, rejected_story string").cache()


@pytest.fixture(scope="module")
def fitted(pairs):
    stories = pairs.selectExpr("explode(array(chosen_story, rejected_story)) AS story")
    model = reward.fit_features(stories, "story", size=256)
    return model, reward.fit_bt(pairs, model)


def test_learns_the_preference(pairs, fitted):
    scored = reward.score_pairs(pairs, *fitted)
    row = reward.pair_metrics(scored).first()
    assert row["pairs"] == 80 and row["accuracy"] > 0.95 and row["mean_loss"] < math.log(2)


def test_swapped_sides_turn_the_weights_round(pairs, fitted):
    model, scorer = fitted
    swapped = pairs.selectExpr("pair_id", "rejected_story AS chosen_story", "chosen_story AS rejected_story")
    other = reward.fit_bt(swapped, model)
    assert max(abs(a + b) for a, b in zip(scorer.coefficients, other.coefficients)) < 1e-3
    assert scorer.intercept == 0.0


def test_score_is_a_dot_product(pairs, fitted):
    model, scorer = fitted
    scored = reward.score(pairs, "chosen_story", model, scorer).select("pair_id", "score").collect()
    vectors = {r["pair_id"]: r["features"] for r in reward.features(pairs, "chosen_story", model).collect()}
    # The row without a story stays, without a score.
    assert [r["pair_id"] for r in scored if r["score"] is None] == [80] and len(scored) == 82
    for r in scored:
        assert r["score"] is None or r["score"] == pytest.approx(vectors[r["pair_id"]].dot(scorer.coefficients))


def test_features_are_sparse_and_differences_are_theirs(pairs, fitted):
    model, _ = fitted
    both = reward.features(reward.features(pairs, "chosen_story", model, "c"), "rejected_story", model, "r").collect()
    wanted = {r["pair_id"]: (r["c"], r["r"]) for r in both}
    got = reward.pair_differences(pairs, model).collect()
    assert len(got) == 80
    for r in got:
        c, o = wanted[r["pair_id"]]
        assert type(c).__name__ == "SparseVector" and len(c.indices) < 13
        dense = c.toArray() - o.toArray()
        assert {e["key"]: pytest.approx(e["value"]) for e in r["difference"]} == {i: dense[i] for i in np.flatnonzero(dense)}
        assert [e["key"] for e in r["difference"]] == sorted(e["key"] for e in r["difference"])


def loss(rows, weights, regularization):
    margins = rows @ weights
    return np.logaddexp(0, -margins).mean() + regularization / 2 * (weights**2).sum()


def test_gradient_is_that_of_the_loss(pairs, fitted):
    """Against differences of the loss in plain numpy, and near 0 at the fitted coefficients."""
    model, scorer = fitted
    rows = np.zeros((80, 256))
    for i, r in enumerate(reward.pair_differences(pairs, model).collect()):
        for e in r["difference"]:
            rows[i, e["key"]] = e["value"]
    rng = np.random.default_rng(4)
    at = reward.LinearScorer(rng.normal(0, 0.05, 256))
    got = np.zeros(256)
    for r in reward.penalised_gradient(pairs, model, at, 0.1).collect():
        got[r["feature"]] = r["gradient"]
    for i in rng.integers(0, 256, 30):
        step = np.zeros(256)
        step[i] = 1e-5
        numeric = (loss(rows, at.coefficients + step, 0.1) - loss(rows, at.coefficients - step, 0.1)) / 2e-5
        assert got[i] == pytest.approx(numeric, abs=1e-6)
    assert reward.gradient_norm(reward.penalised_gradient(pairs, model, scorer)) < 1e-3
    far = reward.LinearScorer(np.asarray(scorer.coefficients) + 0.1)
    assert reward.gradient_norm(reward.penalised_gradient(pairs, model, far)) > 1e-2


def test_the_steepest_step_learns(pairs, fitted):
    model, _ = fitted
    row = reward.pair_metrics(reward.score_pairs(pairs, model, reward.steepest_scorer(pairs, model))).first()
    assert row["pairs"] == 80 and row["accuracy"] > 0.95


def test_buckets_are_those_of_md5(spark):
    words = ["story", "Ä", "", "日本", "3"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", reward.bucket(F.col("w"), 1000).alias("b")).collect()
    assert all(r["b"] == int(hashlib.md5(r["w"].encode()).hexdigest()[:8], 16) % 1000 for r in got)


def test_metrics_of_extreme_margins(spark):
    rows = [(1000.0, -1000.0), (-1000.0, 1000.0), (0.0, 0.0), (2.0, 1.0), (None, 1.0)]
    row = reward.pair_metrics(spark.createDataFrame(rows, "chosen_score double, rejected_score double")).first()
    wanted = [0.0, 2000.0, math.log(2), math.log(1 + math.exp(-1))]
    assert row["pairs"] == 4 and row["accuracy"] == 0.5
    assert row["mean_loss"] == pytest.approx(sum(wanted) / 4)


def test_words_are_hashed_once_a_batch_and_stories_once(spark, pairs, fitted, plan):
    """Terms are the buckets of the tokens; the gradient works out the features of each story once, not for score and difference each."""
    texts = [("The cat, the CAT ça 12",), ("",), (None,), ("...",)]
    df = spark.createDataFrame(texts, "t string")
    by_token = F.transform(reward.tokens(F.col("t")), lambda w: reward.bucket(w, 1000).cast("string"))
    got = df.select(reward._terms(F.col("t"), 1000).alias("a"), by_token.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[2]["a"] is None and got[1]["a"] == []
    told = plan(reward.penalised_gradient(pairs, *fitted))
    assert told.count("ArrowEvalPython") == 2 and "md5" not in told
