"""Language identification and quality on texts whose answer is known."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefweave.llm import language as G
from prefweave.llm import quality as Q
from prefweave.llm.queries import QUERIES

EDGES = "doc_id bigint, text string, lang string, score string, rejected int, x string"
SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def words(seed, alphabet, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(alphabet, k=draw.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, words(i, "abcde", 60), "one") for i in range(60)] + [(100 + i, words(i, "stuvé", 60), "two") for i in range(60)]
    rows += [(300, None, "one"), (301, words(1, "mn", 40), None), (None, words(2, "abcde", 60), "one"), (5, words(5, "abcde", 60), "one")]
    labelled = spark.createDataFrame([(*r, "s", 1, "x") for r in rows], EDGES)
    return G.fit_language_model(labelled, rows=50)


def test_languages_of_edge_rows(spark, model):
    assert model.languages == ["one", "two"]
    rows = [(1, words(900, "abcde", 30)), (2, words(901, "stuvé", 30)), (3, None), (4, ""), (5, "12 $$ \n"), (None, words(902, "stuvé", 5000)), (1, "bad cab")]
    table = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in rows], EDGES)
    got = table.select(G.identified(F.col("text"), spark.sparkContext.broadcast(model)).alias("f")).select("f.*").collect()
    assert [r["lang"] for r in got] == ["one", "two", "und", "und", "und", "two", "one"]
    assert [r["rejected"] for r in got] == [False, False, True, True, True, False, False]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert table.limit(0).select(G.identified(F.col("text"), spark.sparkContext.broadcast(model)).alias("f")).count() == 0


def test_a_text_counts_the_same_in_any_company():
    texts = ["abc def", "x", "", "éé 12", "abc def"]
    together, begins = G.subword_buckets(texts)
    for i, t in enumerate(texts):
        alone, _ = G.subword_buckets([t])
        stop = begins[i + 1] if i + 1 < len(texts) else together.shape[1]
        assert (together[:, begins[i] : stop] == alone).all()


def test_nothing_learned(spark):
    none = spark.createDataFrame([], EDGES)
    known = G.fit_language_model(none)
    assert known.languages == []
    table = spark.createDataFrame([(1, "abc", None, "s", 1, "x"), (2, "1", None, "s", 1, "x")], EDGES)
    got = table.select(G.identified(F.col("text"), spark.sparkContext.broadcast(known)).alias("f")).select("f.*").collect()
    assert [(r["lang"], r["rejected"]) for r in got] == [("und", False), ("und", True)]


@needs_tables
def test_the_sample_reaches_the_driver_as_arrays(spark, model, monkeypatch):
    """Not number by number; the model is that of its rows in order, however they are dealt."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(self, *_):
        raise AssertionError("Python numbers on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(DataFrame, "collect", refused)
    rows = [(i, f"{'abc' if i % 2 else 'xyz'} {i}", ("one", "two")[i % 2]) for i in range(40)]
    df = spark.createDataFrame([*rows, (90, None, "one"), (91, "abc", None)], "doc_id int, text string, lang string")
    first, second = (G.fit_language_model(x, rows=30) for x in (df.coalesce(1), df.repartition(7)))
    assert first.languages == ["one", "two"]
    assert (first.table == second.table).all() and first.threshold == second.threshold


def test_held_out_languages(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language"](spark, SF).join(truth, "doc_id").filter("held_out and lang is not null").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"])
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["rejected"].mean() < 0.01


def test_prior_and_risk_on_known_mixtures():
    """Two overlapping classes, four in five unlabelled rows positive: the prior and the ranking are found."""
    rng = np.random.default_rng(3)
    shape = lambda n, shift: rng.normal(shift, 1, (n, Q.FEATURES))
    positive = shape(3000, 0.6)
    unlabelled = np.concatenate([shape(4800, 0.6), shape(1200, -0.6)])
    model = Q.fit_pu(positive, unlabelled)
    assert abs(model.prior - 0.8) < 0.12
    assert model.score(shape(500, 0.6)).mean() > 0.8 and model.score(shape(500, -0.6)).mean() < 0.3


def test_features_do_not_depend_on_company():
    texts = ["", "One two. Two!", "a | b | a | b", "x\ny\nx", "é" * 50, "Word Word Word $$$"]
    together = Q.features(texts)
    assert np.isfinite(together).all()
    for row, t in zip(together, texts):
        assert np.allclose(row, Q.features([t])[0])


def test_quality_of_edge_rows(spark):
    rows = [(i, words(i, "abcdeimnorst", 80) + ".") for i in range(80)] + [(100 + i, "x | " * 60) for i in range(40)]
    rows += [(None, "text"), (200, None), (201, ""), (3, rows[3][1]), (202, "long " * 100_000)]
    table = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in rows], EDGES)
    trusted = spark.createDataFrame([(i,) for i in range(0, 80, 2)], "doc_id bigint")
    fitted = Q.fit_quality(table, trusted)
    score = Q.quality_score(F.col("text"), spark.sparkContext.broadcast(fitted))
    got = table.select("doc_id", score.alias("own")).collect()
    assert len(got) == len(rows) and all(0 <= r["own"] <= 1 for r in got)
    mean = lambda low, high: np.mean([r["own"] for r in got if r["doc_id"] is not None and low <= r["doc_id"] < high])
    assert mean(0, 80) > 0.7 > 0.3 > mean(100, 140)
    assert Q.fit_quality(table, trusted.limit(0)) is None
    untold = Q.quality_score(F.col("text"), spark.sparkContext.broadcast(None))
    assert table.select(untold.alias("own")).filter("own = 0.5").count() == len(rows)


@needs_tables
def test_held_out_quality(spark):
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op8_quality"](spark, "/root/testdata/sf0.1").join(truth, "doc_id").filter("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    area = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    print("area", area, "right", (got["predicted"] == got["quality"]).mean(), "good kept", (good >= 0.7).mean(), "bad kept", (bad >= 0.7).mean())
    assert area > 0.9
    assert (got["predicted"] == got["quality"]).mean() > 0.85


def test_samples_are_bounded_where_ids_repeat(spark):
    """A third of the rows without an id and a third under one id: samples keep their bound and draw from all of them."""
    rows = [(None, f"none {i}") for i in range(3000)] + [(7, f"seven {i}") for i in range(3000)] + [(100 + i, f"own {i}") for i in range(3000)]
    rows += [(None, "same text")] * 500
    table = spark.createDataFrame([(i, t, "one", "s", 1, "x") for i, t in rows], EDGES).repartition(5)
    sample = G.draw(table, "doc_id", "text", "lang", 90)
    got = sorted(r["text"] for r in sample.collect())
    assert len(got) == 90 and len(set(got)) == 90
    assert {t.split(" ")[0] for t in got} >= {"none", "seven", "own"}
    assert got == sorted(r["text"] for r in G.draw(table.repartition(3), "doc_id", "text", "lang", 90).collect())

    seen, fit = [], Q.fit_pu
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(Q, "fit_pu", lambda p, u: seen.append((len(p), len(u))) or fit(p, u))
        Q.fit_quality(table, spark.createDataFrame([(7,)], "doc_id bigint"), positives=40, unlabelled=200)
    assert seen == [(40, 200)]
