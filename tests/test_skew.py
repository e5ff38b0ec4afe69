"""Joins, top-k and ranks with a key that holds most rows, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prefweave.operators.skew import (
    hot_keys, key_load, lookup, rank_in_group, salt_lookup, top_k, top_k_by_group,
)


@pytest.fixture(scope="module")
def skewed():
    draw = random.Random(1)
    keys = ["hot"] * 500 + [None] * 200 + [f"k{draw.randrange(60)}" for _ in range(300)]
    draw.shuffle(keys)
    return [(i, key, draw.randrange(50)) for i, key in enumerate(keys)]


@pytest.fixture(scope="module")
def rows(spark, skewed):
    return spark.createDataFrame(skewed, "id int, key string, value int").repartition(8)


def test_key_load(rows):
    load = key_load(rows.select("key"))
    assert (load.rows, load.heaviest) == (1000, 500)
    empty = key_load(rows.filter("false").select("key"))
    assert (empty.rows, empty.heaviest) == (0, 0)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_lookup_is_a_plain_join(spark, rows, skewed, how, hot_rows):
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 60, 2)], "k string, found int")
    got = lookup(rows, "key", table, "k", ["id"], how, hot_rows)
    known = {"hot": 1, **{f"k{i}": i for i in range(0, 60, 2)}}
    wanted = {(i, key, value, known.get(key)) for i, key, value in skewed if how == "left" or key in known}
    assert got.columns == ["id", "key", "value", "found"]
    assert {tuple(r) for r in got.collect()} == wanted
    assert got.count() == len(wanted)


def test_hot_key_is_split(spark, rows):
    hot = hot_keys(rows.select("key"), 100)
    assert [tuple(r) for r in hot.collect()] == [("hot", 5)]
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, found int")
    slots = salt_lookup(table, "k", hot, "slot").select("k", "slot").collect()
    assert sorted(tuple(r) for r in slots) == [("hot", i) for i in range(5)] + [("k1", 0)]


def test_salted_rows_of_a_hot_key_lie_in_several_tasks(spark, rows):
    from prefweave.operators.skew import salt_rows

    salted = salt_rows(rows, "key", ["id"], hot_keys(rows.select("key"), 100), "salt")
    per_slot = {tuple(r)[:2]: r["count"] for r in salted.groupBy("key", "salt").count().collect()}
    assert sum(n for (key, _), n in per_slot.items() if key == "hot") == 500
    assert max(n for (key, _), n in per_slot.items() if key == "hot") < 200
    assert max(n for (key, _), n in per_slot.items() if key is None) < 20


def test_top_k_by_group(rows, skewed):
    got = top_k_by_group(rows, ["key"], [F.desc("value"), F.asc("id")], 7)
    groups = defaultdict(list)
    for i, key, value in skewed:
        groups[key].append((-value, i))
    wanted = {(key, rank, i) for key, group in groups.items() for rank, (_, i) in enumerate(sorted(group)[:7], 1)}
    assert {(r["key"], r["rank"], r["id"]) for r in got.collect()} == wanted


def test_top_k(rows, skewed):
    got = top_k(rows, [F.desc("value"), F.asc("id")], 25).collect()
    wanted = sorted((-value, i) for i, _, value in skewed)[:25]
    assert sorted((-r["value"], r["id"]) for r in got) == wanted
    assert got[0].asDict().keys() == {"id", "key", "value"}


def test_rank_in_group_of_any_size(rows, skewed):
    got = {r["id"]: r["rank"] for r in rank_in_group(rows, ["key"], ["value", "id"], "rank").collect()}
    groups = defaultdict(list)
    for i, key, value in skewed:
        groups[key].append((value, i))
    wanted = {i: rank for group in groups.values() for rank, (_, i) in enumerate(sorted(group))}
    assert got == wanted


def test_no_task_sees_a_whole_group(rows, plan):
    text = plan(top_k_by_group(rows, ["key"], [F.asc("id")], 3))
    assert text.count("WindowGroupLimit") == 4  # both rounds, before and after their shuffle
    assert "SinglePartition" not in text
