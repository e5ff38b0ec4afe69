"""Splits, samples and batch plans: exact sizes, disjoint, covering, independent of the layout."""

import hashlib
import math

import pytest

from prefweave.operators import batches, sampling


def table(spark, n, parts=3):
    rows = [(i * 7, f"text {i % 4}") for i in range(n)]
    return spark.createDataFrame(rows, "pair_id bigint, text string").repartition(parts)


def order(ids, seed="42"):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 1000])
def test_exact_split(spark, n):
    df = table(spark, n)
    train, test = sampling.exact_split(df, "pair_id")
    train_ids = [r["pair_id"] for r in train.collect()]
    test_ids = [r["pair_id"] for r in test.collect()]
    assert len(test_ids) == math.ceil(n * 0.05)
    assert sorted(train_ids + test_ids) == [i * 7 for i in range(n)]
    assert sorted(test_ids) == sorted(order([i * 7 for i in range(n)])[: len(test_ids)])
    again = sampling.exact_split(df.repartition(7), "pair_id")[1]
    assert sorted(r["pair_id"] for r in again.collect()) == sorted(test_ids)


@pytest.mark.parametrize("n,wanted", [(0, 0), (3, 3), (10, 10), (700, 500)])
def test_validation_sample(spark, n, wanted):
    got = [r["pair_id"] for r in sampling.validation_sample(table(spark, n)).collect()]
    assert len(got) == len(set(got)) == wanted
    assert sorted(got) == sorted(order([i * 7 for i in range(n)])[:wanted])


def test_text_keys(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "pair_id string")
    assert sampling.validation_sample(df, 8).count() == 8


def test_split_sizes(spark):
    sizes = sampling.split_sizes(train=table(spark, 5), test=table(spark, 0))
    assert {r["split"]: r["rows"] for r in sizes.collect()} == {"train": 5, "test": 0}


def test_stable_position(spark):
    got = {r["pair_id"]: r["position"] for r in sampling.stable_position(table(spark, 300), "pair_id", 42).collect()}
    assert got == {i: place for place, i in enumerate(order([i * 7 for i in range(300)]))}


def test_no_task_orders_the_table(spark, plan):
    """The only window over everything runs on the bucket counts."""
    text = plan(sampling.stable_position(table(spark, 50), "pair_id", 42))
    single = text.split("SinglePartition")
    assert len(single) == 2 and "HashAggregate(keys=[_bucket" in single[1].split("Exchange")[1] + single[1]
    train, test = sampling.exact_split(table(spark, 50), "pair_id")
    for split in (train, test):
        assert "Window" not in plan(split) and "SinglePartition" not in plan(split)


@pytest.mark.parametrize("n,size", [(0, 4), (1, 4), (20, 4), (21, 4), (3, 1)])
def test_batches(spark, n, size):
    plan = batches.assign_batches(table(spark, n).select("pair_id"), "pair_id", size, epochs=2)
    rows = plan.collect()
    ids = [i * 7 for i in range(n)]
    for epoch in (0, 1):
        got = {r["pair_id"]: r["batch"] for r in rows if r["epoch"] == epoch}
        assert got == {i: place // size for place, i in enumerate(order(ids, f"42:{epoch}"))}
    full = batches.drop_last(plan, size)
    assert full.count() == 2 * (n // size) * size
    assert full.columns == plan.columns


@pytest.mark.parametrize(
    "n,batch,devices,accumulation,steps", [(43_827, 8, 1, 16, 343), (10, 2, 3, 22, 1), (0, 8, 1, 16, 0), (300, 200, 1, 1, 2)]
)
def test_training_plan(spark, n, batch, devices, accumulation, steps):
    row = batches.training_plan(spark.range(n), batch, devices).first()
    assert (row["total_rows"], row["accumulation"], row["steps_per_epoch"]) == (n, accumulation, steps)
    assert row["effective_batch"] == batch * devices * accumulation >= 128


def test_pad_to_batch(spark):
    rows = [(0, 0, [1, 2, 3]), (0, 0, [4]), (0, 1, []), (0, 1, [5, 6])]
    df = spark.createDataFrame(rows, "epoch int, batch bigint, ids array<int>")
    got = {(r["batch"], tuple(r["ids"]), tuple(r["attention_mask"])) for r in batches.pad_to_batch(df, "ids", 9).collect()}
    assert got == {(0, (1, 2, 3), (1, 1, 1)), (0, (4, 9, 9), (1, 0, 0)), (1, (9, 9), (0, 0)), (1, (5, 6), (1, 1))}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 97, 100, 101, 1000])
def test_permutations(spark, n):
    """Every epoch places every row once, in an order of its own, the same on every run."""
    plan = batches.permuted_batches(table(spark, n), "pair_id", 8, epochs=4)
    rows = [(r["epoch"], r["position"], r["pair_id"], r["batch"]) for r in plan.collect()]
    assert sorted((e, p) for e, p, _, _ in rows) == [(e, p) for e in range(4) for p in range(n)]
    assert sorted((e, i) for e, _, i, _ in rows) == [(e, i * 7) for e in range(4) for i in range(n)]
    assert all(b == p // 8 for _, p, _, b in rows)
    again = batches.permuted_batches(table(spark, n, 5), "pair_id", 8, epochs=4)
    assert sorted(rows) == sorted((r["epoch"], r["position"], r["pair_id"], r["batch"]) for r in again.collect())
    if n >= 97:
        orders = [[i for e, _, i, _ in sorted(rows) if e == epoch] for epoch in range(4)]
        assert len({tuple(o) for o in orders}) == 4
        # Neighbours of one epoch are not neighbours of the next.
        place = {i: p for p, i in enumerate(orders[1])}
        close = sum(abs(place[a] - place[b]) < 4 for a, b in zip(orders[0], orders[0][1:]))
        assert close < n / 5


def test_epochs_share_one_ordering(spark, plan):
    text = plan(batches.permuted_batches(table(spark, 50), "pair_id", 8, epochs=4))
    assert text.count("Window ") <= 3 and "epoch" not in "".join(line for line in text.splitlines() if "Exchange" in line)
