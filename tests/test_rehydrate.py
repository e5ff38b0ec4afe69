"""Rehydration on hand-made edge tables."""

import pytest

from prefweave.operators import rehydrate as R

RECORD = "id string, story string, score int, author string, timestamp double, post_id string, prompt string"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(
        [
            ("a", "story a", 1, "ann", 1.0, "p", None),
            ("b", "story b", 2, "None", 2.0, "q", "prompt b"),
            ("e", "", 3, "eve", 3.0, "r", "prompt e"),
        ],
        RECORD,
    )


PAIRS = [
    (1, "a", "b"),  # chosen record without a prompt: its null wins over the other prompt
    (2, "x", "b"),  # only the rejected one is there
    (3, "x", "y"),  # neither
    (4, None, None),
    (5, "b", None),
    (6, "a", "b"),  # the same pair again
    (7, "e", "b"),  # an empty story counts as a story
]


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_assemble_pairs(spark, records, hot_rows):
    ids = spark.createDataFrame(PAIRS, "pair_id bigint, chosen_comment_id string, rejected_comment_id string")
    got = {r["pair_id"]: r for r in R.assemble_pairs(ids, records, hot_rows).collect()}
    assert len(got) == len(PAIRS)
    assert [got[i]["prompt"] for i in range(1, 8)] == [None, "prompt b", None, None, "prompt b", None, "prompt e"]
    assert [got[i]["chosen_story"] for i in range(1, 8)] == ["story a", None, None, None, "story b", "story a", ""]
    assert [got[i]["rejected_story"] for i in range(1, 8)] == ["story b", "story b", None, None, None, "story b", "story b"]
    assert got[1]["chosen_comment_score"] == 1 and got[1]["rejected_username"] == "None"
    assert got[2]["chosen_comment_id"] == "x" and got[2]["chosen_timestamp"] is None
    assert R.completeness(R.assemble_pairs(ids, records, hot_rows)).first().asDict() == {
        "total_rows": 7, "complete_rows": 3, "completeness_rate": 3 / 7 * 100,
    }


def test_assembly_with_one_id_in_most_rows(spark, records):
    rows = [(i, "a" if i % 3 else None, "b" if i % 2 else "x") for i in range(600)]
    ids = spark.createDataFrame(rows, "pair_id bigint, chosen_comment_id string, rejected_comment_id string")
    got = R.assemble_pairs(ids, records, hot_rows=50).collect()
    assert len(got) == 600
    for r in got:
        assert r["chosen_story"] == ("story a" if r["pair_id"] % 3 else None)
        assert r["rejected_story"] == ("story b" if r["pair_id"] % 2 else None)


def test_completeness_of_nothing(spark):
    empty = spark.createDataFrame([], "chosen_story string, rejected_story string")
    assert R.completeness(empty).first().asDict() == {"total_rows": 0, "complete_rows": 0, "completeness_rate": None}


def test_first_record_is_that_of_the_first_success(spark):
    attempts = spark.createDataFrame(
        [("a", 0, False, None), ("a", 1, True, "one"), ("a", 2, True, "two"), ("b", 0, False, None)],
        "id string, attempt int, succeeded boolean, story string",
    )
    assert [tuple(r) for r in R.first_record(attempts).collect()] == [("a", "one")]


def test_pending_and_coverage(spark, records):
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert [r["id"] for r in R.pending_ids(ids, records).collect()] == ["z"]
    assert R.coverage(ids, records).first().asDict() == {"fetched": 2, "wanted": 3}


def test_scan_of_the_lookup_is_pruned(spark, plan, tmp_path):
    """The report tests stories for being there; it never moves titles' other columns."""
    from prefweave.plans.rehydration import rehydration_report
    from prefweave.sources import tables

    spark.createDataFrame([("p", "t", "long text")], "post_id string, title string, selftext string").write.parquet(f"{tmp_path}/posts")
    spark.createDataFrame(
        [("c1", "p", "t3_p", "body", 1, 1.0, "ann")],
        "comment_id string, post_id string, parent_id string, body string, score int, created_utc double, author string",
    ).write.parquet(f"{tmp_path}/comments")
    ids = spark.createDataFrame([(1, "c1", None)], "pair_id bigint, chosen_comment_id string, rejected_comment_id string")
    report = rehydration_report(ids, tables.scan_comments(spark, f"{tmp_path}/comments"), tables.scan_posts(spark, f"{tmp_path}/posts"))
    text = plan(report)
    assert "selftext" not in text and "parent_id" not in text and "created_utc" not in text
    assert report.first()["complete_rows"] == 0


def test_text_of_unwanted_comments_stays_where_it_is(spark, plan, tmp_path):
    """For a few ids, what is shuffled with its text has passed the semi-join with the ids."""
    from prefweave.operators.forum import comments_by_id
    from prefweave.sources import tables

    spark.range(50).selectExpr("concat('p', id) AS post_id", "'t' AS title").write.parquet(f"{tmp_path}/posts")
    spark.range(500).selectExpr(
        "concat('c', id) AS comment_id", "concat('p', id % 50) AS post_id", "'t3_p' AS parent_id", "repeat('x', 200) AS body",
        "1 AS score", "1.0D AS created_utc", "'ann' AS author",
    ).write.parquet(f"{tmp_path}/comments")
    comments, posts = tables.scan_comments(spark, f"{tmp_path}/comments"), tables.scan_posts(spark, f"{tmp_path}/posts")
    # Stored ids have a size that the planner sees.
    spark.createDataFrame([("c1",), ("c7",), ("gone",)], "id string").write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    found = R.fetch_records(ids, comments, posts)
    assert sorted(r["id"] for r in found.collect()) == ["c1", "c7"]
    by_id = comments_by_id(comments, posts, ids.withColumnRenamed("id", "comment_id"))
    assert by_id.count() == 2
    for df in (found, by_id):
        lines = plan(df).splitlines()
        for i, line in enumerate(lines):
            if "FileScan" in line and "body" in line:
                above = [x for x in lines[:i] if "LeftSemi" in x or "Exchange" in x]
                assert "LeftSemi" in above[-1] or "BroadcastExchange" in above[-1], plan(df)
