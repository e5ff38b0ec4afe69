"""Scans and sinks: round trips over hostile text, guards, cache, bucketed look-ups."""

import glob

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from prefweave import fixed_values as V
from prefweave import schemas
from prefweave.sources import csv_edge, sinks, tables

HOSTILE = ["plain", " lead ", 'quote " inside', '""', "comma, here", "line\nbreak", "back\\slash", "\\", "'", "tab\t", "é ✓"]


def as_read(text):
    return None if text is None or text in V.CSV_NULL_WORDS else text


def pairs_frame(stories):
    return pd.DataFrame(
        {
            "prompt": [f"p{i}" for i in range(len(stories))],
            "chosen_story": stories,
            "rejected_story": stories[::-1],
            "chosen_comment_score": [None if i == 0 else i for i in range(len(stories))],
            "chosen_timestamp": [1.7e9 + i for i in range(len(stories))],
        }
    )


def read(spark, path):
    return {r["prompt"]: r for r in csv_edge.read_pairs_csv(spark, path).collect()}


def test_reads_what_pandas_wrote(spark, tmp_path):
    stories = HOSTILE + V.CSV_NULL_WORDS
    path = str(tmp_path / "pairs.csv")
    pairs_frame(stories).to_csv(path, index=False)
    got = read(spark, path)
    wanted = pd.read_csv(path)
    for i, row in wanted.iterrows():
        mine = got[f"p{i}"]
        assert mine["chosen_story"] == as_read(stories[i])
        assert mine["chosen_story"] == (None if pd.isna(row["chosen_story"]) else row["chosen_story"])
        assert mine["chosen_comment_score"] == (None if i == 0 else i)
        assert mine["chosen_timestamp"] == row["chosen_timestamp"]


text_values = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00\r"), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(text_values, min_size=1, max_size=30))
def test_csv_round_trip(spark, tmp_path_factory, stories):
    folder = str(tmp_path_factory.mktemp("csv"))
    rows = [(i, f"p{i}", s, "r") for i, s in enumerate(stories)]
    df = spark.createDataFrame(rows, "pair_id bigint, prompt string, chosen_story string, rejected_story string")
    sinks.write_pairs(df, f"{folder}/pairs", format="csv")
    got = read(spark, f"{folder}/pairs")
    assert [got[f"p{i}"]["chosen_story"] for i in range(len(stories))] == [as_read(s) for s in stories]


def test_missing_file_or_column(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_edge.read_pairs_csv(spark, str(tmp_path / "nothing.csv"))
    path = str(tmp_path / "short.csv")
    pd.DataFrame({"prompt": ["p"], "chosen_story": ["c"]}).to_csv(path, index=False)
    with pytest.raises(ValueError, match="rejected_story"):
        csv_edge.read_pairs_csv(spark, path)


def test_posts_csv_reads_the_same_in_pandas(spark, tmp_path):
    rows = [(f"p{i}", s, "", "u", i, 1, 1704067200.0 + i, None if i % 2 else "ann", "s", "l", bool(i % 2), 0.97) for i, s in enumerate(HOSTILE)]
    posts = spark.createDataFrame(rows, schemas.POSTS)
    path = str(tmp_path / "posts")
    assert csv_edge.write_posts_csv(posts, path) is True
    frame = pd.concat(pd.read_csv(f, keep_default_na=False) for f in glob.glob(f"{path}/part-*.csv"))
    by_id = {r["post_id"]: r for _, r in frame.iterrows()}
    assert list(frame.columns) == V.POST_FIELDS
    for i, s in enumerate(HOSTILE):
        row = by_id[f"p{i}"]
        assert (row["title"], row["score"], row["created_utc"]) == (s, i, 1704067200.0 + i)
        assert row["is_self"] == bool(i % 2) and row["author"] == ("None" if i % 2 else "ann")
    raw = "".join(open(f).read() for f in glob.glob(f"{path}/part-*.csv"))
    assert "1704067200.0" in raw and "True" in raw


def test_no_posts_no_file(spark, tmp_path):
    path = tmp_path / "none"
    assert csv_edge.write_posts_csv(spark.createDataFrame([], schemas.POSTS), str(path)) is False
    assert not path.exists()


def test_pairs_are_not_overwritten(spark, tmp_path):
    one = spark.createDataFrame([(1, "p", "c", "r")], "pair_id bigint, prompt string, chosen_story string, rejected_story string")
    path = str(tmp_path / "pairs")
    sinks.write_pairs(one, path)
    with pytest.raises(AnalysisException):
        sinks.write_pairs(one.union(one), path)
    assert spark.read.parquet(path).count() == 1
    sinks.write_pairs(one.union(one), path, overwrite=True)
    assert spark.read.parquet(path).count() == 2


def test_cache_is_written_once_and_per_key(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    first, other = [sinks.cache_key("org/m", 8, "train", "src", seed) for seed in (1, 2)]
    assert first != other and "/" not in first
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path), first, build).count() == 3
    assert len(calls) == 1
    sinks.cached(spark, str(tmp_path), other, build)
    assert len(calls) == 2
    assert sinks.cache_key("m", 8, "train", "src", 1, size=1) != sinks.cache_key("m", 8, "train", "src", 1, size=2)


def test_two_builders_never_mix(spark, tmp_path):
    """Both build; one is published, and every reader sees that one whole."""
    path = f"{tmp_path}/key"
    slow = spark.range(50).selectExpr("id", "'slow' AS who").repartition(5)
    fast = spark.range(50).selectExpr("id", "'fast' AS who").repartition(3)

    def build_slowly():
        # Another builder is done in the meantime.
        assert {r["who"] for r in sinks.cached(spark, str(tmp_path), "key", lambda: fast).collect()} == {"fast"}
        return slow

    got = sinks.cached(spark, str(tmp_path), "key", build_slowly, check=True).collect()
    assert len(got) == 50 and {r["who"] for r in got} == {"fast"}
    manifest = sinks.published(spark, path)
    assert manifest["rows"] == 50
    # Should both have published at once, all readers take the same one of them.
    other = spark.createDataFrame([(manifest["published"] + 1, "zzz", 50, "0")], sinks.MANIFEST)
    other.write.mode("append").parquet(f"{path}/manifests")
    assert sinks.published(spark, path)["build"] == manifest["build"]
    assert sinks.cached(spark, str(tmp_path), "key", build_slowly).count() == 50


def test_half_a_copy_is_not_read(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/key/build-dead")
    assert sinks.published(spark, f"{tmp_path}/key") is None
    assert sinks.cached(spark, str(tmp_path), "key", lambda: spark.range(9)).count() == 9


def test_a_changed_copy_is_noticed(spark, tmp_path):
    sinks.cached(spark, str(tmp_path), "key", lambda: spark.range(9))
    manifest = sinks.published(spark, f"{tmp_path}/key")
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/key/build-{manifest['build']}")
    with pytest.raises(ValueError, match="published"):
        sinks.cached(spark, str(tmp_path), "key", lambda: spark.range(9), check=True)


def test_row_ids_of_repeated_rows(spark):
    rows = [("a", "b")] * 25 + [("a", None), ("ab", ""), ("a", "b:"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    got = tables.with_row_id(df, ["x", "y"], chunk=4).collect()
    assert sorted((r["x"], r["y"]) for r in got if r["x"] and r["y"]) == sorted(r for r in rows if r[0] and r[1])
    assert len(got) == len({r["pair_id"] for r in got}) == len(rows)
    again = tables.with_row_id(df.repartition(5), ["x", "y"]).collect()
    assert {r["pair_id"] for r in again} == {r["pair_id"] for r in got}


def test_json_dump(spark, tmp_path):
    path = tmp_path / "comments.jsonl"
    path.write_text('{"comment_id": "c1", "body": "x", "score": 3, "extra": 1}\n{"comment_id": "c2"}\n')
    got = {r["comment_id"]: r for r in tables.scan_comments(spark, str(path)).collect()}
    assert got["c1"]["score"] == 3 and got["c2"]["body"] is None and "extra" not in got["c1"]


def test_bucketed_dump_is_not_shuffled(spark, plan, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS dumps LOCATION '{tmp_path}/dumps'")
    comments = spark.range(200).selectExpr("concat('c', id) AS comment_id", "'text' AS body")
    table = tables.save_bucketed(comments, "dumps.comments", "comment_id", 16)
    ids = spark.range(50).selectExpr("concat('c', id) AS id").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = table.join(ids, table["comment_id"] == ids["id"], "left_semi")
        text = plan(joined)
        assert joined.count() == 50
        # The wanted ids come to the buckets; nothing lies between the join and the scan of the dump.
        assert "Exchange" not in text[text.index("SortMergeJoin") : text.index("FileScan")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE dumps CASCADE")
