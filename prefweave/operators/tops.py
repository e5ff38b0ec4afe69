"""Top lists from summaries: the best posts of every subreddit and day, merged for any range of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefweave import fixed_values as V
from prefweave.operators.forum import SPANS, _fetched, _within
from prefweave.operators.skew import top_k_by_group

DAY = 86_400
# Lists that are merged into one at a time: a task ranks so many times the limit at most.
FAN_IN = 8


def _order() -> list:
    return [F.desc("score"), F.asc("post_id")]


def daily_tops(posts: DataFrame, limit: int = V.TOP_LIMIT) -> DataFrame:
    """(subreddit, day, post_id, score, created_utc): the `limit` best posts of every subreddit and UTC day, ties by id.

    A summary to store: at most `limit` rows per subreddit and day, without texts. A day that is over needs no second look; a
    new day is added by its own rows.
    """
    days = F.floor(F.col("created_utc") / DAY).cast("bigint")
    narrow = posts.select("subreddit", days.alias("day"), "post_id", F.col("score").cast("bigint").alias("score"), "created_utc")
    return top_k_by_group(narrow, ["subreddit", "day"], _order(), limit).drop("rank")


def merged_tops(tops: DataFrame, first_day: int, last_day: int, limit: int = V.TOP_LIMIT) -> DataFrame:
    """(subreddit, post_id, score, rank): the `limit` best posts of every subreddit over the days from first to last, both included.

    What is best over some days is among the best of one of them, so summaries made with at least this `limit` hold it. They
    are merged in a tree: FAN_IN neighbouring lists of a subreddit at a time, until one is left.
    """
    if first_day > last_day:
        raise ValueError("the first day comes after the last")
    lists = tops.filter(F.col("day").between(first_day, last_day)).withColumn("_list", F.col("day") - first_day)
    count = last_day - first_day + 1
    while True:
        lists = lists.withColumn("_list", F.floor(F.col("_list") / FAN_IN).cast("bigint"))
        count = -(-count // FAN_IN)
        window = Window.partitionBy("subreddit", "_list").orderBy(*_order())
        lists = lists.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)
        if count == 1:
            return lists.select("subreddit", "post_id", "score", "rank")


def top_posts_by_days(
    tops: DataFrame, posts: DataFrame, subreddit: str, time_filter: str, as_of: float, limit: int = V.TOP_LIMIT
) -> DataFrame:
    """C1 for one subreddit, from summaries: the same posts as `top_posts`.

    Days that lie whole within the time are read from `tops` (made with at least this `limit`); of `posts` only those of the
    days at both ends that do not are looked at, by their time. The posts that won are fetched by id.
    """
    mine = posts.filter(F.col("subreddit") == subreddit)
    recent = _within(mine, time_filter, as_of).select("post_id", F.col("score").cast("bigint").alias("score"), "created_utc")
    # The first and the last day that lie whole within the time.
    last = int(as_of // DAY) - 1
    first = None if time_filter == "all" else -int(-(as_of - SPANS[time_filter]) // DAY)
    whole = tops.filter((F.col("subreddit") == subreddit) & (F.col("day") <= last))
    edge = F.col("created_utc") >= (last + 1) * DAY
    if first is None:
        start = whole.agg(F.min("day")).first()[0]
        first = last + 1 if start is None else start
    else:
        edge = edge | (F.col("created_utc") < first * DAY)
    merged = recent.filter(edge).select("post_id", "score")
    if first <= last:
        merged = merged.unionByName(merged_tops(whole, first, last, limit).select("post_id", "score"))
    best = merged.orderBy(*_order()).limit(limit)
    return _fetched(posts, best.select("post_id"), limit).orderBy(*_order()).limit(limit)

