"""Forum queries on dumps of posts and comments: records, top lists, search, look-ups by id."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.functions.text import author_text, is_top_level
from prefweave.operators.skew import HOT_ROWS, key_load, lookup, top_k_by_group

_DAY = 86_400
# A stated choice: a month is 30 days and a year 365.
HOT_SECONDS = 45_000
SPANS = {"all": None, "day": _DAY, "week": 7 * _DAY, "month": 30 * _DAY, "year": 365 * _DAY}


def post_record(posts: DataFrame) -> DataFrame:
    """B1. The 12 fields of a post."""
    return posts.withColumn("author", author_text(F.col("author"))).select(*V.POST_FIELDS)


def comment_record(comments: DataFrame) -> DataFrame:
    """B2. The 7 fields of a comment below a post."""
    return (
        comments.withColumn("author", author_text(F.col("author")))
        .withColumn("is_top_level", is_top_level(F.col("parent_id")))
        .select(*V.COMMENT_FIELDS)
    )


def reply_record(comments: DataFrame, *keep: str) -> DataFrame:
    """B3. The 7 fields of a reply, for comments that already carry their depth; `keep` names columns to go before."""
    return comments.withColumn("author", author_text(F.col("author"))).select(*keep, *V.REPLY_FIELDS)


def real_comments(listing: DataFrame) -> DataFrame:
    """B6. A listing without its placeholders."""
    return listing.filter(F.col("kind") == "comment")


def keep_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """B9. Drop the source columns once they are mapped."""
    return df.select(*columns)


def _within(posts: DataFrame, time_filter: str, as_of) -> DataFrame:
    if time_filter not in SPANS:
        raise ValueError(f"time_filter must be one of {list(SPANS)}, got {time_filter!r}")
    span = SPANS[time_filter]
    now = F.unix_timestamp() if as_of is None else F.lit(float(as_of))
    until = posts.filter(F.col("created_utc") <= now)
    return until if span is None else until.filter(F.col("created_utc") >= now - span)


def top_posts(
    posts: DataFrame,
    subreddit: str | None = None,
    time_filter: str = "all",
    limit: int = V.TOP_LIMIT,
    as_of: float | None = None,
) -> DataFrame:
    """C1. The best-scored posts of one subreddit, or of each subreddit, in the time up to `as_of` (now, if none is given).

    Equal scores are ordered by post id. For all subreddits the result carries the `rank` in its subreddit. Ids and
    scores are ranked alone; the posts that won are fetched by id.
    """
    recent = _within(posts, time_filter, as_of)
    order = [F.desc("score"), F.asc("post_id")]
    if subreddit is not None:
        best = recent.filter(F.col("subreddit") == subreddit).select("post_id", "score").orderBy(*order).limit(limit)
        return _fetched(posts, best.select("post_id"), limit).orderBy(*order).limit(limit)
    ranked = top_k_by_group(recent.select("subreddit", "post_id", "score"), ["subreddit"], order, limit)
    return post_record(posts).join(ranked.select("post_id", "rank"), "post_id").select(*V.POST_FIELDS, "rank")


# Ids of so many posts are small enough to ship to every task.
_SHIPPED_IDS = 100_000


def _fetched(posts: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The records of the posts with these ids, at most `limit` of them."""
    wanted = F.broadcast(ids) if limit <= _SHIPPED_IDS else ids
    return post_record(posts.join(wanted, "post_id", "left_semi"))


def hot_rank() -> Column:
    """The sign of the score times the decimal logarithm of its size (at least 1), plus creation time over HOT_SECONDS."""
    size = F.log10(F.greatest(F.abs("score"), F.lit(1)).cast("double"))
    return F.signum(F.col("score").cast("double")) * size + F.col("created_utc") / HOT_SECONDS


def search_posts(
    posts: DataFrame,
    subreddit: str,
    query: str,
    sort: str | Column = "relevance",
    limit: int = V.SEARCH_LIMIT,
) -> DataFrame:
    """C2. Posts of a subreddit that hold every word of `query` in title or text, in any case.

    The ranking of the remote service is not known; ours is stated: `relevance` counts in how many fields the words
    were found, then score; `top` is score; `new` is creation time; `hot` is the sign of the score times the decimal
    logarithm of its size (at least 1), plus one for every 45,000 seconds of creation time; any other ranking is a Column to
    sort by, highest first. Ties go by post id. Ids are ranked alone, and the posts that won are fetched by id.
    """
    terms = query.lower().split()
    title, text = F.lower(F.col("title")), F.lower(F.col("selftext"))

    def found(field: Column, term: str) -> Column:
        return F.coalesce(F.contains(field, F.lit(term)), F.lit(False))

    hits = posts.filter(F.col("subreddit") == subreddit)
    if terms:
        hits = hits.filter(reduce(and_, [found(title, t) | found(text, t) for t in terms]))
    if isinstance(sort, Column):
        ranking = [sort]
    elif sort == "relevance":
        matches = [found(field, t).cast("int") for t in terms for field in (title, text)]
        ranking = [reduce(add, matches, F.lit(0)), F.col("score")]
    elif sort == "top":
        ranking = [F.col("score")]
    elif sort == "new":
        ranking = [F.col("created_utc")]
    elif sort == "hot":
        ranking = [hot_rank()]
    else:
        raise ValueError("sort must be 'relevance', 'top', 'new', 'hot' or a Column")
    # As columns, so that the text is searched once per row and not once per comparison of the sort.
    names = [f"_by_{i}" for i in range(len(ranking))]
    order = [*[F.desc(name) for name in names], F.asc("post_id")]
    ranked = hits.select("post_id", *[by.alias(name) for name, by in zip(names, ranking)])
    best = ranked.orderBy(*order).limit(limit)
    records = post_record(posts).join(F.broadcast(best) if limit <= _SHIPPED_IDS else best, "post_id")
    return records.orderBy(*order).limit(limit).select(*V.POST_FIELDS)


def posts_by_id(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """C3. One row per distinct id of `ids` (column post_id); all other fields are null for an unknown id.

    The posts are cut down to the wanted ones by a semi-join first, because an outer join could not broadcast a small
    `ids` and would shuffle every post.
    """
    wanted = ids.select("post_id").distinct()
    found = post_record(posts.join(wanted, "post_id", "left_semi"))
    return wanted.join(found, "post_id", "left").select(*V.POST_FIELDS)


def comments_by_id(comments: DataFrame, posts: DataFrame, ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """C8. The 14 fields of each wanted comment (column comment_id of `ids`); unknown ids are absent.

    As in rehydration, comments are cut down to the wanted ones where they are scanned, and ids alone meet the titles.
    """
    wanted = ids.select("comment_id").distinct()
    places = comments.select("comment_id", "post_id")
    load = key_load(places.select("post_id"))
    comments = comments.join(wanted, "comment_id", "left_semi")
    places = comments.select("comment_id", "post_id")
    titles = posts.select(F.col("post_id").alias("_post"), F.col("title").alias("post_title"))
    titled = lookup(
        places, "post_id", titles, "_post", ["comment_id"],
        hot_rows=hot_rows, load=load,
    ).select("comment_id", "post_title")
    return (
        comments.join(titled, "comment_id")
        .withColumn("author", author_text(F.col("author")))
        .withColumn("is_top_level", is_top_level(F.col("parent_id")))
        .select(*V.COMMENT_BY_ID_FIELDS)
    )
