"""Search of posts by an inverted index: a table of postings, read for the words of a query only."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.durable import durable
from prefweave.functions.text import tokens
from prefweave.operators.dictionary import bound_batches
from prefweave.operators.forum import _SHIPPED_IDS, hot_rank, post_record

# Functions of this module travel to the executors by value, which need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Stated constants of BM25: how soon a repeated word adds no more, and how much the length of a post counts.
SATURATION, LENGTH_SHARE = 1.2, 0.75
# Distances in relevance below this are ties.
RELEVANCE_DIGITS = 6
# Columns of a post that its postings repeat. Rows that agree in them, and in their length, count as one post.
_SAME = ["post_id", "subreddit", "score", "created_utc"]


@dataclass(frozen=True)
class SearchIndex:
    """`postings` (see `postings_of`), and the number and the mean length in words of all posts."""

    postings: DataFrame
    posts: int
    mean_length: float


def _counted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The distinct words of each row's title and text, with how often they are in either."""
    for title, text in batches:
        n, titles = len(title), title.flatten()
        coded = pa.concat_arrays([titles, text.flatten()]).dictionary_encode()
        rows = np.concatenate([np.repeat(np.arange(n), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in (title, text)])
        known = max(1, len(coded.dictionary))
        entry, of = np.unique(rows * known + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        counts = [np.bincount(x, minlength=len(entry)).astype(np.int64) for x in (of[: len(titles)], of[len(titles) :])]
        told = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(entry % known)), *map(pa.array, counts)], ["word", "in_title", "in_text"])
        ends = np.searchsorted(entry, np.arange(n + 1) * known)
        yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), told)


def postings_of(posts: DataFrame) -> DataFrame:
    """(word, post_id, subreddit, in_title, in_text, length, score, created_utc), one row for each word of each post.

    `in_title` and `in_text` count the word in that field, `length` all words of both. Words are runs of letters, runs of digits
    and single signs, in lower case. The words of a row are counted in the row, and nothing moves. Only where rows agree in all of
    `_SAME`, which a count of these columns tells, do their postings meet, to be summed.
    """
    bound_batches(posts.sparkSession)
    posts = posts.select(*_SAME[:2], F.col("score").cast("bigint").alias("score"), "created_utc", "title", "selftext")
    again = durable(posts.groupBy(*_SAME).count().filter("count > 1").select(*[F.col(c).alias(f"_{c}") for c in _SAME]))
    if again.isEmpty():
        return _postings(posts)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAME])
    met = _postings(posts.join(again, same, "left_semi"))
    keys = [c for c in met.columns if c not in ("in_title", "in_text")]
    summed = met.groupBy(*keys).agg(F.sum("in_title").alias("in_title"), F.sum("in_text").alias("in_text"))
    return _postings(posts.join(again, same, "left_anti")).unionByName(summed)


def _postings(posts: DataFrame) -> DataFrame:
    """The postings of each row by itself."""
    title, text = (F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in ("title", "selftext"))
    split = posts.select(*_SAME, title.alias("_title"), text.alias("_text"))
    counted = F.arrow_udf(_counted, "array<struct<word string, in_title bigint, in_text bigint>>")(F.col("_title"), F.col("_text"))
    told = split.select(*_SAME, (F.size("_title") + F.size("_text")).alias("length"), counted.alias("_words"))
    rows = told.select(*_SAME, "length", F.inline("_words"))
    return rows.select("word", "post_id", "subreddit", "in_title", "in_text", "length", "score", "created_utc")


def save_index(posts: DataFrame, path: str) -> None:
    """Write the index of `posts` below `path`. It is a copy of their state: posts that change later need a new one.

    Postings are range-partitioned and sorted by word and post, so that a search opens the files, and of these the row groups,
    that may hold its words; a word of very many posts lies in many files.
    """
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings_of(posts).repartitionByRange(parts, "word", "post_id").sortWithinPartitions("word", "post_id")
    dealt.write.parquet(f"{path}/postings")
    length = sum((F.coalesce(F.size(tokens(F.col(c))), F.lit(0)) for c in ("title", "selftext")), F.lit(0))
    told = posts.agg(F.count("*").alias("posts"), F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_length"))
    told.coalesce(1).write.parquet(f"{path}/stats")


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """An index written by `save_index`."""
    told = spark.read.parquet(f"{path}/stats").first()
    return SearchIndex(spark.read.parquet(f"{path}/postings"), told["posts"], told["mean_length"])


def query_words(spark: SparkSession, query: str) -> list[str]:
    """The distinct words of a query, split as the posts are."""
    row = spark.range(1).select(F.array_sort(F.array_distinct(tokens(F.lit(query)))).alias("w")).first()
    return row["w"]


def matches(index: SearchIndex, subreddit: str, words: list[str]) -> DataFrame:
    """(post_id, score, created_utc, relevance) of the posts of a subreddit that hold all `words`.

    Only postings of these words are read. A post holds all words if it has as many postings; counting combines on the map side,
    so a word of very many posts is no hot key. `relevance` is the sum of the words' BM25, a title word as much as any
    other, by the number of all posts that hold the word.
    """
    postings = index.postings.filter(F.col("word").isin(words))
    # One row per word of the query.
    known = postings.groupBy("word").agg(F.count("*").alias("posts"))
    mine = postings.filter(F.col("subreddit") == subreddit).join(F.broadcast(known), "word")
    rarity = F.log1p((index.posts - F.col("posts") + 0.5) / (F.col("posts") + 0.5))
    times = (F.col("in_title") + F.col("in_text")).cast("double")
    damping = SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("length") / max(index.mean_length, 1e-9))
    gain = rarity * times * (SATURATION + 1) / (times + damping)
    found = mine.groupBy("post_id").agg(
        F.count("*").alias("_words"), F.first("score").alias("score"), F.first("created_utc").alias("created_utc"),
        F.round(F.sum(gain), RELEVANCE_DIGITS).alias("relevance"),
    )
    return found.filter(F.col("_words") == len(words)).drop("_words")


def search_indexed(
    index: SearchIndex, posts: DataFrame, subreddit: str, query: str, sort: str | Column = "relevance", limit: int = V.SEARCH_LIMIT
) -> DataFrame:
    """C2 over an index: posts of a subreddit that hold every word of `query`, as a whole word, in title or text.

    `relevance` is BM25, then score; `top`, `new` and `hot` are as in `search_posts`; any other ranking is a Column over score,
    created_utc and relevance, highest first. Ties go by post id. A query without words finds nothing. Ranked are ids alone;
    the posts that won are fetched by id.
    """
    words = query_words(posts.sparkSession, query)
    if isinstance(sort, Column):
        ranking = [sort]
    elif sort == "relevance":
        ranking = [F.col("relevance"), F.col("score")]
    elif sort in ("top", "new", "hot"):
        ranking = [{"top": F.col("score"), "new": F.col("created_utc"), "hot": hot_rank()}[sort]]
    else:
        raise ValueError("sort must be 'relevance', 'top', 'new', 'hot' or a Column")
    names = [f"_by_{i}" for i in range(len(ranking))]
    order = [*[F.desc(name) for name in names], F.asc("post_id")]
    hits = matches(index, subreddit, words) if words else matches(index, subreddit, words).limit(0)
    best = hits.select("post_id", "relevance", *[by.alias(name) for name, by in zip(names, ranking)]).orderBy(*order).limit(limit)
    records = post_record(posts).join(F.broadcast(best) if limit <= _SHIPPED_IDS else best, "post_id")
    return records.orderBy(*order).limit(limit).select(*V.POST_FIELDS, "relevance")
