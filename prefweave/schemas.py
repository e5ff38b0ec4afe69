"""Explicit schemas of the tables; nothing is ever inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _BIGINT, _DOUBLE, _BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


POSTS = _table(
    post_id=_TEXT, title=_TEXT, selftext=_TEXT, url=_TEXT, score=_INT, num_comments=_INT, created_utc=_DOUBLE,
    author=_TEXT, subreddit=_TEXT, permalink=_TEXT, is_self=_BOOL, upvote_ratio=_DOUBLE,
)
COMMENTS = _table(
    comment_id=_TEXT, post_id=_TEXT, parent_id=_TEXT, body=_TEXT, score=_INT, created_utc=_DOUBLE, author=_TEXT,
    subreddit=_TEXT, permalink=_TEXT, distinguished=_TEXT, is_submitter=_BOOL, stickied=_BOOL,
)
MORE = _table(parent_id=_TEXT, children=T.ArrayType(_TEXT))
PAIR_IDS = _table(pair_id=_BIGINT, chosen_comment_id=_TEXT, rejected_comment_id=_TEXT)
PAIRS = _table(
    pair_id=_BIGINT, prompt=_TEXT, chosen_story=_TEXT, rejected_story=_TEXT, chosen_comment_id=_TEXT,
    rejected_comment_id=_TEXT, chosen_comment_score=_BIGINT, rejected_comment_score=_BIGINT, chosen_username=_TEXT,
    rejected_username=_TEXT, chosen_timestamp=_DOUBLE, rejected_timestamp=_DOUBLE,
)
TRAIN_PAIRS = _table(pair_id=_BIGINT, prompt=_TEXT, chosen_story=_TEXT, rejected_story=_TEXT)
RATIONALES = _table(row_id=_BIGINT, story_a=_TEXT, story_b=_TEXT, rationale=_TEXT, preferred=_TEXT)


def require_columns(df, names, label: str):
    """B10. Return `df`, or name the columns that `label` lacks. Looks at the schema only; runs no job."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks required columns: {missing}")
    return df
