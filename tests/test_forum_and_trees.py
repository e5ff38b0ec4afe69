"""Top lists, search, look-ups and comment trees against plain Python."""

import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.durable import durable
from prefweave.operators import forum, search, tops, tours, trees

COMMENTS = (
    "comment_id string, post_id string, parent_id string, body string, score int, created_utc double, author string, "
    "subreddit string, permalink string, distinguished string, is_submitter boolean, stickied boolean"
)
POSTS = (
    "post_id string, title string, selftext string, url string, score int, num_comments int, created_utc double, "
    "author string, subreddit string, permalink string, is_self boolean, upvote_ratio double"
)


def post(i, subreddit="s", score=0, at=0.0, title="t", text="x", author="ann"):
    return (f"p{i}", title, text, "u", score, 0, at, author, subreddit, "l", True, 0.5)


def comment(i, post_id, parent, score=0, author="ann"):
    return (f"c{i}", post_id, parent, f"body {i}", score, float(i), author, "s", "l", None, False, False)


def forest(n, seed, chain=0.9):
    """Random trees: some deep chains, one hot post, missing parents, and a circle."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        post_id = "p0" if draw.random() < 0.5 else f"p{draw.randrange(1, 5)}"
        mine = [r for r in rows if r[1] == post_id]
        roll = draw.random()
        if roll < 0.04 or not mine:
            parent = f"t3_{post_id}"
        elif roll < 0.06:
            parent = f"t1_gone{i}"
        else:
            parent = f"t1_{mine[-1][0] if draw.random() < chain else draw.choice(mine)[0]}"
        rows.append(comment(i, post_id, parent, draw.randrange(4)))
    rows += [comment(n, "p1", f"t1_c{n + 1}"), comment(n + 1, "p1", f"t1_c{n}"), comment(n + 2, "p1", f"t1_c{n}")]
    return rows


def walk(rows, start):
    """Breadth-first list of (id, depth) below `start`; siblings by score, highest first, then id."""
    below = defaultdict(list)
    for r in rows:
        below[r[2]].append(r)
    queue = deque((r, 0) for r in sorted(below[start], key=lambda r: (-r[4], r[0])))
    found = []
    while queue:
        r, depth = queue.popleft()
        found.append((r[0], depth))
        queue.extend((c, depth + 1) for c in sorted(below[f"t1_{r[0]}"], key=lambda r: (-r[4], r[0])))
    return found


@pytest.fixture(scope="module")
def grown(spark):
    rows = forest(400, 3)
    return rows, spark.createDataFrame(rows, COMMENTS).repartition(4).cache()


def test_tree_of_any_shape(grown):
    rows, df = grown
    depth = {c: d for p in {r[1] for r in rows} for c, d in walk(rows, f"t3_{p}")}
    got = {r["comment_id"]: r["depth"] for r in trees.comment_tree(df).collect()}
    assert got == {r[0]: depth.get(r[0]) for r in rows}
    assert max(depth.values()) > 20


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_breadth_first_order(grown, hot_rows):
    rows, df = grown
    got = defaultdict(list)
    for r in trees.comment_positions(df, hot_rows).orderBy("post_id", "position").collect():
        got[r["post_id"]].append(r)
    for post_id, listed in got.items():
        assert [r["position"] for r in listed] == list(range(len(listed)))
        wanted = [c for c, _ in walk(rows, f"t3_{post_id}")]
        assert [r["comment_id"] for r in listed if r["depth"] is not None] == wanted
        assert all(r["depth"] is None for r in listed[len(wanted):])


def test_max_depth(grown):
    rows, df = grown
    depth = {c: d for p in {r[1] for r in rows} for c, d in walk(rows, f"t3_{p}")}
    for limit in (0, 1, 3, 4):
        got = {r["comment_id"] for r in trees.comment_tree(df, limit).collect()}
        # Comments with missing ancestors have no depth and keep their row.
        assert got == {r[0] for r in rows if depth.get(r[0], 0) <= limit}


@pytest.mark.parametrize("limit", [1, 4, 50])
def test_replies(spark, grown, limit):
    rows, df = grown
    seeds = ["c0", "c7", "c50", "c120", "unknown"]
    ids = spark.createDataFrame([(s,) for s in seeds], "comment_id string")
    got = defaultdict(list)
    for r in trees.replies(df, ids, limit, hot_rows=20).orderBy("root_id", "rank").collect():
        got[r["root_id"]].append((r["comment_id"], r["depth"]))
    for seed in seeds:
        assert got[seed] == [(c, d + 1) for c, d in walk(rows, f"t1_{seed}")][:limit]


@pytest.mark.parametrize("limit", [3, 50])
def test_replies_without_what_placeholders_hide(spark, grown, limit):
    rows, df = grown
    draw = random.Random(limit)
    hidden = {r[0] for r in rows if draw.random() < 0.1} | {"c7", "nowhere"}
    more = spark.createDataFrame([("t1_x", sorted(hidden)), ("t1_y", ["c7"])], "parent_id string, children array<string>")
    seeds = ["c0", "c7", "c50", "c120", "unknown", *sorted(hidden)[:4]]
    ids = spark.createDataFrame([(s,) for s in seeds + seeds], "comment_id string")
    got = defaultdict(list)
    for r in trees.replies(df, ids, limit, hot_rows=20, more=more).orderBy("root_id", "rank").collect():
        got[r["root_id"]].append((r["comment_id"], r["depth"]))
    shown = [r for r in rows if r[0] not in hidden]
    for seed in seeds:
        assert got[seed] == [(c, d + 1) for c, d in walk(shown, f"t1_{seed}")][:limit]


def test_tour_numbers(grown):
    """Entry and exit of a comment enclose those of all below it and of no others; null for circles."""
    rows, df = grown
    numbers = {r["comment_id"]: r for r in tours.numbered_tree(df, hot_rows=20).collect()}
    assert set(numbers) == {r[0] for r in rows}
    circle = {r[0] for r in rows[-3:]}
    for r in rows:
        mine = numbers[r[0]]
        if r[0] in circle:
            assert (mine["kind"], mine["section"], mine["entry"]) == (tours.CIRCULAR, None, None)
            continue
        below = {c for c, _ in walk(rows, f"t1_{r[0]}")}
        inside = {
            c for c, n in numbers.items()
            if n["section"] == mine["section"] and n["section"] is not None and mine["entry"] < n["entry"] and n["exit"] < mine["exit"]
        }
        assert inside == below and mine["exit"] - mine["entry"] == 2 * len(below) + 1
        assert (mine["kind"] == tours.ORPHANED) == (mine["kind"] != tours.ROOTED)


def test_a_long_chain_takes_linear_space(spark):
    """Fifty thousand comments one below the other: what is written holds a few numbers a comment, no ancestors."""
    n = 50_000
    df = spark.range(n).selectExpr(
        "concat('c', id) AS comment_id", "'p' AS post_id", "if(id = 0, 't3_p', concat('t1_c', id - 1)) AS parent_id",
        "concat('body ', id) AS body", "1 AS score", "CAST(id AS DOUBLE) AS created_utc", "'a' AS author",
    )
    numbered = tours.numbered_tree(df)
    assert not any("array" in f.dataType.simpleString() for f in numbered.schema)
    placed = tours.breadth_first(numbered)
    assert placed.filter(F.concat(F.lit("c"), F.col("position")) != F.col("comment_id")).count() == 0
    assert placed.filter("depth <> position").count() == 0


def test_nested_comments_stay_whole(spark, grown):
    rows, df = grown
    posts = spark.createDataFrame([post(i) for i in range(6)], POSTS)
    nested = trees.with_comments(posts, df, per_row=7).orderBy("post_id", "part").collect()
    listed = defaultdict(list)
    for r in nested:
        assert len(r["comments"]) <= 7
        listed[r["post_id"]] += [c["comment_id"] for c in r["comments"]]
    assert {p: sorted(ids) for p, ids in listed.items()} == {
        f"p{i}": sorted(r[0] for r in rows if r[1] == f"p{i}") for i in range(6)
    }
    assert nested[0]["comments"][0].asDict().keys() == set(V.COMMENT_FIELDS)
    assert [r["part"] for r in nested if r["post_id"] == "p5"] == [0]


def test_partial_mode_hides_what_hangs_below(spark):
    rows = [comment(0, "p", "t3_p"), comment(1, "p", "t1_c0"), comment(2, "p", "t1_c1"), comment(3, "p", "t1_gone")]
    more = spark.createDataFrame([("t1_c0", ["c1", "c9"])], "parent_id string, children array<string>")
    df = spark.createDataFrame(rows, COMMENTS)
    assert {r["comment_id"] for r in trees.loaded_only(df, more).collect()} == {"c0", "c3"}
    loaded = df.filter("comment_id IN ('c0', 'c1', 'c3')")
    full = trees.expand_more(more, df.filter("comment_id <> 'c3'"), loaded)
    assert sorted(r["comment_id"] for r in full.collect()) == ["c0", "c1", "c3"]
    with pytest.raises(ValueError):
        trees.comments_in_order(df, complete=False)


def test_no_comments(spark):
    df = spark.createDataFrame([], COMMENTS)
    assert trees.comment_tree(df).count() == 0
    posts = spark.createDataFrame([post(1)], POSTS)
    assert trees.with_comments(posts, df).first()["comments"] == []


def test_comments_by_id(spark, grown):
    _, df = grown
    posts = spark.createDataFrame([post(i, title=f"title {i}") for i in range(3)], POSTS)
    ids = spark.createDataFrame([("c1",), ("c1",), ("nope",)], "comment_id string")
    got = forum.comments_by_id(df, posts, ids, hot_rows=1).collect()
    assert len(got) == 1 and got[0].asDict().keys() == set(V.COMMENT_BY_ID_FIELDS)
    found = trees.with_replies(forum.comments_by_id(df, posts, ids), trees.replies(df, ids)).first()
    assert len(found["replies"]) <= V.REPLY_LIMIT and found["replies"][0].asDict().keys() == set(V.REPLY_FIELDS)


@pytest.fixture(scope="module")
def board(spark):
    draw = random.Random(5)
    rows = [
        post(i, "big" if i % 3 else f"s{i % 5}", draw.randrange(40), float(draw.randrange(100)) * 86_400,
             draw.choice(["Dragon TALE", "a tale", "other"]), draw.choice(["the dragon", "nothing", "Tale"]),
             draw.choice(["ann", None]))
        for i in range(300)
    ]
    return rows, spark.createDataFrame(rows, POSTS).repartition(6)


@pytest.mark.parametrize("time_filter,days", [("all", 10_000), ("month", 30), ("week", 7), ("day", 1)])
def test_top_posts(board, time_filter, days):
    rows, df = board
    now = 60 * 86_400.0
    recent = [r for r in rows if now - days * 86_400 <= r[6] <= now]
    got = forum.top_posts(df, "big", time_filter, 20, now).collect()
    wanted = sorted(((-r[4], r[0]) for r in recent if r[8] == "big"))[:20]
    assert sorted((-r["score"], r["post_id"]) for r in got) == wanted
    everywhere = defaultdict(list)
    for r in forum.top_posts(df, None, time_filter, 20, now).orderBy("rank").collect():
        everywhere[r["subreddit"]].append((-r["score"], r["post_id"]))
    assert everywhere["big"] == wanted
    assert set(everywhere) == {r[8] for r in recent}
    assert all(r["author"] in ("ann", "None") for r in got)


def test_top_posts_rejects_unknown_ranges(board):
    with pytest.raises(ValueError):
        forum.top_posts(board[1], "big", "decade")


@pytest.mark.parametrize("as_of", [60 * 86_400.0, 60 * 86_400.0 + 5, 61.5 * 86_400, 0.0])
@pytest.mark.parametrize("time_filter", ["all", "month", "week", "day"])
def test_top_posts_from_summaries(board, time_filter, as_of):
    rows, df = board
    summary = tops.daily_tops(df, 20)
    wanted = [r["post_id"] for r in forum.top_posts(df, "big", time_filter, 20, as_of).collect()]
    assert [r["post_id"] for r in tops.top_posts_by_days(summary, df, "big", time_filter, as_of, 20).collect()] == wanted


def test_merged_tops(board, plan):
    rows, df = board
    summary = tops.daily_tops(df, 10)
    for first, last in ((0, 99), (10, 30), (50, 50), (7, 8), (200, 300)):
        got = defaultdict(list)
        merged = tops.merged_tops(summary, first, last, 10)
        for r in merged.orderBy("rank").collect():
            got[r["subreddit"]].append((-r["score"], r["post_id"]))
        days = [r for r in rows if first <= r[6] // 86_400 <= last]
        assert got == {s: sorted((-r[4], r[0]) for r in days if r[8] == s)[:10] for s in {r[8] for r in days}}
    assert "selftext" not in "".join(line for line in plan(merged).splitlines() if "Exchange" in line or "Sort [" in line)
    with pytest.raises(ValueError):
        tops.merged_tops(summary, 3, 2)


def test_search(board):
    rows, df = board
    hits = [r for r in rows if r[8] == "big" and all(w in (r[1] + "\0" + r[2]).lower() for w in ("tale", "dragon"))]
    matches = lambda r: sum(w in field.lower() for w in ("tale", "dragon") for field in (r[1], r[2]))
    orders = {
        "relevance": lambda r: (-matches(r), -r[4], r[0]),
        "top": lambda r: (-r[4], r[0]),
        "new": lambda r: (-r[6], r[0]),
        "hot": lambda r: (-((r[4] > 0) * math.log10(max(r[4], 1)) + r[6] / 45_000), r[0]),
    }
    for sort, key in orders.items():
        got = {r["post_id"] for r in forum.search_posts(df, "big", "dragon Tale", sort, 10).collect()}
        assert got == {r[0] for r in sorted(hits, key=key)[:10]}
    own = forum.search_posts(df, "big", "tale", F.col("score") + F.col("created_utc"), 3)
    assert own.count() == 3
    with pytest.raises(ValueError):
        forum.search_posts(df, "big", "x", "rising")


@pytest.fixture(scope="module")
def index(spark, board, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    search.save_index(board[1], path)
    return search.open_index(spark, path)


def test_indexed_search_finds_what_the_scan_finds(board, index):
    rows, df = board
    for query in ("dragon Tale", "other", "nothing", "tale nothing", "no such"):
        for sort in ("top", "new", "hot"):
            scanned = [r["post_id"] for r in forum.search_posts(df, "big", query, sort, 25).collect()]
            assert [r["post_id"] for r in search.search_indexed(index, df, "big", query, sort, 25).collect()] == scanned
    own = search.search_indexed(index, df, "big", "tale", F.col("score") + F.col("created_utc"), 3)
    assert own.count() == 3
    assert search.search_indexed(index, df, "big", " ").count() == 0
    with pytest.raises(ValueError):
        search.search_indexed(index, df, "big", "x", "rising")


def test_relevance_is_bm25(board, index):
    rows, df = board
    words = {r[0]: (r[1] + " " + r[2]).lower().split() for r in rows}
    mean = sum(map(len, words.values())) / len(words)
    assert (index.posts, index.mean_length) == (300, pytest.approx(mean))

    def bm25(own):
        total = 0
        for term in ("dragon", "tale"):
            df_ = sum(term in w for w in words.values())
            n = own.count(term)
            total += math.log(1 + (300 - df_ + 0.5) / (df_ + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean))
        return round(total, 6)

    hits = sorted((-bm25(words[r[0]]), -r[4], r[0]) for r in rows if r[8] == "big" and {"dragon", "tale"} <= set(words[r[0]]))
    got = search.search_indexed(index, df, "big", "Tale dragon dragon", limit=40).collect()
    assert [(r["post_id"], pytest.approx(r["relevance"])) for r in got] == [(p, -b) for b, _, p in hits[:40]]


def test_postings_are_counted_where_the_posts_lie(spark, plan):
    """Nothing is shuffled for posts that are told apart; rows that are one post are summed as before, null ids included."""
    rows = [("a", "b", "The tale", "the Tale, the end", 1, 1.0), ("c", None, None, "x x", 2, 2.0), ("d", "b", "", "", 3, 3.0)]
    twice = [(None, "b", "x", "y x", 4, None)] * 2 + [("a", "b", "one", "x", 9, 1.0)]
    ddl = "post_id string, subreddit string, title string, selftext string, score int, created_utc double"

    def told(some):
        found = search.postings_of(some).collect()
        return {(r["post_id"], r["score"], r["word"]): (r["in_title"], r["in_text"], r["length"]) for r in found}

    wanted = {
        ("a", 1, "the"): (1, 2, 7), ("a", 1, "tale"): (1, 1, 7), ("a", 1, ","): (0, 1, 7), ("a", 1, "end"): (0, 1, 7),
        ("c", 2, "x"): (0, 2, 2),
    }
    once = spark.createDataFrame(rows, ddl).repartition(2)
    assert told(once) == wanted
    assert "Exchange" not in plan(search.postings_of(durable(once)))
    more = {(None, 4, "x"): (2, 2, 3), (None, 4, "y"): (0, 2, 3), ("a", 9, "one"): (1, 0, 2), ("a", 9, "x"): (0, 1, 2)}
    assert told(spark.createDataFrame(rows + twice, ddl).repartition(3)) == wanted | more


def test_a_search_reads_the_postings_of_its_words(board, index, plan):
    found = plan(search.matches(index, "big", ["dragon", "tale"]))
    assert "PushedFilters: [In(word, [dragon,tale])" in found or "In(word, [dragon,tale])" in found
    assert "selftext" not in found


def test_posts_by_id(spark, board):
    ids = spark.createDataFrame([("p1",), ("p1",), ("none",)], "post_id string")
    got = {r["post_id"]: r["title"] for r in forum.posts_by_id(board[1], ids).collect()}
    assert got.keys() == {"p1", "none"} and got["none"] is None and got["p1"] is not None


def test_top_posts_rank_narrow_rows(board, plan):
    one = plan(forum.top_posts(board[1], "big", limit=5))
    assert "TakeOrderedAndProject" in one
    every = plan(forum.top_posts(board[1], limit=5))
    assert "WindowGroupLimit" in every
    for line in [*one.splitlines(), *every.splitlines()]:
        assert not (("Sort [" in line or "WindowGroupLimit" in line) and "selftext" in line)
