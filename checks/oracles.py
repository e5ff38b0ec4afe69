"""The same questions as checks/queries.py in SQL, over views named like the driver's tables."""

from __future__ import annotations

import re

from prefweave import fixed_values as V

LLAMA, OTHER = "meta-llama/Llama-3.2-1B-Instruct", "Qwen/Qwen2.5-1.5B"
KINDS = {LLAMA: "llama", OTHER: "other"}
AS_OF = 1705276800


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPACES = text_literal(V.WHITESPACE)
NULL_WORDS = ", ".join(text_literal(word) for word in V.CSV_NULL_WORDS)
TOKENS = r"regexp_extract_all(lower({}), '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}\p{{Z}}\p{{C}}]')"

# Named subqueries; a query gets those it mentions, and those they mention.
VIEWS = {
    "skeleton": """
        SELECT concat('c', doc_id) AS comment_id, concat('p', doc_id // 10) AS post_id,
            CASE WHEN doc_id % 10 < 2 THEN concat('t3_p', doc_id // 10)
                 WHEN above % 13 = 0 THEN concat('t1_gone', above) ELSE concat('t1_c', above) END AS parent_id,
            text AS body, CAST(n_chars % 1000 AS BIGINT) AS score, CAST(doc_id * 60 AS DOUBLE) AS created_utc,
            CASE WHEN doc_id % 17 <> 0 THEN source END AS author,
            CASE WHEN doc_id % 19 = 0 THEN 'moderator' END AS distinguished,
            doc_id % 3 = 0 AS is_submitter, doc_id % 29 = 0 AS stickied
        FROM (SELECT *, (doc_id // 10) * 10 + (doc_id % 10 - 2) // 2 AS above FROM documents) d""",
    "posts": """
        SELECT concat('p', event_id) AS post_id, concat(event_type, ' story ', event_id) AS title, props AS selftext,
            concat('/r/', event_type, '/', event_id) AS url, CAST(round(value * 100) AS BIGINT) AS score,
            CAST(coalesce(n, 0) AS BIGINT) AS num_comments, epoch_us(ts) / 1e6 AS created_utc,
            CAST(user_id AS VARCHAR) AS author, event_type AS subreddit,
            concat('/r/', event_type, '/', event_id) AS permalink, true AS is_self,
            (event_id % 100) / 100.0::DOUBLE AS upvote_ratio
        FROM events
        LEFT JOIN (SELECT post_id, count(*) AS n FROM skeleton GROUP BY post_id) c
            ON c.post_id = concat('p', event_id)""",
    "comments": """
        SELECT s.*, p.subreddit, p.permalink, p.title AS post_title
        FROM skeleton s LEFT JOIN posts p USING (post_id)""",
    "more": "SELECT parent_id, comment_id FROM skeleton WHERE comment_id LIKE '%9'",
    "pair_ids": """
        SELECT doc_id * 2 AS pair_id, concat('c', doc_id) AS chosen_comment_id, concat('c', doc_id + 1) AS rejected_comment_id
        FROM documents WHERE doc_id % 2 = 0
        UNION ALL
        SELECT doc_id * 2 + 1, NULL, concat('c', doc_id + 2) FROM documents WHERE doc_id % 22 = 0
        UNION ALL
        SELECT doc_id * 2 + 1, concat('c', doc_id), concat('gone', doc_id) FROM documents
        WHERE doc_id % 14 = 0 AND doc_id % 22 <> 0""",
    "wanted": """
        SELECT chosen_comment_id AS id FROM pair_ids WHERE chosen_comment_id IS NOT NULL
        UNION SELECT rejected_comment_id FROM pair_ids WHERE rejected_comment_id IS NOT NULL""",
    "stories": """
        SELECT s.comment_id AS id, s.body AS story, s.score, coalesce(s.author, 'None') AS author,
            s.created_utc AS "timestamp", s.post_id, p.title AS prompt
        FROM skeleton s LEFT JOIN posts p USING (post_id)""",
    "records": "SELECT * FROM stories WHERE id IN (SELECT id FROM wanted)",
    "pairs": """
        SELECT i.pair_id, CASE WHEN c.id IS NOT NULL THEN c.prompt ELSE r.prompt END AS prompt,
            c.story AS chosen_story, r.story AS rejected_story, i.chosen_comment_id, i.rejected_comment_id,
            c.score AS chosen_comment_score, r.score AS rejected_comment_score,
            c.author AS chosen_username, r.author AS rejected_username,
            c."timestamp" AS chosen_timestamp, r."timestamp" AS rejected_timestamp
        FROM pair_ids i LEFT JOIN records c ON c.id = i.chosen_comment_id
        LEFT JOIN records r ON r.id = i.rejected_comment_id""",
    "ranked_labels": """
        SELECT doc_id, lang, quality, text,
            row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) - 1 AS rank,
            count(*) FILTER (quality = 0) OVER (PARTITION BY lang) AS available
        FROM labels JOIN documents USING (doc_id)""",
    "train_pairs": """
        SELECT g.doc_id AS pair_id, concat(g.lang, ':', g.doc_id) AS prompt, g.text AS chosen_story,
            b.text AS rejected_story
        FROM ranked_labels g JOIN ranked_labels b
            ON g.quality = 1 AND b.quality = 0 AND g.lang = b.lang AND b.rank = g.rank % nullif(g.available, 0)""",
    "rationales": """
        SELECT row_id, story_a, story_b,
            concat(CASE row_id % 3 WHEN 0 THEN 'Reasoning: ' WHEN 1 THEN 'reasoning: ' ELSE '' END, said) AS rationale,
            CASE WHEN row_id % 5 = 0 THEN concat(' ', label, ' ') ELSE label END AS preferred
        FROM (
            SELECT *, CASE WHEN length(story_a) >= coalesce(length(story_b), 0) THEN 'A' ELSE 'B' END AS label
            FROM (
                SELECT conv_id * 1000 + turn AS row_id, text AS story_a,
                    lead(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS story_b,
                    coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS said
                FROM conversations) turns) labelled""",
    "noisy_rationales": """
        SELECT row_id, story_a, story_b, rationale,
            CASE row_id % 7 WHEN 0 THEN 'C' WHEN 1 THEN NULL WHEN 2 THEN lower(preferred) ELSE preferred END AS preferred
        FROM rationales""",
    "walk": """
        SELECT comment_id, post_id, parent_id LIKE 't3_%' AS rooted, 0 AS level,
            [{'rank': -score, 'id': comment_id}] AS chain
        FROM skeleton
        WHERE parent_id LIKE 't3_%' OR substr(parent_id, 4) NOT IN (SELECT comment_id FROM skeleton)
        UNION ALL
        SELECT s.comment_id, s.post_id, w.rooted, w.level + 1,
            list_append(w.chain, {'rank': -s.score, 'id': s.comment_id})
        FROM walk w JOIN skeleton s ON s.parent_id = concat('t1_', w.comment_id)""",
    "positions": """
        SELECT comment_id, post_id, CASE WHEN rooted THEN CAST(level AS BIGINT) END AS depth,
            row_number() OVER (PARTITION BY post_id ORDER BY NOT rooted, level, chain) - 1 AS "position"
        FROM walk""",
    "below": """
        SELECT comment_id AS root_id, comment_id, CAST(0 AS BIGINT) AS depth,
            CAST([] AS STRUCT(rank BIGINT, id VARCHAR)[]) AS path
        FROM skeleton
        UNION ALL
        SELECT b.root_id, s.comment_id, b.depth + 1, list_append(b.path, {'rank': -s.score, 'id': s.comment_id})
        FROM below b JOIN skeleton s ON s.parent_id = concat('t1_', b.comment_id)""",
    "below_loaded": """
        SELECT comment_id AS root_id, comment_id, CAST(0 AS BIGINT) AS depth,
            CAST([] AS STRUCT(rank BIGINT, id VARCHAR)[]) AS path
        FROM skeleton
        UNION ALL
        SELECT b.root_id, s.comment_id, b.depth + 1, list_append(b.path, {'rank': -s.score, 'id': s.comment_id})
        FROM below_loaded b JOIN skeleton s ON s.parent_id = concat('t1_', b.comment_id)
        WHERE s.comment_id NOT LIKE '%2'""",
    "replies": """
        SELECT root_id, comment_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY depth, path) AS rank
        FROM below WHERE depth > 0""",
    "vocab": f"""
        SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id
        FROM (SELECT token, count(*) AS n
              FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) t GROUP BY token) c""",
    "document_ids": f"""
        SELECT doc_id, coalesce(list(coalesce(id, 1) ORDER BY place) FILTER (place IS NOT NULL), []) AS ids
        FROM (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS place
              FROM (SELECT doc_id, {TOKENS.format('text')}[1:2048] AS words FROM documents) w) t
        LEFT JOIN vocab USING (token) GROUP BY doc_id
        UNION ALL
        SELECT doc_id, [] FROM documents WHERE len({TOKENS.format('text')}) = 0""",
    "chat_ids": f"""
        SELECT row_id, list(coalesce(id, 1) ORDER BY place) AS ids
        FROM (SELECT row_id, unnest(words) AS token, generate_subscripts(words, 1) AS place
              FROM (SELECT row_id, {TOKENS.format('text')}[1:2048] AS words FROM direct_short) w) t
        LEFT JOIN vocab USING (token) GROUP BY row_id""",
    "chat_marks": """
        SELECT row_id, ids, list_max(list_filter(generate_series(1, len(ids)), lambda i: ids[i : i + 4] = marker)) AS place
        FROM chat_ids, (
            SELECT list(coalesce(id, 1) ORDER BY k) AS marker
            FROM (VALUES (1, '#'), (2, '#'), (3, '#'), (4, 'assistant'), (5, ':')) m(k, token)
            LEFT JOIN vocab USING (token)) m""",
    "document_words": f"""
        SELECT doc_id, lang, n_chars, list_concat({TOKENS.format("concat(source, ' ', lang)")}, {TOKENS.format('text')}) AS words
        FROM documents""",
    "post_words": f"""
        SELECT post_id, subreddit, score, list_concat({TOKENS.format('title')}, {TOKENS.format('selftext')}) AS words
        FROM posts""",
    "story_terms": f"""
        SELECT pair_id, side, bucket, count(*) AS n
        FROM (SELECT pair_id, side, CAST(concat('0x', substr(md5(token), 1, 8)) AS BIGINT) % 16384 AS bucket
              FROM (SELECT pair_id, 'c' AS side, unnest({TOKENS.format('chosen_story')}) AS token FROM train_pairs
                    UNION ALL
                    SELECT pair_id, 'r', unnest({TOKENS.format('rejected_story')}) FROM train_pairs) t) b
        GROUP BY ALL""",
    "term_weights": """
        SELECT bucket, ln((any_value(stories) + 1)::DOUBLE / (count(*) + 1)) AS idf
        FROM story_terms, (SELECT 2 * count(*) AS stories FROM train_pairs) s GROUP BY bucket""",
    "story_features": """
        SELECT pair_id, side, bucket, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY pair_id, side)) AS x
        FROM story_terms JOIN term_weights USING (bucket) WHERE idf <> 0""",
    "feature_differences": """
        SELECT * FROM (SELECT pair_id, bucket, sum(CASE side WHEN 'c' THEN x ELSE -x END) AS x
                       FROM story_features GROUP BY pair_id, bucket) d WHERE x <> 0""",
    "steepest": """
        SELECT bucket, sum(x) / 2 / any_value(pairs) AS weight
        FROM feature_differences, (SELECT count(*) AS pairs FROM train_pairs) n GROUP BY bucket""",
    "steepest_scores": """
        SELECT pair_id, side, sum(x * weight) AS score FROM story_features JOIN steepest USING (bucket) GROUP BY ALL""",
    "shuffled_rationales": """
        SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', row_id)), row_id)
            <= ceil((SELECT count(*) FROM rationales) * CAST(0.05 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
        FROM rationales""",
    "pair_positions": """
        SELECT pair_id, epoch,
            row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('42:', epoch, ':', pair_id)), pair_id) - 1
                AS "position"
        FROM pair_ids, (SELECT unnest([0, 1, 2]) AS epoch) e""",
    "drawn": "SELECT * FROM pairs ORDER BY md5(concat('42:', pair_id)), pair_id LIMIT 500",
}


def prompt(template: str, a: str = "story_a", b: str = "story_b") -> str:
    head, rest = template.strip().split("{story_a}")
    middle, tail = rest.split("{story_b}")
    story_a, story_b = f"coalesce({a}, 'None')", f"coalesce({b}, 'None')"
    return f"concat({text_literal(head)}, {story_a}, {text_literal(middle)}, {story_b}, {text_literal(tail)})"


RATIONALE = (
    f"CASE WHEN starts_with(lower(trim(rationale, {SPACES})), 'reasoning:') THEN trim(rationale, {SPACES})"
    f" ELSE concat('Reasoning: ', trim(rationale, {SPACES})) END"
)
LABEL = f"trim(preferred, {SPACES})"
VALID = f"coalesce({LABEL} IN ('A', 'B'), false)"
ANSWER_COT = f"concat({RATIONALE}, chr(10), 'Preferred: ', {LABEL})"
ANSWER_DIRECT = f"concat('Preferred: ', {LABEL})"


# Which template goes with which kind of model, written out here once more.
TEMPLATES = {
    ("llama", True): V.SHORT_PROMPT_WITH_REASONING,
    ("llama", False): V.SHORT_PROMPT_VERDICT_ONLY,
    ("other", True): V.LONG_PROMPT_WITH_REASONING,
    ("other", False): V.LONG_PROMPT_VERDICT_ONLY,
}


def chat_text(model: str, cot: bool) -> str:
    answer = ANSWER_COT if cot else ANSWER_DIRECT
    return f"concat({prompt(TEMPLATES[KINDS[model], cot])}, chr(10), chr(10), '### Assistant:', chr(10), {answer})"


VIEWS["direct_short"] = f"SELECT row_id, {chat_text(LLAMA, cot=False)} AS text FROM rationales WHERE {VALID}"


def side_ids(side: str, table: str) -> str:
    """Ids of one story of each row of `table`, null for a null story."""
    words = TOKENS.format(f"{side}_story")
    return f"""
        SELECT pair_id, CASE WHEN {side}_story IS NOT NULL THEN coalesce(ids, []) END AS ids
        FROM {table} LEFT JOIN (
            SELECT pair_id, list(coalesce(id, 1) ORDER BY place) AS ids
            FROM (SELECT pair_id, unnest(words) AS token, generate_subscripts(words, 1) AS place
                  FROM (SELECT pair_id, {words}[1:2048] AS words FROM {table}) w) t
            LEFT JOIN vocab USING (token) GROUP BY pair_id) e USING (pair_id)"""


for _table in ("pairs", "train_pairs", "drawn"):
    for _side in ("chosen", "rejected"):
        VIEWS[f"{_table}_{_side}_ids"] = side_ids(_side, _table)


def joined_md5(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def padded(ids: str, n: str, pad: int) -> str:
    """`ids` followed by padding up to `n`; null stays null."""
    return f"list_concat({ids}, list_transform(generate_series(1, {n} - len({ids})), lambda x: {pad}))"


def mask(ids: str, n: str) -> str:
    return f"list_transform(generate_series(1, {n}), lambda i: CASE WHEN i <= len({ids}) THEN 1 ELSE 0 END)"


def array_columns(ids: str, name: str) -> str:
    return f"CAST(len({ids}) AS BIGINT) AS {name}_size, {joined_md5(ids)} AS {name}_md5"


def token_arrays(table: str, extra: str = "") -> str:
    def four(side: str) -> str:
        ids = f"{side}.ids"
        return (
            f"CASE WHEN {ids} IS NOT NULL THEN {joined_md5(padded(ids, '2048', 0))} END AS input_ids_{side}, "
            f"CASE WHEN {ids} IS NOT NULL THEN {joined_md5(mask(ids, '2048'))} END AS attention_mask_{side}"
        )

    return (
        f"SELECT pair_id, {four('chosen')}, {four('rejected')}{extra} "
        f"FROM {table}_chosen_ids chosen JOIN {table}_rejected_ids rejected USING (pair_id)"
    )


def read_back(column: str) -> str:
    return f"CASE WHEN {column} NOT IN ({NULL_WORDS}) THEN {column} END AS {column}"


POST = ", ".join(V.POST_FIELDS)
FOUND = (
    "subreddit = 'view' AND (contains(lower(title), 'story') OR contains(lower(selftext), 'story'))"
    " AND (contains(lower(title), '4') OR contains(lower(selftext), '4'))"
)
MATCHES = " + ".join(
    f"CAST(contains(lower({field}), '{term}') AS INT)" for field in ("title", "selftext") for term in ("story", "4")
)


def search(order: str) -> str:
    return f"SELECT post_id, title, selftext, score FROM posts WHERE {FOUND} ORDER BY {order}, post_id LIMIT 100"


def nested(comments: str, per_row: int = 10_000) -> str:
    """Posts with the comments of `comments` (skeleton columns and position) in rows of `per_row`."""
    return f"""
        SELECT p.post_id, coalesce(part, 0) AS part, coalesce(n, 0) AS n, coalesce(ids, '') AS ids,
            coalesce(bodies_md5, md5('')) AS bodies_md5
        FROM posts p LEFT JOIN (
            SELECT post_id, "position" // {per_row} AS part, count(*) AS n,
                string_agg(comment_id, ',' ORDER BY "position") AS ids,
                md5(string_agg(concat(body, '|', coalesce(author, 'None'), '|', parent_id), ',' ORDER BY "position"))
                    AS bodies_md5
            FROM ({comments}) c GROUP BY ALL) n USING (post_id)"""


def drawn(step: int, value: str, below: str) -> str:
    """What a round of a permutation adds: a number below `below` by (seed, epoch, step) and the other digit."""
    return f"CAST(concat('0x', substr(md5(concat('42:', epoch, ':{step}:', {value})), 1, 12)) AS BIGINT) % {below}"


def permuted_once(source: str) -> str:
    """`source` (id columns, v, high, low) with v sent through six rounds, one after the other."""
    sql = f"SELECT * EXCLUDE (v), v // low AS a, v % low AS b FROM ({source})"
    for step in range(6):
        a, b = ("(a + " + drawn(step, "b", "high") + ") % high", "b") if step % 2 == 0 else ("a", "(b + " + drawn(step, "a", "low") + ") % low")
        sql = f"SELECT * EXCLUDE (a, b), {a} AS a, {b} AS b FROM ({sql})"
    return f"SELECT * EXCLUDE (a, b), a * low + b AS v FROM ({sql})"


VIEWS["numbered_pairs"] = """
    SELECT pair_id, epoch, n, low, CAST(ceil(n / low::DOUBLE) AS BIGINT) AS high,
        row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('42:', pair_id)), pair_id) - 1 AS v
    FROM pair_ids, (SELECT unnest([0, 1, 2]) AS epoch) e,
        (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS low FROM (SELECT count(*) AS n FROM pair_ids) c) s"""
VIEWS["permuted"] = f"""
    SELECT pair_id, epoch, n, low, high, v FROM ({permuted_once("SELECT * FROM numbered_pairs")}) f
    UNION ALL
    SELECT pair_id, epoch, n, low, high, v FROM ({permuted_once("SELECT * FROM permuted WHERE v >= n")}) g"""


def chats(cot: bool) -> str:
    return (
        f"SELECT row_id, split_name AS split, {chat_text(OTHER, cot)} AS text, '### Assistant:' AS response_marker "
        f"FROM (SELECT *, CASE split WHEN 'test' THEN 'val' ELSE split END AS split_name FROM shuffled_rationales) s "
        f"WHERE {VALID}"
    )


ORACLES = {
    "a1_scan_pair_ids": "SELECT * FROM pair_ids",
    "a1_with_row_id": """
        SELECT concat(md5(concat_ws(':', length(a), length(b), a, b)), '-',
                row_number() OVER (PARTITION BY a, b) - 1) AS pair_id, chosen_comment_id, rejected_comment_id
        FROM (SELECT *, coalesce(concat('=', nullif(chosen_comment_id, '')), '-') AS a0,
                CASE WHEN chosen_comment_id IS NULL THEN '-' ELSE concat('=', chosen_comment_id) END AS a,
                CASE WHEN rejected_comment_id IS NULL THEN '-' ELSE concat('=', rejected_comment_id) END AS b
              FROM pair_ids) p""",
    "a2_scan_train_pairs": "SELECT * FROM train_pairs",
    "a3_scan_rationales": "SELECT * FROM rationales",
    "a4_read_pairs_csv": "SELECT pair_id, chosen_comment_score, rejected_comment_score, chosen_timestamp, "
    "rejected_timestamp, "
    + ", ".join(
        read_back(c)
        for c in (
            "prompt", "chosen_story", "rejected_story", "chosen_comment_id", "rejected_comment_id",
            "chosen_username", "rejected_username",
        )
    )
    + " FROM pairs",
    "a5_write_posts_csv": f"SELECT {POST} FROM posts",
    "a6_write_pairs": "SELECT * FROM pairs",
    "a7_cached": "SELECT pair_id, prompt FROM train_pairs",
    "a8_scan_posts": f"SELECT {POST} FROM posts",
    "a8_scan_comments": """
        SELECT comment_id, post_id, parent_id, body, score, created_utc, author, subreddit, permalink, distinguished,
            is_submitter, stickied FROM comments""",
    "b1_post_record": f"SELECT {POST} FROM posts",
    "b2_comment_record": """
        SELECT comment_id, body, score, created_utc, coalesce(author, 'None') AS author,
            starts_with(parent_id, 't3_') AS is_top_level, parent_id FROM skeleton""",
    "b3_reply_record": """
        SELECT comment_id, body, score, created_utc, coalesce(author, 'None') AS author, parent_id, depth
        FROM skeleton JOIN positions USING (comment_id)""",
    "b4_author_text": "SELECT comment_id, coalesce(author, 'None') AS author FROM skeleton",
    "b5_is_top_level": "SELECT comment_id, starts_with(parent_id, 't3_') AS is_top_level FROM skeleton",
    "b6_real_comments": "SELECT 'comment' AS kind, comment_id, parent_id, body FROM skeleton",
    "b7_valid_ids": "SELECT pair_id, chosen_comment_id FROM pair_ids WHERE chosen_comment_id IS NOT NULL",
    "b8_story_record": "SELECT * FROM stories",
    "b9_keep_only": "SELECT row_id, preferred FROM rationales",
    "b10_require_columns": "SELECT pair_id, prompt FROM train_pairs",
    "b11_is_complete": """
        SELECT pair_id, chosen_story IS NOT NULL AND rejected_story IS NOT NULL AS complete FROM pairs""",
    "c1_top_posts": f"""
        SELECT {POST} FROM posts WHERE subreddit = 'click' AND created_utc BETWEEN {AS_OF} - 7 * 86400 AND {AS_OF}
        ORDER BY score DESC, post_id LIMIT 1000""",
    "c1_top_posts_by_days": f"""
        SELECT {POST} FROM posts
        WHERE subreddit = 'click' AND created_utc BETWEEN {AS_OF} + 30000 - 7 * 86400 AND {AS_OF} + 30000
        ORDER BY score DESC, post_id LIMIT 1000""",
    "c1_merged_tops": f"""
        SELECT subreddit, post_id, score, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, post_id) AS rank
        FROM posts WHERE created_utc >= {AS_OF} - 30 * 86400 AND created_utc < {AS_OF} QUALIFY rank <= 100""",
    "c1_top_posts_everywhere": f"""
        SELECT subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, post_id) AS rank, post_id, score
        FROM posts WHERE created_utc BETWEEN {AS_OF} - 30 * 86400 AND {AS_OF} QUALIFY rank <= 100""",
    "c2_search_relevance": search(f"{MATCHES} DESC, score DESC"),
    "c2_search_hot": search(
        "sign(score) * log10(greatest(abs(score), 1)::DOUBLE) + created_utc / 45000 DESC"
    ),
    "c2_search_top": search("score DESC"),
    "c2_search_new": search("created_utc DESC"),
    "c2_search_own_ranking": search("score * upvote_ratio DESC"),
    "c2_indexed_relevance": """
        SELECT concat('p', doc_id) AS post_id, CAST(n_chars % 1000 AS BIGINT) AS score,
            round(sum(ln(1 + (posts - df + 0.5) / (df + 0.5)) * n * 2.2
                / (n + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * len(words) / mean_length))), 6) AS relevance
        FROM (SELECT *, count(*) OVER (PARTITION BY word) AS df
              FROM (SELECT *, CAST(len(list_filter(words, lambda w: w = word)) AS DOUBLE) AS n
                    FROM document_words, (VALUES ('the'), (','), ('of'), ('was')) q(word)) c
              WHERE n > 0) f,
            (SELECT count(*) AS posts, avg(len(words))::DOUBLE AS mean_length FROM document_words) s
        WHERE lang = 'en' GROUP BY doc_id, n_chars HAVING count(*) = 4
        ORDER BY relevance DESC, score DESC, post_id LIMIT 100""",
    "c2_indexed_top": """
        SELECT post_id, score,
            round(sum(ln(1 + (posts - df + 0.5) / (df + 0.5)) * n * 2.2
                / (n + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * len(words) / mean_length))), 6) AS relevance
        FROM (SELECT *, count(*) OVER (PARTITION BY word) AS df
              FROM (SELECT *, CAST(len(list_filter(words, lambda w: w = word)) AS DOUBLE) AS n
                    FROM post_words, (VALUES ('story'), ('9')) q(word)) c
              WHERE n > 0) f,
            (SELECT count(*) AS posts, avg(len(words))::DOUBLE AS mean_length FROM post_words) s
        WHERE subreddit = 'view' GROUP BY post_id, score HAVING count(*) = 2
        ORDER BY score DESC, post_id LIMIT 100""",
    "c2_postings": f"""
        SELECT concat('p', doc_id) AS post_id, len(list_distinct(words))::BIGINT AS words,
            len({TOKENS.format("concat(source, ' ', lang)")})::BIGINT AS in_title, len({TOKENS.format('text')})::BIGINT AS in_text,
            len(words)::BIGINT AS length
        FROM document_words JOIN (SELECT doc_id, source, text FROM documents) d USING (doc_id) WHERE len(words) > 0""",
    "c3_posts_by_id": f"""
        SELECT i.post_id, {", ".join(f for f in V.POST_FIELDS if f != "post_id")}
        FROM (SELECT post_id FROM skeleton UNION SELECT concat('x', post_id) FROM skeleton) i
        LEFT JOIN posts p USING (post_id)""",
    "c3_posts_with_comments": """
        SELECT i.post_id, title, author, CASE WHEN p.post_id IS NOT NULL THEN coalesce(ids, '') END AS ids
        FROM (SELECT post_id FROM skeleton UNION SELECT concat('x', post_id) FROM skeleton) i
        LEFT JOIN posts p USING (post_id)
        LEFT JOIN (SELECT post_id, string_agg(comment_id, ',' ORDER BY "position") AS ids FROM positions
                   GROUP BY post_id) c USING (post_id)""",
    "c4_comments_in_order": """
        SELECT comment_id, body, score, coalesce(author, 'None') AS author, starts_with(parent_id, 't3_') AS is_top_level,
            parent_id, post_id, "position" FROM skeleton JOIN positions USING (comment_id, post_id)""",
    "c4_with_comments": nested("SELECT * FROM skeleton JOIN positions USING (comment_id, post_id)"),
    "c4_with_comments_in_parts": nested("SELECT * FROM skeleton JOIN positions USING (comment_id, post_id)", 4),
    "c5_partial_comments": nested("""
        SELECT s.*, row_number() OVER (PARTITION BY post_id ORDER BY NOT rooted, level, chain) - 1 AS "position"
        FROM walk JOIN skeleton s USING (comment_id, post_id)
        WHERE len(list_filter(chain, lambda c: c.id LIKE '%9')) = 0"""),
    "c6_expand_more": "SELECT comment_id, parent_id, body FROM skeleton",
    "c7_comment_tree": """
        SELECT comment_id, post_id, CASE WHEN rooted THEN CAST(level AS BIGINT) END AS depth,
            array_to_string(list_transform(chain, lambda c: c.id), '/') AS path FROM walk""",
    "c7_max_depth": """
        SELECT comment_id, post_id, CASE WHEN rooted THEN CAST(level AS BIGINT) END AS depth FROM walk
        WHERE NOT rooted OR level <= 1""",
    "c7_breadth_first": 'SELECT comment_id, post_id, depth, "position" FROM positions',
    "c8_comments_by_id": """
        SELECT comment_id, body, score, created_utc, coalesce(author, 'None') AS author, subreddit, permalink,
            starts_with(parent_id, 't3_') AS is_top_level, parent_id, post_id, post_title, distinguished, is_submitter,
            stickied
        FROM comments WHERE comment_id IN (SELECT id FROM wanted)""",
    "c9_replies": """
        SELECT root_id, rank, comment_id, body, score, created_utc, coalesce(author, 'None') AS author, parent_id, depth
        FROM replies JOIN skeleton USING (comment_id) WHERE rank <= 50""",
    "c9_replies_limited": "SELECT root_id, rank, comment_id, depth FROM replies WHERE rank <= 3",
    "c9_replies_of_loaded": """
        SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY depth, path) AS rank, comment_id, depth
        FROM below_loaded WHERE depth > 0 QUALIFY rank <= 4""",
    "c7_tour_numbers": """
        SELECT w.comment_id, w.post_id, CAST(w.level AS BIGINT) AS level, n - 1 AS below, w.rooted
        FROM walk w JOIN (SELECT root_id, count(*) AS n FROM below GROUP BY root_id) b ON b.root_id = w.comment_id""",
    "c9_comments_with_replies": """
        SELECT comment_id, post_title, coalesce(listed, '') AS replies
        FROM comments LEFT JOIN (
            SELECT root_id, string_agg(comment_id, ',' ORDER BY rank) AS listed FROM replies WHERE rank <= 50
            GROUP BY root_id) r ON root_id = comment_id""",
    "d1_side_ids": "SELECT DISTINCT chosen_comment_id AS id FROM pair_ids WHERE chosen_comment_id IS NOT NULL",
    "d2_all_ids": "SELECT id FROM wanted",
    "d3_fetch_records": "SELECT * FROM records",
    "d4_pending_ids": "SELECT id FROM wanted WHERE id NOT IN (SELECT comment_id FROM skeleton)",
    "d5_first_record": """
        SELECT comment_id AS id, body AS story, score + attempt AS score
        FROM skeleton, (SELECT unnest([0, 1, 2]) AS attempt) a
        WHERE (CAST(substr(comment_id, 2) AS BIGINT) + attempt) % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY attempt) = 1""",
    "d6_assemble_pairs": "SELECT * FROM pairs",
    "d7_prompt_choice": """
        SELECT i.pair_id, CASE WHEN c.id IS NOT NULL
            THEN CASE WHEN CAST(substr(c.post_id, 2) AS BIGINT) % 5 <> 0 THEN c.prompt END
            ELSE CASE WHEN CAST(substr(r.post_id, 2) AS BIGINT) % 5 <> 0 THEN r.prompt END END AS prompt
        FROM pair_ids i LEFT JOIN records c ON c.id = i.chosen_comment_id
        LEFT JOIN records r ON r.id = i.rejected_comment_id""",
    "rehydration_completeness": """
        SELECT count(*) AS total_rows, count(chosen_story || rejected_story) AS complete_rows,
            count(chosen_story || rejected_story)::DOUBLE / count(*)::DOUBLE * 100 AS completeness_rate FROM pairs""",
    "e1_completeness": """
        SELECT count(*) AS total_rows, count(chosen_story || rejected_story) AS complete_rows,
            round(count(chosen_story || rejected_story)::DOUBLE / count(*)::DOUBLE * 100, 6) AS completeness_rate
        FROM pairs""",
    "e2_coverage": """
        SELECT count(*) FILTER (id IN (SELECT comment_id FROM skeleton)) AS fetched, count(*) AS wanted FROM wanted""",
    "e3_split_sizes": """
        SELECT split, count(*) AS "rows" FROM shuffled_rationales GROUP BY split
        UNION ALL SELECT 'val', least(3, count(*)) FROM shuffled_rationales WHERE split = 'test'""",
    "e4_validation_sample": "SELECT * FROM pair_ids ORDER BY md5(concat('42:', pair_id)), pair_id LIMIT 500",
    "e5_exact_split": "SELECT split, row_id, story_a FROM shuffled_rationales",
    "h1_stable_position": """
        SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS "position"
        FROM documents""",
    "g1_template_for": f"""
        SELECT row_id, model, cot, md5(
            CASE WHEN contains(lower(model), 'llama') AND cot THEN {prompt(TEMPLATES["llama", True])}
                 WHEN contains(lower(model), 'llama') THEN {prompt(TEMPLATES["llama", False])}
                 WHEN cot THEN {prompt(TEMPLATES["other", True])} ELSE {prompt(TEMPLATES["other", False])} END) AS prompt_md5
        FROM rationales, (VALUES ('{LLAMA}'), ('{OTHER}')) m(model), (VALUES (true), (false)) c(cot)""",
    "g2_user_prompt": f"SELECT row_id, {prompt(TEMPLATES["other", True])} AS prompt FROM rationales",
    "g3_rationale_text": f"SELECT row_id, {RATIONALE} AS rationale FROM rationales",
    "g4_label_text": f"SELECT row_id, CASE WHEN {VALID} THEN {LABEL} END AS label FROM noisy_rationales",
    "g4_bad_rows": f"SELECT row_id, preferred FROM noisy_rationales WHERE NOT {VALID}",
    "g5_answer_cot": f"SELECT row_id, {ANSWER_COT} AS answer FROM rationales",
    "g6_answer_direct": f"SELECT row_id, {ANSWER_DIRECT} AS answer FROM rationales",
    "g7_chat_examples": f"""
        SELECT row_id, {chat_text(LLAMA, cot=True)} AS text, '### Assistant:' AS response_marker
        FROM noisy_rationales WHERE {VALID}""",
    "g8_sft_splits_cot": chats(cot=True),
    "g8_sft_splits_direct": chats(cot=False),
    "t1_encode": f"""SELECT doc_id, {array_columns('ids', 'ids')}, CAST(0 AS BIGINT) AS unknown FROM document_ids""",
    "t1_encode_by_join": f"SELECT doc_id, {array_columns('ids', 'ids')} FROM document_ids",
    "t2_build_vocab": """
        SELECT * FROM vocab UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('<|endoftext|>', 2)) s""",
    "t3_pad_policies": f"""
        SELECT doc_id, {joined_md5(padded('ids', '2048', 2))} AS end_of_text_md5,
            {joined_md5(padded('ids', '2048', 0))} AS added_md5 FROM document_ids""",
    "t4_pad": f"""
        SELECT doc_id, {array_columns(padded('ids', '2048', 0), 'right')},
            {array_columns("list_concat(list_transform(generate_series(1, 2048 - len(ids)), lambda x: 0), ids)", 'left')}
        FROM document_ids""",
    "t5_attention_mask": f"SELECT doc_id, {array_columns(mask('ids', '2048'), 'mask')} FROM document_ids",
    "t6_tokenize_pairs": token_arrays("pairs"),
    "t7_prepare_pairs": " UNION ALL ".join(
        token_arrays(table, f", '{split}' AS split")
        for table, split in (("train_pairs", "train"), ("drawn", "val"), ("pairs", "test"))
    ),
    "t7_two_vocabularies": f"""
        SELECT v.name AS vocabulary, t.pair_id, {joined_md5(padded('v_ids', '2048', 0))} AS input_ids_chosen
        FROM (SELECT pair_id, ids FROM train_pairs_chosen_ids) t,
            (VALUES ('full', CAST(2147483647 AS BIGINT)), ('small', 10)) v(name, most),
            LATERAL (SELECT list_transform(t.ids, lambda x: CASE WHEN x < v.most THEN x ELSE 1 END) AS v_ids) l""",
    "t7_prepared_sizes": """
        SELECT 'train' AS split, count(*) AS "rows" FROM train_pairs
        UNION ALL SELECT 'validation', least(500, count(*)) FROM pair_ids
        UNION ALL SELECT 'test', count(*) FROM pair_ids""",
    "t8_find_marker": "SELECT row_id, CAST(place AS BIGINT) AS place FROM chat_marks",
    "t9_answer_labels": f"""
        SELECT row_id, {array_columns("list_transform(ids, lambda x, i: CASE WHEN i > coalesce(place + 4, len(ids)) "
        "THEN x ELSE -100 END)", "labels")} FROM chat_marks""",
    "t10_truncation_report": f"""
        SELECT count(*) AS total_rows, count(*) FILTER (text IS NULL) AS rows_without_text,
            count(*) FILTER (len(words) > 512) AS rows_cut,
            count(*) FILTER (len(list_filter(generate_series(1, least(len(words), 508)),
                lambda i: words[i : i + 4] = ['#', '#', '#', 'assistant', ':'])) = 0) AS rows_without_marker
        FROM (SELECT text, {TOKENS.format('text')} AS words
              FROM (SELECT {chat_text(LLAMA, cot=True)} AS text FROM rationales WHERE {VALID}) c) w""",
    "f1_assign_batches": """
        SELECT pair_id, CAST(epoch AS BIGINT) AS epoch, "position", "position" // 8 AS batch FROM pair_positions""",
    "f1_permuted_batches": """
        SELECT pair_id, CAST(epoch AS BIGINT) AS epoch, v AS "position", v // 8 AS batch FROM permuted WHERE v < n""",
    "f2_drop_last": """
        SELECT pair_id, CAST(epoch AS BIGINT) AS epoch, "position", "position" // 7 AS batch FROM pair_positions
        WHERE epoch < 2 QUALIFY count(*) OVER (PARTITION BY epoch, "position" // 7) = 7""",
    "f3_training_plan": """
        SELECT 'pairwise' AS trainer, count(*) AS total_rows, CAST(8 AS BIGINT) AS rows_per_step,
            CAST(16 AS BIGINT) AS accumulation, CAST(128 AS BIGINT) AS effective_batch,
            CAST(ceil(count(*) / 128.0) AS BIGINT) AS steps_per_epoch FROM pair_ids
        UNION ALL SELECT 'generative', count(*), 6, 22, 132, CAST(ceil(count(*) / 132.0) AS BIGINT) FROM rationales""",
    "f4_pad_to_batch": f"""
        SELECT CAST(0 AS BIGINT) AS epoch, batch, doc_id, {array_columns(padded('ids', 'longest', 0), 'ids')},
            {array_columns(mask('ids', 'longest'), 'mask')}
        FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest
              FROM (SELECT doc_id, ids,
                        (row_number() OVER (ORDER BY md5(concat('42:0:', doc_id)), doc_id) - 1) // 8 AS batch
                    FROM document_ids) b) l""",
    "f5_step_of": """
        SELECT CAST(epoch AS BIGINT) AS epoch, pair_id, "position" // 8 // 16 AS step FROM pair_positions
        WHERE epoch = 0""",
    "generative_batches": f"""
        SELECT CAST(epoch AS BIGINT) AS epoch, batch, row_id, {array_columns(padded('ids', 'longest', 0), 'ids')},
            {array_columns(padded('labels', 'longest', -100), 'labels')},
            {array_columns(mask('ids', 'longest'), 'attention_mask')}
        FROM (SELECT *, max(len(ids)) OVER (PARTITION BY epoch, batch) AS longest
              FROM (SELECT row_id, epoch, ids,
                        list_transform(ids, lambda x, i: CASE WHEN i > coalesce(place + 4, len(ids)) THEN x ELSE -100 END)
                            AS labels,
                        (row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('42:', epoch, ':', row_id)), row_id)
                            - 1) // 4 AS batch
                    FROM chat_marks JOIN shuffled_rationales s USING (row_id), (SELECT unnest([0, 1]) AS epoch) e
                    WHERE s.split = 'train') b
              QUALIFY count(*) OVER (PARTITION BY epoch, batch) = 4) l""",
    "r1_features": """
        SELECT t.pair_id, coalesce(non_zero, 0) AS non_zero, coalesce(weight, 0) AS weight,
            coalesce(differing, 0) AS differing, coalesce(difference, 0) AS difference
        FROM train_pairs t
        LEFT JOIN (SELECT pair_id, count(*) AS non_zero, round(sum(abs(x)), 4) AS weight FROM story_features
                   WHERE side = 'c' GROUP BY pair_id) f USING (pair_id)
        LEFT JOIN (SELECT pair_id, count(*) AS differing, round(sum(abs(x)), 4) AS difference FROM feature_differences
                   GROUP BY pair_id) d USING (pair_id)""",
    "r2_certificate": """
        SELECT n - k AS train_pairs, k AS validation_pairs, true AS better_than_chance, true AS optimal
        FROM (SELECT count(*) AS n, CAST(ceil(count(*) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS k FROM train_pairs) c""",
    "r3_score": """
        SELECT t.pair_id, round(coalesce(c.score, 0), 6) AS chosen_score, round(coalesce(r.score, 0), 6) AS rejected_score
        FROM train_pairs t
        LEFT JOIN (SELECT * FROM steepest_scores WHERE side = 'c') c USING (pair_id)
        LEFT JOIN (SELECT * FROM steepest_scores WHERE side = 'r') r USING (pair_id)""",
    "r4_pair_metrics": """
        SELECT count(*) AS pairs, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
            round(avg(ln(1 + exp(-m))), 6) AS mean_loss
        FROM (SELECT (length(chosen_story) - length(rejected_story)) / 1000::DOUBLE AS m FROM train_pairs) t""",
}


# Encoding gives the same ids whatever part of the vocabulary is shipped.
for _name, _same in (
    ("t1_encode_beyond_shipped", "t1_encode_by_join"),
    ("t6_tokenize_beyond_shipped", "t6_tokenize_pairs"),
    ("t7_prepare_beyond_shipped", "t7_prepare_pairs"),
):
    ORACLES[_name] = ORACLES[_same]


def _needs(sql: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            if not (name in ("walk", "below", "below_loaded", "permuted") and sql is VIEWS[name]):
                seen[:] = _needs(VIEWS[name], [*seen, "." + name]) if "." + name not in seen else seen
                if name not in seen:
                    seen.append(name)
    return seen


def full_sql(name: str) -> str:
    """The query with the named subqueries it needs in front, each after those it needs itself."""
    views = [v for v in _needs(ORACLES[name], []) if not v.startswith(".")]
    if not views:
        return ORACLES[name]
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " + ORACLES[name]
