"""One query per operator: (spark, sf_dir) -> DataFrame, over whole tables.

Arrays leave as their length and the md5 of their joined ids; ranks, counts and lengths as bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as S
from prefweave import fixed_values as V
from prefweave import schemas
from prefweave.durable import durable, scratch_path
from prefweave.functions import arrays, text
from prefweave.operators import batches, chat, forum, rehydrate, reward, sampling, search, tokens, tours, trees
from prefweave.operators import tops as tops_
from prefweave.operators.dictionary import WordDictionary
from prefweave.plans.rehydration import rehydrate as rehydrate_pairs
from prefweave.plans.rehydration import rehydration_report
from prefweave.plans.training_data import chat_batches, prepare_pairs
from prefweave.sources import csv_edge, sinks, tables

LLAMA, OTHER = "meta-llama/Llama-3.2-1B-Instruct", "Qwen/Qwen2.5-1.5B"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Bytes of a vocabulary that the queries over a dictionary too large to ship let it ship: 5,461 words.
SMALL_DICTIONARY = 1 << 16


def query(function):
    QUERIES[function.__name__] = function
    return function


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def fingerprint(ids: Column) -> Column:
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


def array_columns(ids: Column, name: str) -> list[Column]:
    return [F.size(ids).cast("bigint").alias(f"{name}_size"), fingerprint(ids).alias(f"{name}_md5")]


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    comments = S.skeleton(spark, sf)
    return rehydrate_pairs(S.pair_ids(spark, sf), comments, S.posts(spark, sf, counted=False))


def records(spark: SparkSession, sf: str) -> DataFrame:
    ids = rehydrate.all_ids(S.pair_ids(spark, sf))
    return rehydrate.fetch_records(ids, S.skeleton(spark, sf), S.posts(spark, sf, counted=False))


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Small and used more than once, so it is written down."""
    return durable(tokens.build_vocab(S.documents(spark, sf), "text"))


def stored(spark: SparkSession, df: DataFrame, name: str, format: str = "parquet") -> str:
    suffix = ".json" if format == "json" else ""
    path = scratch_path(spark, name) + suffix
    df.write.format(format).save(path)
    return path


# --- sources and sinks


@query
def a1_scan_pair_ids(spark, sf):
    return tables.scan_pair_ids(spark, stored(spark, S.pair_ids(spark, sf), "pair_ids"))


@query
def a1_with_row_id(spark, sf):
    ids = S.pair_ids(spark, sf).drop("pair_id")
    return tables.with_row_id(ids, ["chosen_comment_id", "rejected_comment_id"])


@query
def a2_scan_train_pairs(spark, sf):
    return tables.scan_train_pairs(spark, stored(spark, S.train_pairs(spark, sf), "train_pairs"))


@query
def a3_scan_rationales(spark, sf):
    return tables.scan_rationales(spark, stored(spark, S.rationales(spark, sf), "rationales"))


@query
def a4_read_pairs_csv(spark, sf):
    path = scratch_path(spark, "pairs-csv")
    sinks.write_pairs(pairs(spark, sf), path, format="csv")
    return csv_edge.read_pairs_csv(spark, path)


@query
def a5_write_posts_csv(spark, sf):
    path = scratch_path(spark, "posts-csv")
    csv_edge.write_posts_csv(forum.post_record(S.posts(spark, sf)), path)
    return longs(
        spark.read.schema(schemas.POSTS).csv(path, header=True, quote='"', escape='"'), "score", "num_comments"
    )


@query
def a6_write_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    sinks.write_pairs(pairs(spark, sf), path)
    return spark.read.schema(schemas.PAIRS).parquet(path)


@query
def a7_cached(spark, sf):
    base = scratch_path(spark, "cache")
    key = sinks.cache_key(OTHER, V.MAX_LENGTH, "train", source=sf, seed=V.SPLIT_SEED)
    sinks.cached(spark, base, key, lambda: S.train_pairs(spark, sf))

    def rebuilt():
        raise AssertionError("a finished copy must not be built again")

    return sinks.cached(spark, base, key, rebuilt).select("pair_id", "prompt")


@query
def a8_scan_posts(spark, sf):
    return longs(
        tables.scan_posts(spark, stored(spark, S.posts(spark, sf), "posts", "json")), "score", "num_comments"
    )


@query
def a8_scan_comments(spark, sf):
    path = stored(spark, S.comments(spark, sf), "comments", "json")
    return longs(tables.scan_comments(spark, path), "score")


# --- projections and predicates


@query
def b1_post_record(spark, sf):
    return longs(forum.post_record(S.posts(spark, sf)), "score", "num_comments")


@query
def b2_comment_record(spark, sf):
    return longs(forum.comment_record(S.skeleton(spark, sf)), "score")


@query
def b3_reply_record(spark, sf):
    tree = trees.comment_tree(S.skeleton(spark, sf)).select("comment_id", "depth")
    return longs(forum.reply_record(S.skeleton(spark, sf).join(tree, "comment_id")), "score", "depth")


@query
def b4_author_text(spark, sf):
    return S.skeleton(spark, sf).select("comment_id", text.author_text(F.col("author")).alias("author"))


@query
def b5_is_top_level(spark, sf):
    return S.skeleton(spark, sf).select("comment_id", text.is_top_level(F.col("parent_id")).alias("is_top_level"))


@query
def b6_real_comments(spark, sf):
    return forum.real_comments(S.listing(spark, sf))


@query
def b7_valid_ids(spark, sf):
    return S.pair_ids(spark, sf).filter(text.valid_id(F.col("chosen_comment_id"))).select("pair_id", "chosen_comment_id")


@query
def b8_story_record(spark, sf):
    return longs(rehydrate.story_record(S.skeleton(spark, sf), S.posts(spark, sf, counted=False)), "score")


@query
def b9_keep_only(spark, sf):
    return forum.keep_only(S.rationales(spark, sf), ["row_id", "preferred"])


@query
def b10_require_columns(spark, sf):
    return schemas.require_columns(S.train_pairs(spark, sf), V.TRAIN_FIELDS, "training pairs").select("pair_id", "prompt")


@query
def b11_is_complete(spark, sf):
    complete = text.is_complete(F.col("chosen_story"), F.col("rejected_story"))
    return pairs(spark, sf).select("pair_id", complete.alias("complete"))


# --- forum queries


@query
def c1_top_posts(spark, sf):
    return longs(forum.top_posts(S.posts(spark, sf), "click", "week", as_of=S.AS_OF), "score", "num_comments")


@query
def c1_top_posts_everywhere(spark, sf):
    top = forum.top_posts(S.posts(spark, sf, counted=False), time_filter="month", limit=100, as_of=S.AS_OF)
    return longs(top.select("subreddit", "rank", "post_id", "score"), "rank", "score")


@query
def c1_top_posts_by_days(spark, sf):
    """A week that begins and ends within a day, from the lists of its whole days and the posts of its two ends."""
    posts = S.posts(spark, sf)
    tops = durable(tops_.daily_tops(posts))
    return longs(tops_.top_posts_by_days(tops, posts, "click", "week", S.AS_OF + 30_000), "score", "num_comments")


@query
def c1_merged_tops(spark, sf):
    days = range(int(S.AS_OF // tops_.DAY) - 30, int(S.AS_OF // tops_.DAY))
    tops = durable(tops_.daily_tops(S.posts(spark, sf, counted=False), 100))
    return longs(tops_.merged_tops(tops, days[0], days[-1], 100), "rank", "score")


def _search(spark, sf, sort):
    found = forum.search_posts(S.posts(spark, sf, counted=False), "view", "STORY 4", sort)
    return longs(found.select("post_id", "title", "selftext", "score"), "score")


@query
def c2_search_relevance(spark, sf):
    return _search(spark, sf, "relevance")


@query
def c2_search_hot(spark, sf):
    return _search(spark, sf, "hot")


@query
def c2_search_top(spark, sf):
    return _search(spark, sf, "top")


@query
def c2_search_new(spark, sf):
    return _search(spark, sf, "new")


@query
def c2_search_own_ranking(spark, sf):
    return _search(spark, sf, F.col("score") * F.col("upvote_ratio"))


def _indexed(spark, sf, posts, subreddit, words, sort):
    path = scratch_path(spark, "index")
    search.save_index(posts, path)
    found = search.search_indexed(search.open_index(spark, path), posts, subreddit, words, sort)
    return longs(found.select("post_id", "score", "relevance"), "score")


@query
def c2_indexed_relevance(spark, sf):
    """Whole texts of documents as posts, by BM25."""
    return _indexed(spark, sf, S.document_posts(spark, sf), "en", "The, of WAS", "relevance")


@query
def c2_indexed_top(spark, sf):
    return _indexed(spark, sf, S.posts(spark, sf, counted=False), "view", "story 9", "top")


@query
def c2_postings(spark, sf):
    postings = search.postings_of(S.document_posts(spark, sf)).groupBy("post_id")
    return postings.agg(
        F.count("*").alias("words"), F.sum("in_title").alias("in_title"), F.sum("in_text").alias("in_text"),
        F.max("length").cast("bigint").alias("length"),
    )


@query
def c3_posts_by_id(spark, sf):
    known = S.skeleton(spark, sf).select("post_id")
    unknown = known.select(F.concat(F.lit("x"), F.col("post_id")).alias("post_id"))
    return longs(forum.posts_by_id(S.posts(spark, sf), known.union(unknown)), "score", "num_comments")


@query
def c3_posts_with_comments(spark, sf):
    known = S.skeleton(spark, sf).select("post_id")
    unknown = known.select(F.concat(F.lit("x"), F.col("post_id")).alias("post_id"))
    found = trees.posts_with_comments_by_id(
        S.posts(spark, sf, counted=False), S.skeleton(spark, sf), known.union(unknown)
    )
    ids = F.array_join(F.transform("comments", lambda c: c["comment_id"]), ",")
    return found.select("post_id", "title", "author", ids.alias("ids"))


def _nested(df: DataFrame) -> DataFrame:
    ids = F.transform("comments", lambda c: c["comment_id"])
    bodies = F.transform("comments", lambda c: F.concat_ws("|", c["body"], c["author"], c["parent_id"]))
    return df.select(
        "post_id",
        F.col("part").cast("bigint").alias("part"),
        F.size("comments").cast("bigint").alias("n"),
        F.array_join(ids, ",").alias("ids"),
        fingerprint(bodies).alias("bodies_md5"),
    )


@query
def c4_comments_in_order(spark, sf):
    """The flat form: one row per comment, whatever the size of its post."""
    found = trees.comments_in_order(S.skeleton(spark, sf), S.more(spark, sf))
    kept = found.select("comment_id", "body", "score", "author", "is_top_level", "parent_id", "post_id", "position")
    return longs(kept, "score", "position")


@query
def c4_with_comments(spark, sf):
    return _nested(trees.with_comments(S.posts(spark, sf, counted=False), S.skeleton(spark, sf)))


@query
def c4_with_comments_in_parts(spark, sf):
    return _nested(trees.with_comments(S.posts(spark, sf, counted=False), S.skeleton(spark, sf), per_row=4))


@query
def c5_partial_comments(spark, sf):
    return _nested(
        trees.with_comments(
            S.posts(spark, sf, counted=False), S.skeleton(spark, sf), S.more(spark, sf), complete=False
        )
    )


@query
def c6_expand_more(spark, sf):
    hidden = trees.placeholder_children(S.more(spark, sf))
    loaded = S.skeleton(spark, sf).join(hidden, "comment_id", "left_anti")
    full = trees.expand_more(S.more(spark, sf), S.skeleton(spark, sf), loaded)
    return full.select("comment_id", "parent_id", "body")


@query
def c7_comment_tree(spark, sf):
    tree = trees.comment_paths(S.skeleton(spark, sf))
    path = F.array_join(F.transform("chain", lambda c: c["id"]), "/")
    return longs(tree.select("comment_id", "post_id", "depth", path.alias("path")), "depth")


@query
def c7_max_depth(spark, sf):
    tree = trees.comment_tree(S.skeleton(spark, sf), max_depth=1)
    return longs(tree.select("comment_id", "post_id", "depth"), "depth")


@query
def c7_breadth_first(spark, sf):
    return longs(trees.comment_positions(S.skeleton(spark, sf)), "depth")


@query
def c8_comments_by_id(spark, sf):
    ids = rehydrate.all_ids(S.pair_ids(spark, sf)).withColumnRenamed("id", "comment_id")
    found = forum.comments_by_id(S.comments(spark, sf), S.posts(spark, sf, counted=False), ids)
    return longs(found, "score")


@query
def c9_replies(spark, sf):
    ids = S.skeleton(spark, sf).select("comment_id")
    return longs(trees.replies(S.skeleton(spark, sf), ids), "rank", "score", "depth")


@query
def c9_replies_limited(spark, sf):
    ids = S.skeleton(spark, sf).select("comment_id")
    rows = trees.replies(S.skeleton(spark, sf), ids, reply_limit=3)
    return longs(rows.select("root_id", "rank", "comment_id", "depth"), "rank", "depth")


@query
def c9_replies_of_loaded(spark, sf):
    """Placeholders lie below wanted comments, with more below them; some wanted comments are hidden themselves."""
    ids = S.skeleton(spark, sf).select("comment_id")
    rows = trees.replies(S.skeleton(spark, sf), ids, 4, more=S.inner_more(spark, sf))
    return longs(rows.select("root_id", "rank", "comment_id", "depth"), "rank", "depth")


@query
def c7_tour_numbers(spark, sf):
    """What the numbers of a tour say: level, and how many comments lie below."""
    tree = tours.numbered_tree(S.skeleton(spark, sf))
    below = ((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint")
    return tree.select("comment_id", "post_id", "level", below.alias("below"), (F.col("kind") == tours.ROOTED).alias("rooted"))


@query
def c9_comments_with_replies(spark, sf):
    comments = S.comments(spark, sf)
    ids = comments.select("comment_id")
    found = forum.comments_by_id(comments, S.posts(spark, sf, counted=False), ids)
    nested = trees.with_replies(found, trees.replies(S.skeleton(spark, sf), ids))
    reply_ids = F.array_join(F.transform("replies", lambda r: r["comment_id"]), ",")
    return nested.select("comment_id", "post_title", reply_ids.alias("replies"))


# --- rehydration


@query
def d1_side_ids(spark, sf):
    return rehydrate.side_ids(S.pair_ids(spark, sf), "chosen_comment_id")


@query
def d2_all_ids(spark, sf):
    return rehydrate.all_ids(S.pair_ids(spark, sf))


@query
def d3_fetch_records(spark, sf):
    return longs(records(spark, sf), "score")


@query
def d4_pending_ids(spark, sf):
    return rehydrate.pending_ids(rehydrate.all_ids(S.pair_ids(spark, sf)), records(spark, sf))


@query
def d5_first_record(spark, sf):
    return longs(rehydrate.first_record(S.attempts(spark, sf)), "score")


@query
def d6_assemble_pairs(spark, sf):
    return pairs(spark, sf)


@query
def d7_prompt_choice(spark, sf):
    untitled = S.posts(spark, sf, counted=False).withColumn(
        "title", F.expr("CASE WHEN CAST(substring(post_id, 2) AS BIGINT) % 5 <> 0 THEN title END")
    )
    rows = rehydrate_pairs(S.pair_ids(spark, sf), S.skeleton(spark, sf), untitled)
    return rows.select("pair_id", "prompt")


@query
def rehydration_completeness(spark, sf):
    return rehydration_report(S.pair_ids(spark, sf), S.skeleton(spark, sf), S.posts(spark, sf, counted=False))


# --- aggregates, samples, splits


@query
def e1_completeness(spark, sf):
    return rehydrate.completeness(pairs(spark, sf)).withColumn("completeness_rate", F.round("completeness_rate", 6))


@query
def e2_coverage(spark, sf):
    return rehydrate.coverage(rehydrate.all_ids(S.pair_ids(spark, sf)), records(spark, sf))


@query
def e3_split_sizes(spark, sf):
    train, test = sampling.exact_split(S.rationales(spark, sf), "row_id")
    return sampling.split_sizes(train=train, val=sampling.validation_sample(test, 3, key="row_id"), test=test)


@query
def e4_validation_sample(spark, sf):
    return sampling.validation_sample(S.pair_ids(spark, sf))


@query
def e5_exact_split(spark, sf):
    train, test = sampling.exact_split(S.rationales(spark, sf), "row_id")
    return train.select(F.lit("train").alias("split"), "row_id", "story_a").unionByName(
        test.select(F.lit("test").alias("split"), "row_id", "story_a")
    )


@query
def h1_stable_position(spark, sf):
    return sampling.stable_position(S.table(spark, sf, "documents").select("doc_id"), "doc_id", V.SPLIT_SEED)


# --- prompts and answers


@query
def g1_template_for(spark, sf):
    df = S.rationales(spark, sf)
    choices = [
        F.struct(
            F.lit(model).alias("model"),
            F.lit(cot).alias("cot"),
            F.md5(text.user_prompt(F.col("story_a"), F.col("story_b"), text.template_for(model, cot))).alias("prompt_md5"),
        )
        for model in (LLAMA, OTHER)
        for cot in (True, False)
    ]
    return df.select("row_id", F.explode(F.array(*choices)).alias("c")).select("row_id", "c.*")


@query
def g2_user_prompt(spark, sf):
    template = text.template_for(OTHER, cot=True)
    filled = text.user_prompt(F.col("story_a"), F.col("story_b"), template)
    return S.rationales(spark, sf).select("row_id", filled.alias("prompt"))


@query
def g3_rationale_text(spark, sf):
    return S.rationales(spark, sf).select("row_id", text.rationale_text(F.col("rationale")).alias("rationale"))


@query
def g4_label_text(spark, sf):
    df = S.noisy_rationales(spark, sf)
    return df.select("row_id", chat.label_text(df).alias("label"))


@query
def g4_bad_rows(spark, sf):
    return chat.bad_rows(S.noisy_rationales(spark, sf), cot=True).select("row_id", "preferred")


@query
def g5_answer_cot(spark, sf):
    df = S.rationales(spark, sf)
    return df.select("row_id", chat.answer_cot(df).alias("answer"))


@query
def g6_answer_direct(spark, sf):
    df = S.rationales(spark, sf)
    return df.select("row_id", chat.answer_direct(df).alias("answer"))


@query
def g7_chat_examples(spark, sf):
    return chat.chat_examples(S.noisy_rationales(spark, sf), LLAMA, cot=True, on_bad="quarantine", keep=("row_id",))


def _chat(spark, sf, cot):
    train, validation = chat.sft_splits(S.rationales(spark, sf), OTHER, cot, on_bad="quarantine", keep=("row_id",))
    return train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("val")))


@query
def g8_sft_splits_cot(spark, sf):
    return _chat(spark, sf, cot=True)


@query
def g8_sft_splits_direct(spark, sf):
    return _chat(spark, sf, cot=False)


# --- tokens


def encoded_documents(spark, sf):
    return tokens.encode(S.documents(spark, sf), "doc_id", "text", vocab(spark, sf))


@query
def t1_encode(spark, sf):
    """With its own vocabulary, which knows every word: no id is the unknown one."""
    unknown = F.size(F.filter("ids", lambda i: i == tokens.UNKNOWN_ID)).cast("bigint").alias("unknown")
    return encoded_documents(spark, sf).select("doc_id", *array_columns(F.col("ids"), "ids"), unknown)


@query
def t1_encode_by_join(spark, sf):
    encoded = tokens.encode_by_join(S.documents(spark, sf), "doc_id", "text", vocab(spark, sf))
    return encoded.select("doc_id", *array_columns(F.col("ids"), "ids"))


@query
def t1_encode_beyond_shipped(spark, sf):
    """The ids of `t1_encode`, by a dictionary of which only the frequent words are shipped."""
    words = WordDictionary(vocab(spark, sf), SMALL_DICTIONARY)
    encoded = tokens.encode(S.documents(spark, sf), "doc_id", "text", words)
    return encoded.select("doc_id", *array_columns(F.col("ids"), "ids"))


@query
def t2_build_vocab(spark, sf):
    return longs(tokens.build_vocab(S.documents(spark, sf), "text"), "id")


@query
def t3_pad_policies(spark, sf):
    ids = F.col("ids")
    return encoded_documents(spark, sf).select(
        "doc_id",
        fingerprint(arrays.pad(ids, V.MAX_LENGTH, tokens.pad_id("end_of_text"))).alias("end_of_text_md5"),
        fingerprint(arrays.pad(ids, V.MAX_LENGTH, tokens.pad_id("add"))).alias("added_md5"),
    )


@query
def t4_pad(spark, sf):
    ids = F.col("ids")
    return encoded_documents(spark, sf).select(
        "doc_id",
        *array_columns(arrays.pad(ids, V.MAX_LENGTH, tokens.PAD_ID), "right"),
        *array_columns(arrays.pad(ids, V.MAX_LENGTH, tokens.PAD_ID, "left"), "left"),
    )


@query
def t5_attention_mask(spark, sf):
    mask = arrays.attention_mask(F.col("ids"), V.MAX_LENGTH)
    return encoded_documents(spark, sf).select("doc_id", *array_columns(mask, "mask"))


def _token_arrays(df: DataFrame) -> DataFrame:
    return df.select("pair_id", *[fingerprint(F.col(name)).alias(name) for name in V.TOKEN_FIELDS])


@query
def t6_tokenize_pairs(spark, sf):
    return _token_arrays(tokens.tokenize_pairs(pairs(spark, sf), vocab(spark, sf)))


@query
def t6_tokenize_beyond_shipped(spark, sf):
    return _token_arrays(tokens.tokenize_pairs(pairs(spark, sf), WordDictionary(vocab(spark, sf), SMALL_DICTIONARY)))


def _prepared(spark, sf, **options):
    ready = prepare_pairs(
        S.train_pairs(spark, sf), pairs(spark, sf), vocab(spark, sf), OTHER, source=sf,
        cache_base=scratch_path(spark, "processed"), **options,
    )
    splits = {"train": ready.train, "val": ready.validation, "test": ready.test}
    tagged = [_token_arrays(df).withColumn("split", F.lit(name)) for name, df in splits.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query
def t7_prepare_pairs(spark, sf):
    return _prepared(spark, sf)


@query
def t7_prepare_beyond_shipped(spark, sf):
    return _prepared(spark, sf, limit=SMALL_DICTIONARY)


@query
def t7_two_vocabularies(spark, sf):
    """One cache, one source, two vocabularies: each gets ids of its own."""
    base, train = scratch_path(spark, "processed"), S.train_pairs(spark, sf)
    full = vocab(spark, sf)
    small = full.filter(F.col("id") < 10)
    found = [
        prepare_pairs(train, train, words, OTHER, source=sf, cache_base=base).train.select(
            F.lit(name).alias("vocabulary"), "pair_id", fingerprint(F.col("input_ids_chosen")).alias("input_ids_chosen")
        )
        for name, words in (("full", full), ("small", small))
    ]
    return found[0].unionByName(found[1])


@query
def t7_prepared_sizes(spark, sf):
    return prepare_pairs(
        S.train_pairs(spark, sf), pairs(spark, sf), vocab(spark, sf), OTHER, source=sf,
        cache_base=scratch_path(spark, "processed"),
    ).sizes()


def _encoded_chat(spark, sf):
    """Verdict-only chat rows as ids, and the ids of the marker after which the answer begins."""
    examples = chat.chat_examples(S.rationales(spark, sf), LLAMA, cot=False, on_bad="quarantine", keep=("row_id",))
    words, tag = _words_and_marker(spark, sf)
    return tokens.encode(examples, "row_id", "text", words), tag


def _words_and_marker(spark, sf):
    words = vocab(spark, sf)
    return words, tokens.marker_ids(words)


@query
def t8_find_marker(spark, sf):
    ids, tag = _encoded_chat(spark, sf)
    return ids.select("row_id", arrays.find_subsequence(F.col("ids"), tag).cast("bigint").alias("place"))


@query
def t9_answer_labels(spark, sf):
    ids, tag = _encoded_chat(spark, sf)
    return ids.select("row_id", *array_columns(arrays.answer_labels(F.col("ids"), tag), "labels"))


@query
def t10_truncation_report(spark, sf):
    examples = chat.chat_examples(S.rationales(spark, sf), LLAMA, cot=True, on_bad="quarantine", keep=("row_id",))
    return tokens.truncation_report(examples, "text", max_length=512)


# --- batches


@query
def f1_assign_batches(spark, sf):
    return longs(batches.assign_batches(S.pair_ids(spark, sf).select("pair_id"), "pair_id", 8, epochs=3), "epoch")


@query
def f1_permuted_batches(spark, sf):
    """One ordering for three epochs."""
    return longs(batches.permuted_batches(S.pair_ids(spark, sf).select("pair_id"), "pair_id", 8, epochs=3), "epoch")


@query
def f2_drop_last(spark, sf):
    plan = batches.assign_batches(S.pair_ids(spark, sf).select("pair_id"), "pair_id", 7, epochs=2)
    return longs(batches.drop_last(plan, 7), "epoch")


@query
def f3_training_plan(spark, sf):
    pairwise = batches.training_plan(S.pair_ids(spark, sf), batch=8).withColumn("trainer", F.lit("pairwise"))
    generative = batches.training_plan(S.rationales(spark, sf), batch=2, devices=3)
    return pairwise.unionByName(generative.withColumn("trainer", F.lit("generative")))


@query
def f4_pad_to_batch(spark, sf):
    plan = batches.assign_batches(S.table(spark, sf, "documents").select("doc_id"), "doc_id", 8)
    padded = batches.pad_to_batch(plan.join(encoded_documents(spark, sf), "doc_id"), "ids", tokens.PAD_ID)
    return longs(
        padded.select(
            "epoch", "batch", "doc_id", *array_columns(F.col("ids"), "ids"),
            *array_columns(F.col("attention_mask"), "mask"),
        ),
        "epoch",
    )


@query
def f5_step_of(spark, sf):
    plan = batches.assign_batches(S.pair_ids(spark, sf).select("pair_id"), "pair_id", 8)
    return longs(plan.select("epoch", "pair_id", arrays.step_of(F.col("batch"), 16).alias("step")), "epoch")


@query
def generative_batches(spark, sf):
    train, _ = chat.sft_splits(S.rationales(spark, sf), LLAMA, cot=False, on_bad="quarantine", keep=("row_id",))
    words, tag = _words_and_marker(spark, sf)
    rows = chat_batches(train, words, tag, batch_size=4, epochs=2)
    columns = [c for name in ("ids", "labels", "attention_mask") for c in array_columns(F.col(name), name)]
    return longs(rows.select("epoch", "batch", "row_id", *columns), "epoch")


# --- reward model


def _stories(train):
    return train.select(F.explode(F.array("chosen_story", "rejected_story")).alias("story"))


def _features(spark, sf):
    train = durable(S.train_pairs(spark, sf))
    return train, reward.fit_features(_stories(train), "story")


@query
def r1_features(spark, sf):
    train, model = _features(spark, sf)
    vectors = reward.features(reward.pair_differences(train, model), "chosen_story", model)
    weights = F.filter(F.unwrap_udt(F.col("features"))["values"], lambda x: x != 0)
    total = lambda values: F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x)), 4)
    return vectors.select(
        "pair_id", F.size(weights).cast("bigint").alias("non_zero"), total(weights).alias("weight"),
        F.size("difference").cast("bigint").alias("differing"),
        total(F.transform("difference", lambda e: e["value"])).alias("difference"),
    )


# A gradient of this length: all coefficients together are within a tenth of the best ones.
GRADIENT_BOUND = 1e-3


def _fitted(spark, sf):
    """Pairs to fit on, pairs to measure on, features and scorer fitted on the former."""
    train, validation = map(durable, sampling.exact_split(S.train_pairs(spark, sf), "pair_id"))
    model = reward.fit_features(_stories(train), "story")
    return train, validation, model, reward.fit_bt(train, model)


@query
def r2_fit_bt(spark, sf):
    """Measured on pairs that were not fitted on."""
    train, validation, model, scorer = _fitted(spark, sf)
    metrics = reward.pair_metrics(reward.score_pairs(validation, model, scorer))
    return metrics.withColumn("gradient", F.lit(reward.gradient_norm(reward.penalised_gradient(train, model, scorer))))


@query
def r2_certificate(spark, sf):
    """That no other coefficients fit better: the gradient at the fitted ones, worked out from the pairs."""
    train, validation, model, scorer = _fitted(spark, sf)
    norm = reward.gradient_norm(reward.penalised_gradient(train, model, scorer))
    fit = reward.pair_metrics(reward.score_pairs(train, model, scorer)).select(
        F.col("pairs").alias("train_pairs"), (F.col("mean_loss") < F.log(F.lit(2.0))).alias("better_than_chance")
    )
    held = F.lit(validation.count()).cast("bigint")
    return fit.withColumns({"validation_pairs": held, "optimal": F.lit(norm < GRADIENT_BOUND)})


@query
def r3_score(spark, sf):
    """Scores by the step that SQL can take, too: coefficients against the gradient at 0."""
    train, model = _features(spark, sf)
    scored = reward.score_pairs(train, model, reward.steepest_scorer(train, model))
    return scored.select("pair_id", *[F.round(c, 6).alias(c) for c in ("chosen_score", "rejected_score")])


@query
def r4_pair_metrics(spark, sf):
    scored = S.train_pairs(spark, sf).select(
        (F.length("chosen_story") / 1000).alias("chosen_score"),
        (F.length("rejected_story") / 1000).alias("rejected_score"),
    )
    return reward.pair_metrics(scored).select(
        "pairs", F.round("accuracy", 6).alias("accuracy"), F.round("mean_loss", 6).alias("mean_loss")
    )
