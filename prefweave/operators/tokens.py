"""Token ids: vocabulary, encoding, pair arrays, truncation report."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from prefweave import fixed_values as V
from prefweave.durable import durable
from prefweave.functions.arrays import attention_mask, find_subsequence, pad
from prefweave.functions.text import token_list, tokens
from prefweave.operators.dictionary import SHIPPED_BYTES, WordDictionary
from prefweave.operators.skew import rank_rows, top_k

# Functions of this module travel to the executors by value, which need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text of the rows that meet their words in one task.
GROUP_BYTES = 8 << 20
# Reserved ids; words start after them.
PAD_ID, UNKNOWN_ID, END_OF_TEXT_ID = 0, 1, 2
SPECIAL_TOKENS = {"[PAD]": PAD_ID, "[UNK]": UNKNOWN_ID, "<|endoftext|>": END_OF_TEXT_ID}


def build_vocab(df: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """T2. (token, id) of the special tokens and of every token, or of the `size` most frequent ones.

    Ids follow frequency, the most frequent first; ties go by token. Counting combines on the map side, so frequent tokens
    are no hot keys, and ranks are given without one task seeing all tokens.
    """
    counts = df.select(F.explode(tokens(F.col(column))).alias("token")).groupBy("token").count()
    if size is None:
        words = rank_rows(counts.select((-F.col("count")).alias("rarity"), "token"), ["rarity", "token"], "place")
    else:
        frequent = top_k(counts, [F.desc("count"), F.asc("token")], size)
        # At most `size` rows are left to number.
        words = frequent.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("token"))) - 1)
    words = words.select("token", (F.col("place") + len(SPECIAL_TOKENS)).cast("int").alias("id"))
    special = df.sparkSession.createDataFrame(list(SPECIAL_TOKENS.items()), "token string, id int")
    return special.unionByName(words)


def marker_ids(vocab: DataFrame, marker: str = V.RESPONSE_MARKER) -> list[int]:
    """The ids of the words and signs of `marker`: what says in an encoded text that the answer begins.

    Only the few tokens of the marker come to the driver; one that the vocabulary lacks is unknown here as in the text.
    """
    wanted = token_list(marker)
    known = {r["token"]: r["id"] for r in vocab.filter(F.col("token").isin(wanted)).collect()}
    return [known.get(word, UNKNOWN_ID) for word in wanted]


def pad_id(policy: str, pad: int | None = None, end_of_text: int = END_OF_TEXT_ID, added: int = PAD_ID) -> int:
    """T3. The id to pad with. A tokenizer's own `pad` id wins; without one, the pairwise trainer takes the
    end-of-text id (`end_of_text`) and the generative trainer an `added` [PAD] id (`add`)."""
    if pad is not None:
        return pad
    if policy == "end_of_text":
        return end_of_text
    if policy == "add":
        return added
    raise ValueError("policy must be 'end_of_text' or 'add'")


class Vocabulary(WordDictionary):
    """The words of a vocabulary that has to fit: all of them are shipped, or it is an error."""

    def __init__(self, vocab: DataFrame, limit: int = SHIPPED_BYTES):
        super().__init__(vocab, limit, UNKNOWN_ID)
        if not self.whole:
            raise ValueError(f"a vocabulary of {self.size} words is not shipped to every task; use encode_by_join or WordDictionary")


def _dictionary(vocab: DataFrame | WordDictionary) -> WordDictionary:
    return vocab if isinstance(vocab, WordDictionary) else WordDictionary(vocab, unknown=UNKNOWN_ID)


def encode(df: DataFrame, key: str, column: str, vocab: DataFrame | WordDictionary, max_length: int = V.MAX_LENGTH) -> DataFrame:
    """T1. (key, ids) with at most `max_length` ids per row; null for null text, empty for text without tokens.

    The tokens of a row stay in it: nothing is exploded or shuffled, but for the rare words of a vocabulary that is too large
    to ship (see `WordDictionary`). Every word of the vocabulary counts.
    """
    words = F.slice(tokens(F.col(column)), 1, max_length)
    return _dictionary(vocab).encode(df, key, {"ids": words})


def encode_by_join(df: DataFrame, key: str, column: str, vocab: DataFrame, max_length: int = V.MAX_LENGTH) -> DataFrame:
    """As `encode`, with nothing shipped at all: every word meets the vocabulary in a join. `key` is unique.

    Rows are dealt by a hash of their key into groups of about GROUP_BYTES of text. Each word of a group joins the vocabulary once,
    however often it stands there, and comes back to its group with its id; the rows move as text, not word by word.
    """
    total = df.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    # No token holds a line break. Every group has a word here, if only a null one.
    said = F.array_join(F.slice(tokens(F.col(column)), 1, max_length), "\n")
    group = F.pmod(F.xxhash64(key), F.lit(total // GROUP_BYTES + 1))
    dealt = durable(df.select(F.col(key).alias("_key"), group.alias("_group"), said.alias("_said")).repartition("_group"))
    needed = dealt.select("_group", F.explode_outer(F.split("_said", "\n")).alias("_token")).distinct()
    known = needed.join(vocab.select("token", F.col("id").cast("int").alias("id")), F.col("_token") == F.col("token"), "left")
    told = known.select(F.col("_group").alias("_of"), "_token", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("_id"))
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])

    def ids_of(rows: pa.Table, words: pa.Table) -> pa.Table:
        return _ids_of_group(rows, words).rename_columns([key, "ids"])

    return dealt.groupBy("_group").cogroup(told.groupBy("_of")).applyInArrow(ids_of, schema)


def _ids_of_group(rows: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of the rows of a group, by its words."""
    said, keys = (rows[c].combine_chunks() for c in ("_said", "_key"))
    split = pc.split_pattern(said, "\n")
    flat, sizes = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    at = pc.index_in(coded.dictionary, value_set=words["_token"].combine_chunks()) if words.num_rows else None
    ids = np.zeros(0, np.int32) if at is None else words["_id"].to_numpy()[at.to_numpy(zero_copy_only=False)]
    # An empty text is one empty word here, which is no token.
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    row = np.repeat(np.arange(len(said)), sizes)[real]
    found = ids[coded.indices.to_numpy(zero_copy_only=False)][real]
    # Rows that share a key share their ids, by place.
    of = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(of[row], minlength=len(said))
    if len(of) and of.max() + 1 < len(of):
        place = np.arange(len(row)) - np.searchsorted(row, row)
        found = found[np.lexsort((found, place, of[row]))]
    begins, lengths = (np.cumsum(counts) - counts)[of], counts[of]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    taken = found[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], lengths)]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(taken.astype(np.int32)), mask=pc.is_null(said))
    return pa.table([keys, lists], names=["_key", "ids"])


def encode_pairs(
    df: DataFrame, vocab: DataFrame | WordDictionary, max_length: int = V.MAX_LENGTH, key: str = "pair_id"
) -> DataFrame:
    """(key, chosen_ids, rejected_ids) without padding: the form to store, as padding would only add bulk.

    Both stories are looked up where they lie. The prompt is not used.
    """
    texts = {f"{side}_ids": F.slice(tokens(F.col(f"{side}_story")), 1, max_length) for side in ("chosen", "rejected")}
    return _dictionary(vocab).encode(df, key, texts)


def pad_pairs(
    encoded: DataFrame, max_length: int = V.MAX_LENGTH, pad_with: int = PAD_ID, key: str = "pair_id", side: str = "right"
) -> DataFrame:
    """T4, T5 on encoded pairs: the four arrays a pairwise trainer takes."""
    chosen, rejected = F.col("chosen_ids"), F.col("rejected_ids")
    return encoded.select(
        key,
        pad(chosen, max_length, pad_with, side).alias("input_ids_chosen"),
        attention_mask(chosen, max_length, side).alias("attention_mask_chosen"),
        pad(rejected, max_length, pad_with, side).alias("input_ids_rejected"),
        attention_mask(rejected, max_length, side).alias("attention_mask_rejected"),
    )


def tokenize_pairs(
    df: DataFrame,
    vocab: DataFrame | WordDictionary,
    max_length: int = V.MAX_LENGTH,
    pad_with: int = PAD_ID,
    key: str = "pair_id",
) -> DataFrame:
    """T6. Stories of each pair as padded ids and masks; a missing story gives null arrays."""
    return pad_pairs(encode_pairs(df, vocab, max_length, key), max_length, pad_with, key)


def truncation_report(
    df: DataFrame, column: str, max_length: int = V.MAX_LENGTH, tag: list[str] | None = None
) -> DataFrame:
    """T10. Rows, rows without text, rows cut at `max_length`, and rows whose answer marker fell behind the cut and
    which therefore train on nothing. `tag` is the marker as tokens: all of them, in order, must be left."""
    # Tokens and cut tokens become columns of their own first: the search for the marker reads them place by place.
    words = df.select(tokens(F.col(column)).alias("_words"))
    kept = words.select(F.size("_words").alias("_length"), F.slice("_words", 1, max_length).alias("_kept"))
    found = kept.select("_length", find_subsequence(F.col("_kept"), tag or token_list(V.RESPONSE_MARKER)).alias("_place"))
    has_text = F.col("_length").isNotNull()
    return found.agg(
        F.count("*").alias("total_rows"),
        F.count_if(~has_text).alias("rows_without_text"),
        F.count_if(F.col("_length") > max_length).alias("rows_cut"),
        F.count_if(has_text & F.col("_place").isNull()).alias("rows_without_marker"),
    )
