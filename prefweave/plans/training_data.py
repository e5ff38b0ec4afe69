"""Training data end to end: tokenised splits of a pairwise trainer, batches of a generative one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.functions.arrays import answer_labels
from prefweave.operators.batches import assign_batches, drop_last, pad_to_batch
from prefweave.operators.dictionary import SHIPPED_BYTES, WordDictionary
from prefweave.operators.sampling import split_sizes, validation_sample
from prefweave.operators.tokens import PAD_ID, UNKNOWN_ID, encode, encode_pairs, pad_pairs
from prefweave.schemas import require_columns
from prefweave.sources.sinks import cache_key, cached


@dataclass
class PreparedPairs:
    train: DataFrame
    validation: DataFrame
    test: DataFrame

    def sizes(self) -> DataFrame:
        return split_sizes(train=self.train, validation=self.validation, test=self.test)


def vocabulary_mark(vocab: DataFrame) -> str:
    """Tells vocabularies apart: the number of entries, and a sum of their hashes, which their order does not change."""
    row = vocab.agg(F.count("*"), F.sum(F.xxhash64("token", "id").cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


def prepare_pairs(
    train: DataFrame,
    test: DataFrame,
    vocab: DataFrame,
    model_name: str,
    source: str,
    cache_base: str | None = None,
    max_length: int = V.MAX_LENGTH,
    pad_with: int = PAD_ID,
    seed: int = V.SPLIT_SEED,
    limit: int = SHIPPED_BYTES,
) -> PreparedPairs:
    """T7. Check both tables, tokenise them, and draw the validation rows out of the test rows.

    `source` says where the rows come from; it is part of the cache key, as is a mark of the vocabulary. The cache holds ids without padding; the
    padded arrays are made when a split is read. The validation rows are test rows, so they are drawn from the tokenised
    test rows by their id instead of being tokenised once more. Words beyond `limit` bytes of the vocabulary are not
    shipped to the tasks but joined.
    """
    require_columns(train, V.TRAIN_FIELDS, "training pairs")
    require_columns(test, V.TRAIN_FIELDS, "test pairs")
    words = WordDictionary(vocab, limit, UNKNOWN_ID)
    known = None if cache_base is None else vocabulary_mark(vocab)

    def encoded(name: str, pairs: DataFrame) -> DataFrame:
        def build() -> DataFrame:
            return encode_pairs(pairs, words, max_length)

        if cache_base is None:
            return build()
        key = cache_key(model_name, max_length, name, source, seed, vocabulary=known)
        return cached(pairs.sparkSession, cache_base, key, build)

    def padded(name: str, pairs: DataFrame) -> DataFrame:
        return require_columns(pad_pairs(pairs, max_length, pad_with), V.TOKEN_FIELDS, f"{name} split")

    tokenised = encoded("test", test)
    drawn = validation_sample(tokenised if cache_base else test, seed=seed)
    return PreparedPairs(
        padded("train", encoded("train", train)),
        padded("validation", drawn if cache_base else encoded("validation", drawn)),
        padded("test", tokenised),
    )


def chat_batches(
    examples: DataFrame,
    vocab: DataFrame,
    tag: list[int],
    batch_size: int,
    epochs: int = 1,
    key: str = "row_id",
    max_length: int = V.MAX_LENGTH,
    pad_with: int = PAD_ID,
    seed: int = V.SPLIT_SEED,
    limit: int = SHIPPED_BYTES,
) -> DataFrame:
    """Chat examples as the batches of a generative trainer: T1, T9, F1, F2, F4.

    Texts are encoded once; the plan of batches is made on keys alone and meets the ids after the short last batch of
    each epoch is gone. Labels start after the answer marker `tag`; rows are padded to the longest of their batch.
    """
    encoded = encode(examples, key, "text", WordDictionary(vocab, limit, UNKNOWN_ID), max_length)
    labelled = encoded.withColumn("labels", answer_labels(F.col("ids"), tag))
    plan = drop_last(assign_batches(examples.select(key), key, batch_size, epochs, seed), batch_size)
    return pad_to_batch(plan.join(labelled, key), "ids", pad_with, labels="labels")
