"""The encoder against the library that the vocabulary file belongs to, and cuts against the vocabulary."""

import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

pa_path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
tokenizers = pytest.importorskip("tokenizers")

from prefweave.llm.bpe import SHORT, Encoder, decode_column, encode_column, round_trip_digests, shipped_vocabulary  # noqa: E402

ENCODER = Encoder(open(pa_path, encoding="utf-8").read())
LIBRARY = tokenizers.Tokenizer.from_file(pa_path)

HARD = [
    "", " ", "\n\t", "It's what they'll say, we've I'm you'd 'S 'T don't", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>C", "<|endof",
    "ΑΣ ΟΔΟΣ", "İstanbul ıI ŉ ſecret K", "é àx", "½ ² ३ 12345 １２", "ﬁ ﬂ", "日本語 テキスト 한국어", "a b c\x85d\x1ce\x1f", "_a_b __ $$$***&&&",
    "😀👍🏽 🇩🇪", "x" * 500, "ab" * 300, "éèêëçñ ßẞ ÀÉ", "​‍﻿", "don’t ‘s", "'" * 50, "ª º µ ×÷ ¹³¼¾", "ǅ ǈ ᾳ", "\x00\x01\x7f",
]


def expected(text):
    found = LIBRARY.encode(text, add_special_tokens=False)
    return len(found.ids), " ".join(map(str, found.ids)), LIBRARY.decode(found.ids, skip_special_tokens=False)


def test_hard_texts():
    for text in HARD:
        n, ids, decoded = expected(text)
        assert ENCODER.encode(text) == (n, ids), text
        assert ENCODER.decode(ids) == decoded


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    n, ids, decoded = expected(text)
    assert ENCODER.encode(text) == (n, ids)
    assert ENCODER.decode(ids) == decoded


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinthogràéß'$1 ", max_size=300))
def test_latin_text(text):
    assert ENCODER.encode(text) == expected(text)[:2]


def test_both_ways_of_merging_agree():
    for word in ("international", "thhaonre", "tiontiontion", "aaaaaaa", "ouêoi"):
        spelt = "".join(map(ENCODER.letters.__getitem__, word.encode()))
        parts = [*spelt[:-1], spelt[-1] + ENCODER.end]
        assert ENCODER._merge_short(list(parts)) == ENCODER._merge_long(list(parts))
    assert len("x" * 500) > SHORT


def test_cuts_never_part_a_token():
    for token in list(ENCODER.vocab)[:5000]:
        bare = ENCODER._bare(token)
        assert ENCODER.fragments_of(bare) == [(bare, True)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    coded = round_trip_digests(F.col("text"), shipped_vocabulary(spark, pa_path))
    for row in docs.select("text", coded.alias("c")).collect():
        n, ids, decoded = expected(row["text"] or "")
        assert row["c"]["n_tokens"] == n
        assert row["c"]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert row["c"]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_edge_rows(spark):
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("ids", StringType())])
    rows = [(1, None, "x"), (None, "", None), (2, "the the", "y"), (2, "the the", "y"), (3, "word " * 200_000, None)]
    docs = spark.createDataFrame(rows, schema)
    vocabulary = shipped_vocabulary(spark, pa_path)
    found = docs.select("doc_id", "ids", encode_column(F.col("text"), vocabulary).alias("c"))
    decoded = found.select("doc_id", "c.*", decode_column(F.col("c.ids"), vocabulary).alias("text")).collect()
    assert [r["n_tokens"] for r in decoded] == [0, 0, 2, 2, 200_000]
    assert decoded[2]["text"] == "the</w> the</w>" and decoded[0]["text"] == ""
    assert docs.limit(0).select(encode_column(F.col("text"), vocabulary).alias("c")).count() == 0
