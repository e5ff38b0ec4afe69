"""Vocabulary and encoding against plain Python."""

from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.operators import tokens
from prefweave.operators.dictionary import WordDictionary
from prefweave.plans.training_data import prepare_pairs

TEXTS = ["The cat sat. The CAT ran 3 times", "Élan vital — ça va? abc123", "", None, "...", "dog " * 9, "zebra"]


def words(text):
    return regex.findall(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\p{Z}\p{C}]", text.lower())


def vocabulary(texts, size):
    counts = Counter(w for t in texts if t for w in words(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:size]
    return {**tokens.SPECIAL_TOKENS, **{w: i + 3 for i, w in enumerate(ranked)}}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)


@pytest.mark.parametrize("size", [0, 4, 1000, None])
def test_vocabulary(docs, size):
    got = {r["token"]: r["id"] for r in tokens.build_vocab(docs, "text", size).collect()}
    assert got == vocabulary(TEXTS, size)


@pytest.mark.parametrize("max_length", [1, 5, 2048])
@pytest.mark.parametrize("way", [tokens.encode, tokens.encode_by_join])
def test_encode(docs, max_length, way):
    vocab = tokens.build_vocab(docs, "text", 6)
    known = vocabulary(TEXTS, 6)
    got = {r["id"]: r["ids"] for r in way(docs, "id", "text", vocab, max_length).collect()}
    wanted = {
        i: None if t is None else [known.get(w, tokens.UNKNOWN_ID) for w in words(t)][:max_length]
        for i, t in enumerate(TEXTS)
    }
    assert got == wanted


def test_a_large_vocabulary_is_used_whole(spark):
    words = spark.range(40_000).select(F.concat(F.lit("w"), F.conv("id", 10, 26)).alias("w"))
    text = words.select(F.translate("w", "0123456789", "qrstuvwxyz").alias("text")).withColumn("id", F.monotonically_increasing_id())
    vocab = tokens.build_vocab(text, "text").cache()
    encoded = tokens.encode(text, "id", "text", vocab)
    assert encoded.filter(F.array_contains("ids", tokens.UNKNOWN_ID)).count() == 0
    assert vocab.count() == text.select(F.lower("text")).distinct().count() + 3
    with pytest.raises(ValueError, match="encode_by_join"):
        tokens.Vocabulary(vocab, limit=1000)


@pytest.mark.parametrize("room", [0, 1, 5, 9, 1000])
def test_a_dictionary_of_any_size(spark, docs, room):
    """The same ids however few words are shipped; null, empty and repeated texts, and unknown words, included."""
    vocab = tokens.build_vocab(docs, "text", 9)
    known = vocabulary(TEXTS, 9)
    dictionary = WordDictionary(vocab, room * 12)
    assert dictionary.whole == (room >= 12)
    assert len(dictionary.shipped.value[0]) <= max(room, 0)
    wanted = {i: None if t is None else [known.get(w, 1) for w in words(t)][:20] for i, t in enumerate(TEXTS)}
    got = tokens.encode(docs, "id", "text", dictionary, 20)
    assert {r["id"]: r["ids"] for r in got.collect()} == wanted
    pairs = docs.select(F.col("id").alias("pair_id"), F.col("text").alias("chosen_story"), F.reverse("text").alias("rejected_story"))
    for row in tokens.encode_pairs(pairs, dictionary, 20).collect():
        assert row["chosen_ids"] == wanted[row["pair_id"]]
        back = TEXTS[row["pair_id"]]
        assert row["rejected_ids"] == (None if back is None else [known.get(w, 1) for w in words(back[::-1])][:20])


def test_entries_pass_the_driver_in_blocks(spark, docs, monkeypatch):
    """The driver holds a block of the shipped entries at most, whatever the vocabulary, and the ids are the same."""
    from pyspark.sql.classic.dataframe import DataFrame

    from prefweave.operators import dictionary

    def refused(self, *_):
        raise AssertionError("all rows at once on the driver")

    vocab = tokens.build_vocab(docs, "text")
    known = vocabulary(TEXTS, 1000)
    monkeypatch.setattr(dictionary, "BLOCK_BYTES", 36)
    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(DataFrame, "collect", refused)
    shipped = WordDictionary(vocab)
    monkeypatch.undo()
    blocks = [b.value[0] for b in shipped.shipped.blocks]
    assert len(blocks) > 2 and sum(map(len, blocks)) == len(known)
    assert (np.diff(np.concatenate(blocks)) > 0).all()
    got = {r["id"]: r["ids"] for r in tokens.encode(docs, "id", "text", shipped).collect()}
    assert got == {i: None if t is None else [known[w] for w in words(t)] for i, t in enumerate(TEXTS)}


def test_words_with_one_fingerprint_get_another_salt(docs, monkeypatch):
    from prefweave.operators import dictionary

    vocab = tokens.build_vocab(docs, "text")
    whole = dictionary.word_fingerprint
    monkeypatch.setattr(dictionary, "word_fingerprint", lambda w, salt: F.length(w).cast("bigint") if salt < 2 else whole(w, salt))
    words_ = WordDictionary(vocab)
    assert words_.salt == 2
    got = {r["id"]: r["ids"] for r in tokens.encode(docs, "id", "text", words_).collect()}
    known = vocabulary(TEXTS, 1000)
    assert got[0] == [known[w] for w in words(TEXTS[0])]


def test_rare_words_move_without_texts(spark, docs, plan):
    """Beyond what is shipped, fingerprints and ids are shuffled, never texts."""
    vocab = tokens.build_vocab(docs, "text", 9)
    encoded = tokens.encode(docs, "id", "text", WordDictionary(vocab, 36))
    assert "text" not in " ".join(line for line in plan(encoded).splitlines() if "Exchange" in line)


def test_open_words_meet_their_entries_once_a_group(spark, plan, monkeypatch):
    """Beyond what is shipped no word moves by its place; null and repeated keys are rows like others, whatever the groups."""
    from prefweave.operators import dictionary

    rows = [(1, "a b a a"), (2, "d"), (None, "b b d"), (None, "c zz"), (3, ""), (4, None), (5, "c b"), (5, "a zz d d")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    vocab = spark.createDataFrame([(w, i + 3) for i, w in enumerate("abcd")], "token string, id int")
    ids = {w: i + 3 for i, w in enumerate("abcd")}
    wanted = [(i, None if t is None else [ids.get(w, 1) for w in t.split()]) for i, t in rows]
    for group in (1, dictionary.GROUP_BYTES):
        monkeypatch.setattr(dictionary, "GROUP_BYTES", group)
        encoded = tokens.encode(df, "id", "text", WordDictionary(vocab, 60))
        told = plan(encoded)
        assert "posexplode" not in told and "collect_list" not in told
        assert sorted(((r["id"], r["ids"]) for r in encoded.collect()), key=str) == sorted(wanted, key=str)
    empty = tokens.encode(df.filter("false"), "id", "text", WordDictionary(vocab, 0))
    assert empty.count() == 0 and empty.columns == ["id", "ids"]


def test_batches_are_bounded_by_bytes(spark, docs):
    WordDictionary(tokens.build_vocab(docs, "text"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_encode_without_vocabulary(spark, docs):
    empty = spark.createDataFrame([], "token string, id int")
    got = {r["id"]: r["ids"] for r in tokens.encode(docs, "id", "text", empty, 3).collect()}
    assert got[3] is None and got[2] == [] and set(got[0]) == {tokens.UNKNOWN_ID}


def test_a_join_moves_each_word_of_a_group_once(spark, plan):
    """Words meet the vocabulary once a group; repeated and null keys, empty texts and an empty vocabulary are as before."""
    rows = [(1, "a b a a"), (2, "a"), (None, "b b"), (3, ""), (4, None), (5, "c b"), (5, "a zz d")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    vocab = spark.createDataFrame([(w, i + 3) for i, w in enumerate("abcd")], "token string, id int")
    encoded = tokens.encode_by_join(df, "id", "text", vocab)
    told = plan(encoded)
    assert "posexplode" not in told and "collect_list" not in told
    wanted = [(1, [3, 4, 3, 3]), (2, [3]), (None, [4, 4]), (3, []), (4, None), (5, [3, 5, 1, 4, 6]), (5, [3, 5, 1, 4, 6])]
    assert sorted(((r["id"], r["ids"]) for r in encoded.collect()), key=str) == sorted(wanted, key=str)
    none = tokens.encode_by_join(df.filter("id < 4"), "id", "text", vocab.limit(0)).collect()
    assert {r["id"]: r["ids"] for r in none} == {1: [1] * 4, 2: [1], 3: []}
    assert tokens.encode_by_join(df.filter("id = 4"), "id", "text", vocab).first()["ids"] is None


def test_marker_is_encoded_like_text(spark):
    df = spark.createDataFrame([(1, "x ### Assistant: y"), (2, "the assistant said")], "id int, text string")
    vocab = tokens.build_vocab(df, "text")
    tag = tokens.marker_ids(vocab)
    ids = {r["id"]: r["ids"] for r in tokens.encode(df, "id", "text", vocab).collect()}
    assert ids[1][1:-1] == tag and len(tag) == 5


def test_tokenize_pairs(spark, docs):
    pairs = [(i, "p", a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    df = spark.createDataFrame(pairs, "pair_id int, prompt string, chosen_story string, rejected_story string")
    vocab = tokens.build_vocab(docs, "text")
    known = vocabulary(TEXTS, 100)
    got = {r["pair_id"]: r for r in tokens.tokenize_pairs(df, vocab, max_length=5, pad_with=2).collect()}

    def arrays(text):
        if text is None:
            return None, None
        ids = [known[w] for w in words(text)][:5]
        return ids + [2] * (5 - len(ids)), [1] * len(ids) + [0] * (5 - len(ids))

    assert len(got) == len(pairs)
    for i, _, a, b in pairs:
        row = got[i]
        assert (row["input_ids_chosen"], row["attention_mask_chosen"]) == arrays(a)
        assert (row["input_ids_rejected"], row["attention_mask_rejected"]) == arrays(b)


def test_truncation_report(spark):
    rows = [("x ### Assistant: y",), ("the assistant said a b ### Assistant: y",), ("none",), (None,), ("a b c",)]
    df = spark.createDataFrame(rows, "text string")
    assert tokens.truncation_report(df, "text", 6).first().asDict() == {
        "total_rows": 5, "rows_without_text": 1, "rows_cut": 2, "rows_without_marker": 3,
    }


def test_nothing_is_exploded_or_shuffled(docs, plan):
    from prefweave.durable import durable

    vocab = durable(tokens.build_vocab(docs, "text"))
    pairs = docs.select(F.col("id").alias("pair_id"), F.col("text").alias("chosen_story"), F.col("text").alias("rejected_story"))
    for encoded in (tokens.encode(durable(docs), "id", "text", vocab), tokens.encode_pairs(durable(pairs), vocab)):
        assert "Generate" not in plan(encoded) and "Exchange" not in plan(encoded)


def test_prepare_pairs(spark, docs, tmp_path):
    rows = [(i, "p", TEXTS[i % 7], TEXTS[(i + 1) % 7]) for i in range(30)]
    df = spark.createDataFrame(rows, "pair_id int, prompt string, chosen_story string, rejected_story string")
    vocab = tokens.build_vocab(docs, "text")
    ready = prepare_pairs(df, df.filter("pair_id < 10"), vocab, "org/model", "here", str(tmp_path), max_length=6)
    assert {r["split"]: r["rows"] for r in ready.sizes().collect()} == {"train": 30, "validation": 10, "test": 10}
    assert set(V.TOKEN_FIELDS) <= set(ready.train.columns)
    assert all(r["n"] == 6 for r in ready.test.select(F.size("input_ids_chosen").alias("n")).filter("n >= 0").collect())
    again = prepare_pairs(df.filter("false"), df.filter("pair_id < 10"), vocab, "org/model", "here", str(tmp_path), max_length=6)
    assert again.train.count() == 30  # from the cache
    # Another vocabulary is another key: its ids, not those of the first.
    shifted = vocab.withColumn("id", F.col("id") + 100)
    other = prepare_pairs(df, df.filter("pair_id < 10"), shifted, "org/model", "here", str(tmp_path), max_length=6)
    first = lambda ready: {r["pair_id"]: r["input_ids_chosen"] for r in ready.train.collect()}
    ours, theirs = first(ready), first(other)
    assert all(a is None or [x + 100 if x else x for x in a] == theirs[i] for i, a in ours.items())
    with pytest.raises(ValueError, match="rejected_story"):
        prepare_pairs(df.drop("rejected_story"), df, vocab, "m", "here")
