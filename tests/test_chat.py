"""Chat examples on hand-made labels and rationales."""

import pytest
from pyspark.errors import PySparkException

from prefweave import fixed_values as V
from prefweave.operators import chat

LABELS = ["A", " B ", "C", "a", "", None, " A\n"]


def labelled(spark, labels=LABELS, column="preferred"):
    rows = [(i, "one {story_b}", "two", " why ", label) for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, f"row_id int, story_a string, story_b string, rationale string, {column} string")


@pytest.mark.parametrize("column", ["preferred", "chosen_story"])
def test_bad_labels_are_set_aside(spark, column):
    df = labelled(spark, column=column)
    good = {r["row_id"]: r["text"] for r in chat.chat_examples(df, "llama", False, "quarantine", keep=("row_id",)).collect()}
    assert set(good) == {0, 1, 6}
    assert good[1].endswith("\n\n### Assistant:\nPreferred: B")
    assert {r["row_id"] for r in chat.bad_rows(df, cot=False).collect()} == {2, 3, 4, 5}


def test_the_fallback_goes_by_column(spark):
    df = labelled(spark, [None, "A"]).selectExpr("*", "'B' AS chosen_story")
    assert [r["row_id"] for r in chat.chat_examples(df, "x", False, "quarantine", keep=("row_id",)).collect()] == [1]
    assert chat.chat_examples(labelled(spark).drop("preferred"), "x", False, "quarantine").count() == 0


def test_a_bad_label_fails_the_strict_job(spark):
    assert chat.chat_examples(labelled(spark, ["A", " B "]), "x", True).count() == 2
    with pytest.raises(PySparkException, match="got: C"):
        chat.sft_splits(labelled(spark, ["C"] * 8), "x", cot=False)[0].collect()
    with pytest.raises(PySparkException, match="got: C"):
        chat.chat_examples(labelled(spark, ["A", "C"]), "x", True, on_bad="raise").collect()
    with pytest.raises(PySparkException, match="got: null"):
        chat.chat_examples(labelled(spark, [None]), "x", False, on_bad="raise").collect()
    with pytest.raises(ValueError):
        chat.label_text(labelled(spark), "ignore")


def test_whole_text(spark):
    row = chat.chat_examples(labelled(spark, [" A"]), "Qwen", cot=True).first()
    prompt = V.LONG_PROMPT_WITH_REASONING.format(story_a="one {story_b}", story_b="two").strip()
    assert row["text"] == f"{prompt}\n\n### Assistant:\nReasoning: why\nPreferred: A"
    assert row["response_marker"] == "### Assistant:"


def test_missing_rationales(spark):
    df = labelled(spark, ["A"]).drop("rationale")
    assert chat.chat_examples(df, "x", cot=True).first()["text"].endswith("\nReasoning: \nPreferred: A")
    null = labelled(spark, ["A"]).selectExpr("row_id", "story_a", "story_b", "CAST(NULL AS STRING) AS rationale", "preferred")
    assert chat.chat_examples(null, "x", cot=True, on_bad="quarantine").count() == 0
    assert chat.bad_rows(null, cot=True).count() == 1 and chat.bad_rows(null, cot=False).count() == 0
    with pytest.raises(PySparkException):
        chat.chat_examples(null, "x", cot=True, on_bad="raise").collect()


def test_splits_stay_in_the_jvm(spark, plan):
    train, validation = chat.sft_splits(labelled(spark, ["A", "B"] * 20), "x", cot=True)
    assert (train.count(), validation.count()) == (38, 2)
    assert train.columns == ["text", "response_marker"]
    assert "Python" not in plan(train) and "Exchange" not in plan(train)
