"""Chat examples for supervised tuning: prompt, marker, answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.functions.text import rationale_text, strip, template_for, user_prompt
from prefweave.operators.sampling import exact_split


def raw_label(df: DataFrame) -> Column:
    """The label before its check. The fallback goes by column, not by value: a null in `preferred` stays a null."""
    for name in ("preferred", "chosen_story"):
        if name in df.columns:
            return strip(F.col(name))
    return F.lit("")


def label_is_valid(df: DataFrame) -> Column:
    return F.coalesce(raw_label(df).isin("A", "B"), F.lit(False))


def label_text(df: DataFrame, on_bad: str = "quarantine") -> Column:
    """G4. The label, A or B. Any other value is null (`quarantine`) or fails the job, naming the value (`raise`)."""
    label = raw_label(df)
    valid = F.when(label_is_valid(df), label)
    if on_bad == "quarantine":
        return valid
    if on_bad != "raise":
        raise ValueError("on_bad must be 'quarantine' or 'raise'")
    found = F.concat(F.lit("Label must be 'A' or 'B', got: "), F.coalesce(label, F.lit("null")))
    return F.when(label_is_valid(df), label).otherwise(F.raise_error(found))


def rationale_column(df: DataFrame) -> Column:
    """G3 on a table; without the column the rationale is empty."""
    return rationale_text(F.col("rationale") if "rationale" in df.columns else F.lit(""))


def answer_cot(df: DataFrame, on_bad: str = "quarantine") -> Column:
    """G5. Reasoning, then verdict."""
    return F.concat(rationale_column(df), F.lit("\nPreferred: "), label_text(df, on_bad))


def answer_direct(df: DataFrame, on_bad: str = "quarantine") -> Column:
    """G6. Verdict only."""
    return F.concat(F.lit("Preferred: "), label_text(df, on_bad))


def bad_rows(df: DataFrame, cot: bool) -> DataFrame:
    """The rows that cannot be rendered: no valid label or, where reasoning is asked for, a null rationale."""
    bad = ~label_is_valid(df)
    if cot and "rationale" in df.columns:
        bad = bad | F.col("rationale").isNull()
    return df.filter(bad)


def chat_examples(
    df: DataFrame, model_name: str, cot: bool, on_bad: str = "raise", keep: tuple[str, ...] = ()
) -> DataFrame:
    """G7. text and response_marker of each row, after the columns to `keep`.

    Rows of `bad_rows` fail the job; with `quarantine` they are left out instead, and can be had from there.
    """
    prompt = user_prompt(F.col("story_a"), F.col("story_b"), template_for(model_name, cot))
    answer = answer_cot(df, on_bad) if cot else answer_direct(df, on_bad)
    if on_bad == "raise" and cot:
        answer = F.coalesce(answer, F.raise_error(F.lit("rationale is null")))
    text = F.concat(prompt, F.lit(f"\n\n{V.RESPONSE_MARKER}\n"), answer)
    examples = df.select(*keep, text.alias("text"), F.lit(V.RESPONSE_MARKER).alias("response_marker"))
    return examples.filter(F.col("text").isNotNull()) if on_bad == "quarantine" else examples


def sft_splits(
    df: DataFrame,
    model_name: str,
    cot: bool,
    key: str = "row_id",
    test_size: float = V.TEST_SIZE,
    seed: int = V.SPLIT_SEED,
    on_bad: str = "raise",
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """G8. (train, validation) chat examples of a rationale table; the split comes before the rendering."""
    train, validation = exact_split(df, key, test_size, seed)
    return (
        chat_examples(train, model_name, cot, on_bad, keep),
        chat_examples(validation, model_name, cot, on_bad, keep),
    )
