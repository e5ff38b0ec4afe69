"""Column expressions against plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.functions import arrays, text
from prefweave.operators.tokens import pad_id

STORIES = [
    "plain", "", "holds {story_b} and {story_a}", "100 % %s %d", "### Assistant: me", "back\\slash $1 \\1", "  lead ",
    "a ", "line\nbreak", None,
]


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_whitespace_is_pythons():
    assert set(V.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip(spark):
    values = [f"{w}a{w}b{w}" for w in V.WHITESPACE] + ["", " ", "​kept​", "\n　x\x1c"]
    assert one(spark, values, "string", text.strip) == [v.strip() for v in values]


@pytest.mark.parametrize("model", ["meta-llama/Llama-3.2-1B", "some-LLAMA", "Qwen/Qwen2.5"])
@pytest.mark.parametrize("cot", [True, False])
def test_user_prompt(spark, model, cot):
    template = text.template_for(model, cot)
    assert ("Reasoning:" in template) == cot
    assert template.startswith("Evaluate") == ("llama" in model.lower())
    pairs = [(a, b) for a in STORIES for b in STORIES]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(text.user_prompt(F.col("a"), F.col("b"), template)).collect()]
    assert got == [template.format(story_a=a, story_b=b).strip() for a, b in pairs]


def test_rationale_text(spark):
    values = ["REASONING: x", "reasoning:x", "Reasoning : x", "\n reasoning: y", " z ", "", "  ", "reason", "Reasoning:"]
    wanted = [
        v.strip() if v.strip().lower().startswith("reasoning:") else f"Reasoning: {v.strip()}" for v in values
    ]
    assert one(spark, values, "string", text.rationale_text) == wanted


def test_author_and_parent(spark):
    assert one(spark, ["ann", None, ""], "string", text.author_text) == ["ann", "None", ""]
    assert one(spark, ["t3_p", "t1_c", "xt3_", None], "string", text.is_top_level) == [True, False, False, None]


def test_python_numbers(spark):
    values = [1704067200.0, 0.97, -3.0, 0.0, 1.5, None]
    got = one(spark, values, "double", text.python_float_text)
    assert got == ["1704067200.0", "0.97", "-3.0", "0.0", "1.5", None]
    assert one(spark, [True, False, None], "boolean", text.python_bool_text) == ["True", "False", None]


IDS = [None, [], [1], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5], [0, 0]]


@pytest.mark.parametrize("side", ["right", "left"])
def test_pad_and_mask(spark, side):
    def padded(ids, fill):
        if ids is None:
            return None
        kept, filler = ids[:4], [fill] * (4 - len(ids[:4]))
        return kept + filler if side == "right" else filler + kept

    got = one(spark, IDS, "array<int>", lambda c: arrays.pad(c, 4, 0, side))
    assert got == [padded(ids, 0) for ids in IDS]
    masks = one(spark, IDS, "array<int>", lambda c: arrays.attention_mask(c, 4, side))
    assert masks == [None if ids is None else padded([1] * len(ids), 0) for ids in IDS]


def last_marker(ids, tag):
    places = [i for i in range(len(ids) - len(tag) + 1) if ids[i : i + len(tag)] == tag]
    return places[-1] + 1 if places else None


def labelled(ids, tag):
    place = last_marker(ids, tag)
    start = len(ids) if place is None else place - 1 + len(tag)
    return [V.IGNORED_LABEL] * start + ids[start:]


def test_markers_and_labels(spark):
    tag = V.RESPONSE_MARKER_IDS
    rows = [[], [1], tag, [5, *tag, 6], [*tag, 7, *tag, 8], [tag[0]], [tag[1], tag[0]], [9, *tag], [tag[0], *tag, 1]]
    assert one(spark, [*rows, None], "array<int>", arrays.find_subsequence) == [last_marker(r, tag) for r in rows] + [None]
    assert one(spark, [*rows, None], "array<int>", arrays.answer_labels) == [labelled(r, tag) for r in rows] + [None]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=20, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=3))
def test_labels_of_any_row(spark, rows, tag):
    assert one(spark, rows, "array<int>", lambda c: arrays.find_subsequence(c, tag)) == [last_marker(r, tag) for r in rows]
    assert one(spark, rows, "array<int>", lambda c: arrays.answer_labels(c, tag)) == [labelled(r, tag) for r in rows]


def test_pad_id():
    assert pad_id("end_of_text") == 2 and pad_id("add") == 0
    assert pad_id("end_of_text", pad=7) == 7 and pad_id("add", pad=2) == 2
    with pytest.raises(ValueError):
        pad_id("other")


def test_step_of(spark):
    assert one(spark, [0, 15, 16, 33], "bigint", lambda c: arrays.step_of(c, 16)) == [0, 0, 1, 2]
