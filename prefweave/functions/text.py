"""String expressions: forum fields, prompts, answers, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefweave import fixed_values as V

# Runs of letters, runs of digits, and every other character by itself, but for blanks and control characters.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\p{Z}\p{C}]"


def strip(text: Column) -> Column:
    """Cut Unicode white space off both ends, as Python's str.strip does (Spark's trim cuts only blanks)."""
    return F.btrim(text, F.lit(V.WHITESPACE))


def author_text(author: Column) -> Column:
    """B4. Author as text; a deleted author becomes the word None."""
    return F.coalesce(author.cast("string"), F.lit(V.MISSING_AUTHOR))


def is_top_level(parent_id: Column) -> Column:
    """B5. True when the parent is the post itself."""
    return parent_id.startswith(V.POST_PREFIX)


def valid_id(comment_id: Column) -> Column:
    """B7. Predicate that keeps ids worth looking up; the schema already makes them strings."""
    return comment_id.isNotNull()


def is_complete(chosen: Column, rejected: Column) -> Column:
    """B11. True when both stories are there; an empty story counts as being there."""
    return chosen.isNotNull() & rejected.isNotNull()


def template_for(model_name: str, cot: bool) -> str:
    """G1. Short template for llama models, long one for all others, with or without the reasoning line."""
    if "llama" in model_name.lower():
        return V.SHORT_PROMPT_WITH_REASONING if cot else V.SHORT_PROMPT_VERDICT_ONLY
    return V.LONG_PROMPT_WITH_REASONING if cot else V.LONG_PROMPT_VERDICT_ONLY


def user_prompt(story_a: Column, story_b: Column, template: str) -> Column:
    """G2. Fill both story slots in one concat, so that braces or percent signs in a story stay as they are.

    A missing story reads as the word None. The template has text on both ends, so only its own outer
    white space can be stripped, and that happens on the literals.
    """
    head, rest = template.split("{story_a}")
    middle, tail = rest.split("{story_b}")
    missing = F.lit("None")
    return F.concat(
        F.lit(head.lstrip()),
        F.coalesce(story_a, missing),
        F.lit(middle),
        F.coalesce(story_b, missing),
        F.lit(tail.rstrip()),
    )


def rationale_text(rationale: Column) -> Column:
    """G3. Stripped rationale that starts with "Reasoning: " unless it already has that word in any case."""
    text = strip(rationale)
    prefixed = F.lower(F.substring(text, 1, 10)) == "reasoning:"
    return F.when(prefixed, text).otherwise(F.concat(F.lit("Reasoning: "), text))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, runs of digits, and single signs, in order; null for null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_list(text: str) -> list[str]:
    """The same for a plain ASCII string of the driver, such as a marker."""
    return re.findall(r"[a-z]+|[0-9]+|[!-/:-@\[-`{-~]", text.lower())


def python_bool_text(flag: Column) -> Column:
    """A boolean the way pandas writes it to CSV."""
    return F.when(flag, "True").when(~flag, "False")


def python_float_text(number: Column) -> Column:
    """A double the way pandas writes it to CSV: 1704067200.0, not 1.7040672E9."""
    whole = (F.floor(number).cast("double") == number) & (F.abs(number) < 1e15)
    return F.when(whole, F.concat(number.cast("bigint").cast("string"), F.lit(".0"))).otherwise(
        number.cast("string")
    )
