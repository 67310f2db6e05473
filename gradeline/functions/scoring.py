"""Scoring of single answers and reading of answer keys out of item labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeline.functions.text import extract_first, replace_first

# Keys of multiple-choice items, first digits of accepted open answers,
# and the shape of a key inside a label. The blank belongs to the first alternative only.
CHOICE_KEYS = ["1", "2", "3", "4"]
ACCEPTED_OPEN = ["1", "2"]
LABEL_KEY = r"\(\d\)|\(\w\)"
LABEL_KEY_TO_STRIP = r" \(\d\)|\(\w\)"


def is_correct(answer: Column, key: Column) -> Column:
    """Choice items must equal the key; others are right when the code starts with 1 or 2.

    `answer` must be the integral code as text. A NULL key takes the open-answer branch.
    """
    accepted = F.substring(answer, 1, 1).isin(ACCEPTED_OPEN)
    return F.when(key.isin(CHOICE_KEYS), key == answer).otherwise(accepted)


def key_in_label(label: Column) -> Column:
    return extract_first(label, LABEL_KEY)


def strip_key(label: Column) -> Column:
    return replace_first(label, LABEL_KEY_TO_STRIP)
