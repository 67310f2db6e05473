"""Regular-expression and string helpers with first-match and NULL semantics spelled out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters, marks, digits and underscore form a word in every language of the input.
WORD_BREAK = r"[^\p{L}\p{M}\p{N}_]+"


def matches(value: Column, pattern: str) -> Column:
    """True where the pattern occurs anywhere in the value."""
    return value.rlike(pattern)


def replace_first(value: Column, pattern: str, replacement: str = "") -> Column:
    """Replace the first match only (`regexp_replace` replaces all); the replacement is literal.

    The text is cut at the first match, so the pattern keeps its own flags, dots and groups.
    """
    at = F.regexp_instr(value, F.lit(pattern))
    size = F.length(F.regexp_substr(value, F.lit(pattern)))
    cut = F.concat(F.substring(value, F.lit(1), at - 1), F.lit(replacement), F.substring(value, at + size, F.length(value)))
    return F.when(value.isNotNull() & (at > 0), cut).otherwise(value)


def replace_all(value: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(value, pattern, replacement)


def extract_first(value: Column, pattern: str) -> Column:
    """First match, NULL (not '') when there is none."""
    return F.regexp_substr(value, F.lit(pattern))


def join_text(*parts: Column | str) -> Column:
    """Concatenate; any NULL part makes the result NULL. Plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def title_case(value: Column) -> Column:
    """Capitalise after every non-word character, so `(x/y-z)` becomes `(X/Y-Z)`."""
    pieces = F.split(F.lower(value), r"(?<=[^\p{L}\p{M}\p{N}_'.])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def member(value: Column, allowed: list) -> Column:
    """Membership compared as text; NULL is a member of nothing."""
    return F.coalesce(value.cast("string").isin([str(a) for a in allowed]), F.lit(False))


def words(value: Column) -> Column:
    """Lower-cased words of a text as an array, without empty ones."""
    return F.filter(F.split(F.lower(value), WORD_BREAK), lambda w: w != "")


def percent(ratio: Column) -> Column:
    """Ratio as a percentage with two places (half up)."""
    return F.round(ratio * 100, 2)


def number_text(value: Column) -> Column:
    """Number as text without a trailing `.0`."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
