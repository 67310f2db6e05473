"""Multi-label tagging of short texts from an ordered list of (tag, pattern) rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Mathematics topics and the patterns that reveal them in an item label.
MATH_TAG_RULES: list[tuple[str, str]] = [
    ("algabraic", r"ABC|AB|XY|BOC|PQR| \w | \d+\w| \d*\w+/\d+|A\+B|A-B|4\(3+x\)| \w$"),
    ("decimal", r"\d+\.\d+|DECIMAL"),
    ("fraction", r"\d+\w*/\d*\w*|FRACTION|FIFTH|HALF"),
    ("arithmetic", r"\+|-|/|PLUS"),
    ("comparison", r"MORE|LESS|THAN|SHORTER|EQUI|LOW|LONGEST|REDUCED"),
    ("time", r"YEAR|SPEED|TIME|MINUTES"),
    ("shape", r"SHAPE|CIRCLE|SQUARE|LINE|TRIANGLE|AREA|CUBES|PERIMETER|OCTAGON|FIG|PENTAGON"),
    ("area", r"AREA"),
    ("symmetry", r"SYMMETRY"),
    ("number", r"\d+ |NUMBER"),
    ("graph", r"CHART|GRAPH|SLOPE"),
    ("probability", r"LIKELY|PROBABILITY"),
    ("percent", r"PERCENT"),
    ("pattern", r"PATTERN"),
    ("angle", r" ANGLE"),
]
NO_TAG = "none"
_BETWEEN = "\x01"


def alternatives(pattern: str) -> list[str]:
    """The pattern at its top-level bars; a pattern with groups or classes stays whole."""
    plain = re.sub(r"\\.", "", pattern)
    if any(c in plain for c in "([{"):
        return [pattern]
    return re.findall(r"(?:\\.|[^|\\])+", pattern) or [pattern]


def literal(alternative: str) -> str | None:
    """The text that a pattern without wildcards stands for."""
    if re.search(r"\\\w", alternative) or any(c in re.sub(r"\\.", "", alternative) for c in ".^$*+?{}[]()|\\"):
        return None
    return re.sub(r"\\(.)", r"\1", alternative)


def occurs(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs: literals by search, and one expression of the other alternatives
    for texts in which no literal is found."""
    parts = alternatives(pattern)
    found = [text.contains(w) for w in map(literal, parts) if w is not None]
    wild = [p for p in parts if literal(p) is None]
    if wild:
        found.append(text.rlike("|".join(wild)))
    return reduce(lambda a, b: a | b, found)


def tag_array(text: Column, rules: list[tuple[str, str]] = MATH_TAG_RULES) -> Column:
    """All tags whose pattern occurs, in rule order; `[none]` when there is none."""
    hits = F.concat_ws(_BETWEEN, *[F.when(occurs(text, p), F.lit(tag)) for tag, p in rules])
    # No branch and no lambda around the rules: generated code prepares the text once for all.
    known = F.concat(hits, F.when(text.isNotNull(), F.lit("")))
    return F.split(F.regexp_replace(known, "^$", NO_TAG), _BETWEEN).cast("array<string>")


def tag_text(text: Column, rules: list[tuple[str, str]] = MATH_TAG_RULES) -> Column:
    return F.array_join(tag_array(text, rules), " ")


def tag_names(rules: list[tuple[str, str]] = MATH_TAG_RULES) -> list[str]:
    """Every tag a rule list can give, the empty marker included."""
    return list(dict.fromkeys(tag for tag, _ in rules)) + [NO_TAG]
