"""Classification ladders. NULL in gives NULL out, never the lowest band."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cut-points and labels of the published scales.
PERFORMANCE_LEVELS = ["Advanced", "High", "Intermediate", "Low", "Below Low"]
COLLAPSED_PERFORMANCE_LEVELS = ["High", "Intermediate", "Low"]
DIFFICULTY_LEVELS = ["Really Easy", "Easy", "Normal", "Difficult", "Really Difficult"]
COLLAPSED_DIFFICULTY_LEVELS = ["Easy", "Normal", "Difficult"]
PERFORMANCE_CUTS = [625, 550, 475, 400]
DIFFICULTY_CUTS = [0.9, 0.66, 0.33, 0.1]
AGE_CUTS = [2, 1, -1, -2]
AGE_LEVELS = ["Much Older", "Older", "Average", "Younger", "Much Younger"]


def ladder(
    value: Column, cuts: list, labels: list[str], first_inclusive: bool = False
) -> Column:
    """Label by the first cut the value lies above; the last label takes the rest."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for position, (cut, label) in enumerate(zip(cuts, labels)):
        above = value >= cut if first_inclusive and position == 0 else value > cut
        out = out.when(above, label)
    return out.otherwise(labels[-1])


def performance_band(score: Column, suffix: str = "") -> Column:
    """Score band; the top cut is inclusive, the others are strict."""
    labels = [level + suffix for level in PERFORMANCE_LEVELS]
    return ladder(score, PERFORMANCE_CUTS, labels, first_inclusive=True)


def difficulty_band(ratio: Column) -> Column:
    return ladder(ratio, DIFFICULTY_CUTS, DIFFICULTY_LEVELS)


def age_band(deviation: Column) -> Column:
    return ladder(deviation, AGE_CUTS, AGE_LEVELS)


def collapse(value: Column, mapping: dict[str, str]) -> Column:
    """Rename the mapped levels and leave all others alone."""
    out = F.when(F.lit(False), value)
    for old, new in mapping.items():
        out = out.when(value == old, new)
    return out.otherwise(value)


def collapse_performance(band: Column, suffix: str = "") -> Column:
    return collapse(
        band, {"Below Low" + suffix: "Low" + suffix, "Advanced" + suffix: "High" + suffix}
    )


def collapse_difficulty(band: Column) -> Column:
    return collapse(band, {"Really Easy": "Easy", "Really Difficult": "Difficult"})


def item_type(key: Column) -> Column:
    """Digit in the key: multiple choice; `SA` or `DPC_D`: free response."""
    return (
        F.when(key.isNull(), F.lit(None).cast("string"))
        .when(key.rlike(r"\d"), "Multiple Choice")
        .when(key.rlike("SA|DPC_D"), "Free Response")
        .otherwise("Other")
    )


def response_type(field_code: Column) -> Column:
    """Kind of a questionnaire field, read from its code list."""
    return (
        F.when(field_code.isNull(), F.lit(None).cast("string"))
        .when(field_code.contains("ID:VALUE"), "ID")
        .when(field_code.contains(":VALUE"), "Free-Response")
        .otherwise("Multiple-Choice")
    )


def dominant_group(gap: Column) -> Column:
    """Sign of the male minus female gap as a word."""
    return (
        F.when(gap > 0, "Male").when(gap < 0, "Female").when(gap == 0, "Tie")
    )
