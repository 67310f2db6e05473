"""Places of all matches of a pattern in a text, with built-in functions only.

Spark extracts the matches and splits at them, but gives no places. Pieces and matches
alternate, so a running sum of their lengths is where each match ends.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RUN = 256


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of longs.

    Appending copies what is already there, so sums run within blocks of a fixed length first
    and then over the blocks.
    """
    last = F.greatest(F.lit(1), F.ceil(F.size(numbers) / RUN).cast("int"))
    zero = F.array(F.lit(0).cast("long"))
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    blocks = F.transform(
        F.sequence(F.lit(0), last - 1), lambda b: F.aggregate(F.slice(numbers, b * RUN + 1, RUN), zero, add)
    )
    starts = F.aggregate(blocks, zero, lambda sums, b: F.concat(sums, F.array(F.element_at(sums, -1) + F.element_at(b, -1))))
    shifted = F.zip_with(
        blocks,
        F.slice(starts, 1, last),
        lambda b, start: F.transform(F.slice(b, 2, RUN), lambda x: x + start),
    )
    return F.flatten(shifted)


def match_ends(text: Column, pattern: Column, matches: Column) -> Column:
    """Where each match ends, in code points; `matches` are all matches of the pattern."""
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    lengths = F.zip_with(pieces, matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    return F.when(F.size(matches) > 0, running_sums(lengths)).otherwise(F.array().cast("array<bigint>"))
