"""Rank-flow network between countries and the tables behind the item charts.

A chain is the ordered list of (short code, country) from top to bottom; neighbours in
it are linked. It is a parameter, so any number of countries takes one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeline.functions.text import replace_all, title_case
from gradeline.operators.columns import keep_between
from gradeline.roles import DEFAULT_ROLES, Roles

Chain = list[tuple[str, str]]


def link_tags(chain: Chain) -> list[tuple[str, str]]:
    """(tag towards the top, tag towards the bottom) of every country in the chain."""
    codes = [code for code, _ in chain]
    down = [f"{lower}_{upper}" for upper, lower in zip(codes, codes[1:])]
    return list(zip(["top", *down], [*down, "bottom"]))


def node_table(
    items: DataFrame,
    chain: Chain,
    roles: Roles = DEFAULT_ROLES,
    titles: tuple[str, ...] = ("label", "content_domain", "cognitive_domain"),
) -> DataFrame:
    """Two rows per (country, item), one per link, with id, position and titled labels."""
    entries = [
        F.when(
            F.col(roles.country) == country,
            F.struct(
                F.lit(code).alias("code"),
                F.lit(position).alias("order"),
                F.lit(up).alias("link1"),
                F.lit(down).alias("link2"),
            ),
        )
        for position, ((code, country), (up, down)) in enumerate(
            zip(chain, link_tags(chain)), start=1
        )
    ]
    item = F.col(roles.item)
    placed = items.withColumn("place", F.coalesce(*entries)).filter(F.col("place").isNotNull())
    links = F.array(
        *[
            F.struct(
                F.lit(name).alias("link_type"),
                F.concat(item, F.lit("_"), F.col(f"place.{name}")).alias("link"),
            )
            for name in ("link1", "link2")
        ]
    )
    nodes = placed.select(
        *items.columns,
        F.concat(F.col("place.code"), F.lit("_"), item).alias("id"),
        F.col("place.order").alias("order"),
        F.inline(links),
    )
    return nodes.withColumns({c: title_case(F.col(c)) for c in titles if c in items.columns})


def edge_list(nodes: DataFrame, code: str, other: str) -> DataFrame:
    """Edges from every node id of one country to the same item of another."""
    ids = nodes.select("id").filter(F.col("id").startswith(f"{code}_")).distinct()
    return ids.select(
        F.col("id").alias("source"), replace_all(F.col("id"), code, other).alias("target")
    )


def rank_flow(
    items: DataFrame,
    chain: Chain,
    roles: Roles = DEFAULT_ROLES,
    excluded: tuple[str, ...] = (),
    rank: str = "item_rank",
) -> DataFrame:
    """Rank of each item on both sides of every adjacent pair (x1, x2, y1, y2).

    One aggregation by item covers all pairs. An item absent on one side has NULL there;
    an item absent on both sides has no row for that pair.
    """
    kept = items.filter(F.col(roles.country).isin([country for _, country in chain]))
    if excluded:
        kept = kept.filter(~F.col(roles.item).isin(list(excluded)))
    ranks = kept.groupBy(roles.item).agg(
        *[
            F.min(F.when(F.col(roles.country) == country, F.col(rank))).alias(f"r{i}")
            for i, (_, country) in enumerate(chain)
        ]
    )
    pairs = [
        F.struct(
            F.lit(i).alias("pair"),
            F.col(f"r{i - 1}").alias("x1"),
            F.col(f"r{i}").alias("x2"),
            F.lit(chain[i - 1][1]).alias("y1"),
            F.lit(chain[i][1]).alias("y2"),
        )
        for i in range(1, len(chain))
    ]
    return ranks.select(roles.item, F.inline(F.array(*pairs))).filter(
        F.col("x1").isNotNull() | F.col("x2").isNotNull()
    )


def bar_data(
    items: DataFrame, value: str, colour: str, low: float, high: float,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """Rank against value with a colour category; bars out of range are removed."""
    return keep_between(items, value, low, high).select(
        roles.country, roles.item, "item_rank", F.col(value).alias("value"),
        F.col(colour).alias("colour"),
    )


def scatter_data(items: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Ratio against gap with the columns used for labels, colours and shapes."""
    return items.select(
        roles.country, roles.item, "correct_ratio", "gap", "dominant_gender",
        "content_domain", "cognitive_domain",
    )
