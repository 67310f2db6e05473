"""From the ranked item table to the node and link records of the rank-flow network."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeline.operators.links import Chain, node_table, rank_flow
from gradeline.roles import DEFAULT_ROLES, Roles
from gradeline.runtime import settle
from gradeline.sources.json_records import write_json_document


def network(
    items: DataFrame, chain: Chain, roles: Roles = DEFAULT_ROLES, excluded: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(nodes, links of all adjacent pairs)."""
    return node_table(items, chain, roles), rank_flow(items, chain, roles, excluded)


def write_network(
    items: DataFrame,
    chain: Chain,
    path: str,
    roles: Roles = DEFAULT_ROLES,
    excluded: tuple[str, ...] = (),
) -> None:
    """One document: the nodes, then one array of links per adjacent pair."""
    nodes, links = network(settle(items), chain, roles, excluded)
    sections = [(nodes, ["order", "item_rank", roles.item, "link_type"])]
    for pair in range(1, len(chain)):
        one = links.filter(F.col("pair") == pair).drop("pair")
        sections.append((one, [roles.item]))
    write_json_document(sections, path)
