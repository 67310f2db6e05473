"""Secrets in versioned blobs, each scanned once per rule.

Every version of every path is addressed by the SHA-256 of its content. A ledger says which
rule versions a blob has been scanned with and what they found; only pairs of blob and rule
that are not in it are scanned. Findings are then joined to all paths that ever held the blob.
Built-in functions only: equal contents meet in one aggregation that already combines them
before the shuffle, and places come from running sums of lengths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.llm.spans import match_ends
from gradeline.runtime import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` is the part of the match that needs `least` characters; a match
    that fails is dropped after matching, so it still covers its place."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind} {self.pattern} {self.group} {self.least}".encode()).hexdigest()[:16]


# Order is the order of kinds; the first three are the base.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,30}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,version:string>>"


def _found(text: Column, rule: Rule, rank: int, matches: Column, groups: Column, ends: Column) -> Column:
    spans = F.zip_with(
        F.arrays_zip(matches.alias("m"), groups.alias("g")),
        ends,
        lambda x, end: F.struct(
            (end - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.length(x["g"]).alias("size"),
        ),
    )
    kept = F.filter(spans, lambda s: s["size"] >= rule.least)
    return F.transform(kept, lambda s: s.dropFields("size")).cast(FINDINGS)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, versions, findings) of (blob, text, seen): the rules not yet seen, and what they find."""
    nothing = F.array().cast("array<string>")
    df = blobs.select("blob", "text", F.coalesce("seen", nothing).alias("seen"))
    for i, rule in enumerate(rules):
        due = ~F.array_contains("seen", rule.version)
        every = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        df = df.withColumn(f"m{i}", F.when(due, every).otherwise(nothing))
    for i, rule in enumerate(rules):
        groups = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.col(f"m{i}")
        hit = F.size(f"m{i}") > 0
        ends = match_ends(F.col("text"), F.lit(rule.pattern), F.col(f"m{i}"))
        df = df.withColumn(f"g{i}", F.when(hit, groups)).withColumn(f"e{i}", F.when(hit, ends))
    parts = [
        F.when(F.size(f"m{i}") > 0, _found(F.col("text"), rule, i, F.col(f"m{i}"), F.col(f"g{i}"), F.col(f"e{i}"))).otherwise(
            F.array().cast(FINDINGS)
        )
        for i, rule in enumerate(rules)
    ]
    new = F.array_except(F.array(*[F.lit(r.version) for r in rules]), "seen")
    return df.select("blob", new.alias("versions"), F.array_sort(F.concat(*parts)).alias("findings"))


def scan_history(
    history: DataFrame,
    path_col: str = "doc_id",
    text_col: str = "text",
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """((path, blob, findings) per row of the history, new ledger rows).

    Findings are sorted by start, then by the order of rules, in code points with the end
    excluded. A ledger has rows (blob, versions, findings) of earlier runs in any number, repeated ones too; save
    the new rows with it. Findings of rules that are no longer asked for are left out. Null
    texts are the empty blob, which holds nothing; null and repeated paths are rows like any
    other; an empty history gives an empty result.
    """
    blob = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("blob")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    blobs = history.select(blob, text).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        unseen = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
        asked = F.array(*[F.lit(r.version) for r in rules])
        unseen = blobs.join(seen, "blob", "left").where(
            F.col("seen").isNull() | (F.size(F.array_except(asked, F.col("seen"))) > 0)
        )
    new = written(scan_blobs(unseen, rules), "ledger")
    every = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    asked = [r.version for r in rules]
    known = every.where(F.size("findings") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
    known = known.withColumn("findings", F.array_sort(F.filter("findings", lambda f: f["version"].isin(asked))))
    paths = history.select(F.col(f"`{path_col}`").alias("path"), blob).join(known, "blob", "left")
    return paths.select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")), new


def digest_columns(found: DataFrame) -> DataFrame:
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("findings")).alias("spans")
    )


def oracle_sql() -> str:
    """The same columns in SQL, for ids that are unique."""
    kinds = []
    for i, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {i} AS rank, '{rule.kind}' AS kind, len(m) AS size, len(g) AS part, "
            f"{rule.least} AS least, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM ("
            f"SELECT doc_id, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {rule.group})) AS g, "
            f"unnest(regexp_split_to_array(t, '{p}')) AS gap, unnest(range(len(regexp_split_to_array(t, '{p}')))) AS i FROM d) WHERE m IS NOT NULL"
        )
    told = "string_agg(kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - size, rank)"
    names = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
        f"s AS ({' UNION ALL '.join(kinds)}), f AS (SELECT doc_id, {counts}, {told} FILTER (kind IN ({names})) AS base, "
        f"{told} AS spans FROM s WHERE part >= least GROUP BY doc_id) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, "
        "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"
    )
