import re
from collections import Counter

from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gradeline.llm import quality_rules as rules
from gradeline.llm.common import text_chunks

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    ends = [(re.findall(WORD, line)[0], re.findall(WORD, line)[-1]) for line in lines]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
        len(lines), sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words),
        sum(a[0] in "-*•" for a, _ in ends), sum(b.endswith(("...", "…")) for _, b in ends),
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "a b c d e f a b c d", "x x x x x x", "x x x x x", "- a\n- b\n- a\n* c\n• d…",
    "same line \nsame line \nsame line", "same\r\nsame", "a\n\n\na\n a\na ", "wait...\nmore …\n..\n…", "# * $ % & | < > a", "été où ça élan naïf " * 3,
    "\x0b\x0c a\x1cb   c d", "漢字 仮名 😀 😀", "word " * 12_000, "tail without newline\nthen", "a" * 300_000,
]


def measured(texts):
    out = []
    for _, _, data, bounds in text_chunks(pa.array(texts, pa.string())):
        out += [tuple(int(x) for x in row) for row in rules.measure(data, bounds)]
    return out


def test_measures_equal_brute_force():
    assert measured(TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\n .-•…\té#"), max_size=40), min_size=1, max_size=6))
def test_texts_side_by_side_do_not_mix(texts):
    assert measured(texts) == [brute(t) for t in texts]


def test_ledger_policies_and_ablations(spark, make):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (3, "one"), (3, "one")]
    docs = make(rows).withColumn("fail_bits", F.lit("theirs")).withColumn("n_words", F.lit(-1))
    ledger = rules.rule_ledger(docs)
    got = Counter((r["id"], *(r[m] for m in rules.MEASURES)) for r in ledger.collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)
    for r in ledger.collect():
        values = {m: r[m] for m in rules.MEASURES}
        want = sum(1 << i for i, rule in enumerate(rules.RULES) if eval(rule.failed, {}, values))
        assert r["fail_bits"] == want
    decided = rules.apply_policies(ledger, *rules.POLICIES.values()).collect()
    assert len(decided) == 3 * len(rows)
    assert all(r["kept"] == (r["failed_bits"] == 0) for r in decided)
    strict = {r["id"] for r in decided if r["version"] == "strict-1" and r["kept"]}
    assert strict <= {r["id"] for r in decided if r["version"] == "lenient-1" and r["kept"]}
    # An ablation says what the policy without the rule keeps.
    found = {r["rule"]: r for r in rules.ablations(ledger, rules.LENIENT).collect()}
    for name in rules.LENIENT.rules:
        without = rules.Policy("x", tuple(r for r in rules.LENIENT.rules if r != name))
        r = found[name]
        assert r["rows"] == len(rows) and r["kept"] == ledger.where(rules.kept(rules.LENIENT)).count()
        assert r["kept_without"] == ledger.where(rules.kept(without)).count() == r["kept"] + r["only"]
        assert r["failed"] == sum(bool(x["fail_bits"] & rules.bit(name)) for x in ledger.collect())
    parts = rules.ablations(ledger, rules.BASE, F.col("id") % 2).collect()
    assert sum(r["rows"] for r in parts if r["rule"] == "few_words") == len(rows)
    one = rules.group_bits(ledger, (F.col("id") < 0).alias("neg")).collect()
    assert sum(r["rows"] for r in one) == len(rows)


def test_empty_table(spark, make):
    ledger = rules.rule_ledger(make([]))
    assert ledger.count() == 0 and rules.ablations(ledger, rules.LENIENT).count() == 0
    assert rules.op11_columns(ledger).count() == 0


def test_clean_prose_stays_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    ledger = rules.op11_columns(rules.rule_ledger(spark.read.parquet(f"{folder}/documents.parquet")))
    found = ledger.where(~F.col("base_failed")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    shares = dict(found.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert shares[1] >= 0.99 and shares[0] <= 0.6
    assert not np.isnan(shares[1])
