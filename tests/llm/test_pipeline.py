import random

import corpus_pipeline
import pytest
from gradeline.llm import decontaminate, near_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, passages, leaks and toxic texts, as the tables of a corpus."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ou", "ing", "st"]) for _ in range(3)) + str(rng.randrange(99))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = {}, []
    for i in range(400):
        rows[i] = text(80)
        if i % 4 == 0:
            rows[i] += " you idiot " + text(3)
        labels.append((i, 0, int(i % 4 == 0)))
    passage, item = text(60), text(14)
    rows |= {1000: text(40) + " " + passage, 1001: passage + " " + text(70), 1002: text(50) + " " + passage + " " + text(9)}
    rows |= {1100: text(300)}
    rows |= {1101: rows[1100], 1102: rows[1100].replace(rows[1100].split()[150], "other"), 1200: text(20) + " " + item.upper() + " " + text(30)}
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "a" if i % 3 else None, len(t)) for i, t in rows.items()] + [(5000, None, None, None, None), (5001, "", "en", "b", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return f"file://{path}", rows, passage


def test_each_stage_takes_effect_and_spares_the_clean(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), "stage")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "mixing" or docs.columns == columns
    clean = {i for i in rows if i < 400 and i % 4}
    assert set(kept["toxicity"]) == clean | {i for i in rows if i >= 1000} | {5000, 5001}
    cut = kept["line dedup"]
    assert set(cut) == set(kept["toxicity"]) and all(cut[i].text == rows[i] for i in clean | {1000, 1101, 1102})
    assert sum(w in cut[1001].text.split() for w in passage.split()) <= 30 and cut[1001].n_chars == len(cut[1001].text)
    assert set(kept["near dedup"]) == set(cut) - {1101, 1102}
    assert set(kept["decontamination"]) == set(kept["near dedup"]) - {1200}
    mixed = kept["mixing"]
    assert docs.columns == [*columns, "copies", "taken"] and set(mixed) <= set(kept["decontamination"])
    assert all(1 <= r.copies <= 3 for r in mixed.values())


def test_run_equals_the_stages(spark, folder):
    path, rows, _ = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()}
    assert got and got <= set(rows) | {5000, 5001}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    assert near_dedup.SHARE == 75 and decontaminate.EDIT_SHARE <= 0.1
