import random
import zlib

import numpy as np
import pytest

from gradeline.llm import toxicity

BAD = ["idiot", "moron", "loser"]


def sentences(rng, n):
    syllables = ["th", "er", "on", "an", "re", "id", "io", "ot", "mo", "lo", "se", "ti", "ha"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        text = sentences(rng, rng.randrange(20, 60))
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((i, " ".join(text), "n"))
        labels.append((i, 0, int(toxic)))
    hidden = {1000: "you 1D10T", 1001: "a l o s e r here", 1002: "m0rooon", 1003: "l.o.s.e.r", 1004: "M0R0N!", 1005: "on the 10th"}
    rows += [(i, t, "n") for i, t in hidden.items()] + [(None, "idiot", "n"), (2000, None, "n"), (2001, "", "n"), (2000, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels + [(1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), dict((r[0], r[1]) for r in rows)


def test_held_out_accuracy_and_disguises(table):
    docs, labels, text = table
    df = toxicity.scored(docs, labels)
    assert df.columns == ["doc_id", "text", "score", "held_out", "predicted"]
    got = {r.doc_id: r for r in df.collect()}
    assert df.count() == docs.count()
    for i in range(600):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == int(got[i].score >= 0.7) and 0 <= got[i].score <= 1
    wrong = sum(got[i].predicted != (i % 4 == 0) for i in range(600) if got[i].held_out)
    assert wrong <= 6
    assert [got[i].predicted for i in range(1000, 1006)] == [1, 1, 1, 1, 1, 0]
    assert got[None].predicted == 1 and got[2000].score == got[2001].score == toxicity.NO_EVIDENCE


def test_without_labels_or_rows(table):
    docs, labels, _ = table
    assert {r.score for r in toxicity.scored(docs.limit(9), labels.limit(0)).collect()} == {toxicity.NO_EVIDENCE}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_character_model_counts_every_text(spark):
    docs = spark.createDataFrame([("Aé b",), (None,), ("",)], "text string")
    costs = toxicity.character_model(docs)
    assert costs.shape == (toxicity.LETTERS,) * 3 and np.allclose(np.exp(-costs).sum(2), 1)


def test_restore_takes_the_likeliest_path():
    costs = np.full((toxicity.LETTERS,) * 3, 5.0)
    for a, b, c in zip([0, 0, *[ord(x) - 96 for x in "loser"]], [0, *[ord(x) - 96 for x in "loser"]], [*[ord(x) - 96 for x in "loser"], 0]):
        costs[a, b, c] = 0.1
    for word in ("l0$er", "|os3r", "looooser", "l-o-s-e-r", "1053r"):
        assert toxicity.restore(word, costs) == "loser"
    assert toxicity.restore("loss", costs) == "loss"
