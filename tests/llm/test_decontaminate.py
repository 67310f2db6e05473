import random

import pytest

from gradeline.llm import decontaminate


def near(item, text):
    """Smallest edit distance of the item to any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], ["q"], [chars[k], "q"]])
    return "".join(chars)


def test_matches_brute_force(spark, make):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(8, 20))) for _ in range(12)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(30)]
        item = items[i % len(items)]
        own[10:10] = [edited(rng, item, rng.randrange(0, 2 + len(item) // 16)).upper().replace(" ", " \n")] if i % 3 else []
        rows.append((i, " ".join(own)))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(99, items[0]), (50, "too short"), (51, None), (None, items[1])], "item_id long, text string")
    got = {(r.id, r.item): r.distance for r in decontaminate.find_items(make(rows), bench).collect()}
    want = {}
    for i, t in rows:
        for k, item in [*enumerate(items), (99, items[0]), (None, items[1])]:
            d = near(decontaminate.normal(item), decontaminate.normal(t))
            if d <= int(len(item) * decontaminate.EDIT_SHARE):
                want[i, k] = d
    assert set(got) == set(want) and all(want[k] == got[k] for k in want)


def test_several_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 50)
    items = [" ".join(f"{c}{k}" for k in range(12)) for c in "abc"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, "x " + items[0] + " y " + items[2]), (2, "nothing"), (None, items[1]), (3, None), (4, ""), (5, items[0]), (5, items[0])]
    got = sorted((r.id or 0, r.item) for r in decontaminate.find_items(make(rows), bench).collect())
    assert got == [(0, 1), (1, 0), (1, 2), (5, 0), (5, 0)]
    kept = decontaminate.drop_contaminated(make(rows), bench)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(make([(1, "a")]), none).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.find_items(make([]), some).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
    assert decontaminate.nearest(decontaminate.masks(item), len(item), text)[0] == near(item, text)


def test_repeated_pieces_and_refrains_match_brute_force():
    rng = random.Random(11)
    refrain = "and so the river sings "
    items = [refrain * 4 + "until the morning comes", "_____ is to " * 5 + "_____ what is to come", "one or two or " * 6 + "three"]
    items = [decontaminate.normal(item) for item in items]
    block = decontaminate.Block([(item, [k]) for k, item in enumerate(items)], decontaminate.EDIT_SHARE)
    hits = 0
    for i in range(400):
        item = items[i % 3]
        text = decontaminate.normal(edited(rng, item, rng.randrange(1, 6)))
        parts = [item[a : a + rng.randrange(20, 60)] for a in (rng.randrange(40), rng.randrange(40))]
        text = f"{parts[0]} {text} {parts[1]}"
        want = {k: near(x, text) for k, x in enumerate(items) if near(x, text) <= int(len(x) * decontaminate.EDIT_SHARE)}
        assert {k: d for k, (d, _) in block.find(text).items()} == want
        hits += len(want)
    assert hits > 100


def test_a_later_repeat_of_a_piece_is_verified():
    item = "abcdefgh " * 2 + "ijklmno " + "abcdefgh " * 2 + "qrstuv wx yz"
    budget = int(len(item) * decontaminate.EDIT_SHARE)
    block = decontaminate.Block([(item, [0])], decontaminate.EDIT_SHARE)
    assert budget == 2
    text = "c" + item[1:20] + "#" + item[21:]
    assert block.find("x" * 60 + text)[0][0] == near(item, text) == 2


def test_short_items_match_exactly_as_whole_words(spark, make):
    bench = spark.createDataFrame([(1, "What is  Ohm"), (2, " ")], "item_id long, text string")
    rows = [(1, "so: what is ohm?"), (2, "what is ohmic"), (3, "what was ohm"), (4, "what is ohmic or what is ohm")]
    got = {(r.id, r.item, r.distance) for r in decontaminate.find_items(make(rows), bench).collect()}
    assert got == {(1, 1, 0), (4, 1, 0)}
