import random
import re
from pathlib import Path

from gradeline.llm import line_dedup
from gradeline.runtime import scratch_dir


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10**7)}" for _ in range(n)]


def corpus():
    rng = random.Random(3)
    passage, other = words(rng, 60), words(rng, 300)
    rows = {}
    for i in range(40):
        own = words(rng, 80)
        cut = rng.randrange(80)
        inside = passage if i % 2 else other if i % 5 == 0 else []
        rows[i] = (own[:cut], inside, own[cut:])
    return rows


def test_later_passages_go_and_nothing_else(make):
    rows = corpus()
    text = {i: "  ".join([*a, *p]) + "\n" + " ".join(b) for i, (a, p, b) in rows.items()}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make(text.items())).collect()}
    seen = set()
    for i, (a, p, b) in rows.items():
        left = got[i].text.split()
        if not p or tuple(p) not in seen:
            seen.add(tuple(p))
            assert got[i].text == text[i] and got[i].removed_words == 0
            continue
        own = [w for w in left if w not in set(p)]
        assert own == a + b
        # what stays are the outermost lines, which wrap with their surroundings
        assert len(left) - len(own) <= 30 and got[i].removed_words == len(p) - (len(left) - len(own))


def test_exact_copies_and_a_copy_share(make):
    rng = random.Random(4)
    one, passage = words(rng, 400), words(rng, 90)
    near = list(one)
    near[200] = "changed"
    rows = [(1, " ".join(one)), (2, " ".join(one)), (3, " ".join(near)), (4, " ".join(words(rng, 50) + passage)), (5, " ".join(words(rng, 50) + passage))]
    cut = {r.doc_id: r.removed_words for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert cut[1] == cut[4] == 0 and cut[2] == 400 and cut[3] > 350 and cut[5] > 70
    kept = {r.doc_id: r.removed_words for r in line_dedup.dedup_lines(make(rows), copy_share=0.6).collect()}
    assert kept[1] == kept[2] == kept[3] == kept[4] == 0 and kept[5] > 70


def test_a_copy_share_spares_no_repeats_within_a_document(make):
    rng = random.Random(5)
    passage, own = words(rng, 60), words(rng, 30)
    (got,) = line_dedup.dedup_lines(make([(1, " ".join(passage * 10 + own))]), copy_share=0.6).collect()
    left = got.text.split()
    assert left[:60] == passage and left[-30:] == own
    assert got.removed_words == 630 - len(left) and got.removed_words > 500


def test_only_near_duplicates_are_spared(make):
    rng = random.Random(8)
    passage, one, (p, q) = words(rng, 60), words(rng, 400), (words(rng, 200), words(rng, 60))
    near = list(one)
    near[200] = "changed"
    rows = {
        1: passage + words(rng, 10), 2: passage + words(rng, 25),
        3: one, 4: near, 5: one, None: one,
        # near-duplicates until what both have from another document is cut
        10: words(rng, 300) + p, 11: p + q + words(rng, 40), 12: p + q + words(rng, 40),
    }
    got = {r.doc_id: r.removed_words for r in line_dedup.dedup_lines(make([(i, " ".join(t)) for i, t in rows.items()]), spare_near=True).collect()}
    assert got[1] == got[3] == got[4] == got[5] == got[10] == 0
    assert got[2] > 30 and got[None] == 400
    assert 170 < got[11] <= 200 and got[12] > 210


def lines(text):
    (_, _, data, bounds), = line_dedup.text_chunks(line_dedup.pa.array([text]))
    return line_dedup.Lines(line_dedup.words_of(data, bounds))


def test_every_passage_of_46_words_holds_five_whole_lines():
    rng = random.Random(9)
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split()
    loops = [["the"], ["ja", "nein"], ["a", "b", "c", "d", "e", "f", "g"]]
    for k in range(200):
        vocabulary = loops[k % 8] if k % 8 < 3 else german
        passage = (vocabulary * 46)[:46] if k % 8 < 3 else [rng.choice(vocabulary) for _ in range(46)]
        found = []
        for _ in range(2):
            before, after = ([rng.choice(german) for _ in range(rng.randrange(30))] for _ in range(2))
            cut = lines(" ".join(before + passage + after))
            assert (cut.ends - cut.starts).max() <= line_dedup.SPAN
            found.append({int(key) for key in cut.fingerprints()[2]})
            inside = (cut.starts >= len(before)) & (cut.ends <= len(before) + 46)
            assert inside.sum() >= 5
        assert found[0] & found[1]


def test_loops_of_one_word_and_repeated_german_passages_go(make):
    rng = random.Random(10)
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split()
    passages = [[rng.choice(german) for _ in range(51)] for _ in range(60)]
    rows = [(1, " ".join(words(rng, 30) + ["the"] * 307 + words(rng, 30)))]
    rows += [(i, " ".join(words(rng, 20) + p + words(rng, 20))) for k, p in enumerate(passages) for i in (10 + k, 100 + k)]
    got = {r.doc_id: r.removed_words for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert got[1] > 280
    assert all(got[100 + k] >= 25 and not got[10 + k] for k in range(60))


def test_edge_rows(make, spark):
    assert line_dedup.dedup_lines(make([])).count() == 0
    rng = random.Random(6)
    long = " ".join(words(rng, 20000))
    loop = "the " * 500
    rows = [(1, None), (1, ""), (None, long), (2, long), (2, long), (3, loop), (4, " \n "), (5, "ü " * 30)]
    df = line_dedup.dedup_lines(make(rows))
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "removed_words"]
    got = df.collect()
    assert len(got) == len(rows) and all(r.row == "own" for r in got)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[2, len(long)].removed_words == 0 and by[None, len(long)].removed_words == 20000
    assert by[None, len(long)].text == "" and by[1, 0].text in (None, "")


def test_filter_that_lets_everything_through_changes_nothing(make, monkeypatch):
    rows = [(i, " ".join(a + p + b)) for i, (a, p, b) in corpus().items()]
    want = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(make(rows)).collect())
    monkeypatch.setattr(line_dedup, "_repeated_bits", lambda spark, docs: spark.sparkContext.broadcast(b"\xff" * (1 << line_dedup.FILTER_BITS - 3)))
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(make(rows)).collect()) == want


def brute(rows, min_words=line_dedup.MIN_WORDS):
    """What stays of each text, from the rule: exact lines and fingerprints in plain dictionaries."""
    texts = {}
    for i, text in rows:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        cut = lines(text)
        own = [tuple(text[a:b] for a, b in spans[s:e]) for s, e in zip(cut.starts, cut.ends)]
        texts[i] = (text, spans, cut, own, sorted(cut.fingerprints()[1].tolist()))
    first = {}
    for i in sorted(texts):
        _, _, _, own, places = texts[i]
        for at in places:
            first.setdefault(tuple(own[at : at + line_dedup.GRAM]), (i, at))
    out = {}
    for i, (text, spans, cut, own, places) in texts.items():
        gone = [False] * len(own)
        for at in places:
            source, there = first[tuple(own[at : at + line_dedup.GRAM])]
            if (source, there) == (i, at):
                continue
            other, low, high = texts[source][3], at, at + line_dedup.GRAM
            for step in range(1, line_dedup.SIDE + 1):
                if at - step < 0 or there - step < 0 or own[at - step] != other[there - step]:
                    break
                low = at - step
            for step in range(line_dedup.SIDE):
                here, far = at + line_dedup.GRAM + step, there + line_dedup.GRAM + step
                if here >= len(own) or far >= len(other) or own[here] != other[far]:
                    break
                high = here + 1
            gone[low:high] = [True] * (high - low)
        kept, at, byte = "", 0, 0
        while at < len(own):
            end = at
            while end < len(own) and gone[end]:
                end += 1
            if end > at:
                one, two = int(cut.starts[at]), int(cut.ends[end - 1])
                if two - one >= min_words:
                    kept += text[byte : spans[one][0]]
                    byte = spans[two][0] if two < len(spans) else len(text)
                at = end
            else:
                at += 1
        out[i] = kept + text[byte:]
    return out


def test_equals_brute_force_and_no_repeat_of_46_words_remains(make):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "köst" for b in ("an", "er", "é", "ing", "o", "um", "", "-")]
    text = lambda n: [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(n)]
    passages = [text(rng.randrange(20, 120)) for _ in range(25)]
    rows = []
    for i in range(200):
        parts = [text(rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        if i % 17 == 0:
            parts += [parts[-1]] * 3 + [["la"] * rng.randrange(90)]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", " \t"]) for p in parts for w in p)))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make(rows).repartition(6)).collect()}
    assert {i: r.text for i, r in got.items()} == brute(rows)
    assert all(r.removed_words == len(t.split()) - len(r.text.split()) for (i, t), r in zip(rows, (got[i] for i, _ in rows)))
    seen = set()
    for i in sorted(got):
        left = got[i].text.split()
        windows = [tuple(left[k : k + 46]) for k in range(len(left) - 45)]
        assert len(set(windows)) == len(windows) and not seen & set(windows)
        seen |= set(windows)


def test_short_repeated_lines_stay_unless_asked(make):
    rng = random.Random(13)
    line = " ".join(words(rng, 22))
    rows = [(i, " ".join(words(rng, 30)) + "\n" + line + "\n" + " ".join(words(rng, 30))) for i in range(6)]
    assert not any(r.removed_words for r in line_dedup.dedup_lines(make(rows)).collect())
    short = {r.doc_id: r.removed_words for r in line_dedup.dedup_lines(make(rows), min_words=9).collect()}
    assert short[0] == 0 and all(short[i] >= 9 for i in range(1, 6))


def test_matches_that_cannot_make_a_run_move_no_text(spark):
    one, own = {"source": 1, "source_words": 0}, {"source": None, "source_words": 0}
    rows = [
        ("short", [(5, 0, 0)]), ("far", [(0, 0, 1), (9, 2, 0)]), ("beside", [(7, 0, 0), (4, 0, 0)]),
        ("over", [(4, 1, 0), (5, 0, 2)]), ("inside", [(0, 0, 2), (1, 0, 0)]),
    ]
    matches = "array<struct<line:long,left:long,right:long,source:long,source_words:long>>"
    given = spark.createDataFrame([(n, [(*m, *(one if i else own).values()) for i, m in enumerate(found)]) for n, found in rows], f"name string, matches {matches}")
    longest = dict(given.select("name", line_dedup._longest("matches")).collect())
    assert longest == {"short": 3, "far": 5, "beside": 6, "over": 7, "inside": 5}
    keys = spark.createDataFrame([(-1,), (5,), (2**62 + 77,)], "row long")
    docs = spark.range(300).selectExpr("id AS row").unionByName(keys)
    held, others = line_dedup._maybe(docs, "row", line_dedup._pages(keys, "row", 25), 25)
    assert sorted(r.row for r in held.collect()) == [-1, 5, 5, 77, 2**62 + 77]
    assert held.count() + others.count() == docs.count()


def test_texts_without_long_runs_stay_and_scratch_tables_go(spark, make):
    rng = random.Random(11)
    passage, heading = words(rng, 60), words(rng, 20)
    rows = [(1, " ".join(passage)), (2, " ".join(words(rng, 40) + passage)), (None, None), (3, "")]
    rows += [(i, " ".join(heading + words(rng, 30))) for i in range(10, 16)]
    scratch = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(scratch.glob("*"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert len(got) == len(rows) and all(got[i].text == t for i, t in rows if i != 2)
    assert [i for i, r in got.items() if r.removed_words] == [2]
    assert {p.name.split("-")[0] for p in set(scratch.glob("*")) - before} == {"runs"}


def test_a_batch_hands_out_each_fingerprint_once():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(40_000))  # a chunk of its own
    found = list(line_dedup._keys(iter([pa.RecordBatch.from_arrays([pa.array([text, text])], ["text"])])))
    assert len(found) == 1 and set(found[0].column(1).to_pylist()) == {2}
    assert len(set(found[0].column(0).to_pylist())) == found[0].num_rows > 1000
