import hashlib
import random

import pytest

from gradeline.llm import warc

LONG = "<p>" + "väter " * 300 + "</p>"


def pages(spark, rows):
    rows = [(i, u, h, "x", "y") for i, u, h in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, file string")


@pytest.fixture
def folder(spark, tmp_path):
    return f"file://{tmp_path}/warc"


def test_round_trip_with_revisits_and_odd_payloads(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 2)
    odd = ["", None, "a\r\n\r\nb", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", LONG + warc.VERSION, "\r\n", "x" * 999, "x" * 1000]
    rows = [(i, f"http://h{i % 3}.example.com/{i % 5}?q=\r\n{i}", odd[i % len(odd)]) for i in range(40)]
    rows += [(100 + i, "http://hot.example.com/", LONG) for i in range(60)] + [(-5, None, LONG), (None, "http://z", "short"), (3, "HTTP://WWW.H3.Example.com:80/a#b", "")]
    random.Random(1).shuffle(rows)
    got = warc.archive_round_trip(pages(spark, rows), folder).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            groups.setdefault(h, []).append(i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = max(groups.get(h, [i]), key=lambda x: -(10**9) if x is None else x)
        revisit = h in groups and i != top
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda x: tuple((v is not None, v) for v in x)
    told = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(told, key=key) == sorted(want, key=key)
    order = sorted(got, key=lambda r: r.place)
    assert [r.place for r in order] == list(range(len(rows)))
    surt = {r.url: r.k for r in spark.createDataFrame([(r.url,) for r in got], "url string").distinct().select("url", warc.url_key(warc.F.col("url")).alias("k")).collect()}
    keys = [(surt[r.url], r.timestamp, r.page_id is not None, r.page_id or 0) for r in order]
    assert keys == sorted(keys)
    assert surt["HTTP://WWW.H3.Example.com:80/a#b"] == "com,example,h3)/a"
    stored = {r.page_id: r.payload for r in warc.read_archives(spark, folder).where("record_type = 'response'").collect()}
    assert all(bytes(stored[i]).decode() == (h or "") for i, _, h in rows if i in stored and i not in (3,))


def test_damage_is_an_error(spark, folder):
    text = warc.VERSION + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 7\r\n\r\nabc"
    spark.createDataFrame([(text,)], "value string").write.option("lineSep", "\r\n\r\n").text(folder)
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archives(spark, folder).collect()


def test_empty_table(spark, folder):
    assert warc.archive_round_trip(pages(spark, []), folder).count() == 0


def test_loser_tree_merges_like_sorting():
    rng = random.Random(2)
    for runs in (1, 2, 3, 7, 16):
        data = [sorted((rng.randrange(50), str(r)) for _ in range(rng.randrange(0, 40))) for r in range(runs)]
        blocks = [(str(r), d[i : i + 3]) for r, d in enumerate(data) for i in range(0, len(d), 3)]
        blocks.sort(key=lambda b: b[1][0])
        assert list(warc.merge_blocks(iter(blocks))) == sorted(x for d in data for x in d)


def test_matches_grow_with_the_rows_and_not_with_their_square(monkeypatch):
    beats, seen = warc.LoserTree._beats, []
    monkeypatch.setattr(warc.LoserTree, "_beats", lambda self, a, b: seen.append(1) or beats(self, a, b))
    counts = []
    for runs in (200, 400, 800):
        seen.clear()
        rng = random.Random(3)
        data = [sorted((rng.random(), str(r)) for _ in range(6)) for r in range(runs)]
        blocks = sorted(((str(r), d[i : i + 2]) for r, d in enumerate(data) for i in range(0, 6, 2)), key=lambda b: b[1][0])
        assert list(warc.merge_blocks(iter(blocks))) == sorted(x for d in data for x in d)
        counts.append(len(seen))
    assert counts[1] < 2.5 * counts[0] and counts[2] < 2.5 * counts[1]
