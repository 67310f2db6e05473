"""Web archives written and read as plain Spark text, and one index over all of them.

Writing: one WARC record per page. Of the pages with equal payloads of at least
`least_revisit` bytes the one with the largest id is a response and the others are revisits
that refer to it. The digests that occur twice are found on narrow rows, so payloads are not
shuffled for it unless those digests are too many to broadcast. Records end in two line breaks,
which is the writer's line separator, so files go through Spark's own committer to any store.

Reading: the version line is the line separator. A payload that holds that line is written in
base64 and marked, so records can be told apart anywhere in a file and files can be split.
Lengths and digests are checked.

Index: every task sorts its captures into runs of bounded length by (URL key, time, id), cut
into blocks at the range limits. A range is then merged by one task: its blocks arrive in the
order of their first capture, and a loser tree picks the next capture among the open runs. A
block is opened only when its first capture is due, so a task holds about one block a run.
Limits come from a sample of the sort keys and are full keys, so even a single URL is spread.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeline.runtime import scratch_path, written

VERSION = "WARC/1.1\r\n"
BREAK = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1_000
FIRST_CAPTURE = 1_600_000_000
RUN_ROWS = 50_000
BLOCK_ROWS = 512
RANGE_SAMPLE = 64


def _line(name: str, value: Column) -> Column:
    """A header line; none at all where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK)), F.lit(""))


def capture_time(id_column: Column) -> Column:
    """Pages carry no time of capture: a second per id after a fixed start, 14 digits."""
    seconds = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(id_column.cast("long"), F.lit(0)), F.lit(1_000_000_000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = LEAST_REVISIT,
) -> None:
    """One record per row. Null payloads are empty; line breaks in URLs are percent-encoded; rows
    that repeat the id of a response are responses too; a null id is smaller than any other."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    every = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    every = every.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    shared = every.where(F.col("bytes") >= least_revisit).groupBy("digest").agg(
        F.max("id").alias("response"), F.count(F.lit(1)).alias("n")
    )
    shared = written(shared.where("n > 1").select("digest", "response"), "shared-digests")
    df = every.join(shared, "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    coded = F.col("payload").contains(VERSION)
    body = F.when(revisit, F.lit("")).when(coded, F.base64(F.col("payload").cast("binary"))).otherwise(F.col("payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record_id = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.coalesce(record_id(F.col("id")), F.lit("<urn:page:>"))),
        _line("WARC-Date", capture_time(F.col("id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("X-Payload-Length", F.col("bytes")),
        _line("X-Payload-Coding", F.when(coded & ~revisit, F.lit("base64"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("response")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(body) + len(HTTP)),
        F.lit(BREAK + HTTP),
    )
    df.select(F.concat(head, body)).write.option("lineSep", BREAK * 2).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_id, url, timestamp, record_type, refers_to, payload_bytes, payload_digest, payload) per record.

    The payload of a revisit is null. Bytes and digest of a response are taken from its payload
    anew; a record whose lengths or digest do not agree with its header is an error.
    """
    raw = spark.read.option("lineSep", VERSION).text(path).withColumn("file", F.col("_metadata.file_path")).where("value <> ''")
    head = F.substring_index("value", BREAK * 2, 1)
    df = raw.select("file", "value", head.alias("head"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))
    start = F.length("head") + 5
    block = F.substring("value", start, F.length("value") - start - 3)
    page = lambda name: F.nullif(F.regexp_extract(field(name), r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    df = df.select(
        "file", page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("WARC-Date").alias("timestamp"), field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), field("X-Payload-Length").cast("long").alias("told_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("told_digest"),
        field("Content-Length").cast("long").alias("length"), field("X-Payload-Coding").alias("coding"), block.alias("block"),
    )
    body = F.substring("block", F.lit(len(HTTP) + 1), F.length("block"))
    payload = F.when(F.col("record_type") == "response", F.when(F.col("coding") == "base64", F.unbase64(body)).otherwise(body.cast("binary")))
    df = df.withColumn("whole", F.octet_length("block") == F.col("length")).withColumn("payload", payload)
    told = F.struct(F.col("told_bytes").alias("bytes"), F.col("told_digest").alias("digest"))
    own = F.struct(F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    df = df.withColumn("own", F.coalesce(F.when(F.col("payload").isNotNull(), own), told)).withColumn("told", told)
    broken = F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string")))
    sound = F.when(F.col("whole") & (F.col("own") == F.col("told")), F.col("own")).otherwise(broken)
    df = df.withColumn("sound", sound)
    return df.select(
        "file", "page_id", "url", "timestamp", "record_type", "refers_to",
        F.col("sound.bytes").alias("payload_bytes"), F.col("sound.digest").alias("payload_digest"), "payload",
    )


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then path and query: `com,example)/a?b`.

    Scheme, user, default ports, a leading www and the fragment are left out; the host is in
    lower case. A null URL has the empty key.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.when(url.isNull(), F.lit("")).otherwise(key)


class LoserTree:
    """The smallest head among k streams; inner nodes remember who lost, so that the next
    winner takes one match per level. Nodes also know who won, so any leaf may get a new head
    with two looks per level."""

    def __init__(self, leaves: int):
        self.size = 1
        while self.size < leaves:
            self.size *= 2
        self.heads: list = [None] * self.size
        self.winners = [0] * self.size + list(range(self.size))
        self.losers = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            self._play(node)

    @property
    def winner(self) -> int:
        return self.winners[1]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, node: int) -> None:
        a, b = self.winners[2 * node], self.winners[2 * node + 1]
        self.winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)

    def put(self, leaf: int, head) -> None:
        """Any stream goes on with this head."""
        self.heads[leaf] = head
        node = (leaf + self.size) // 2
        while node:
            self._play(node)
            node //= 2

    def replace(self, head) -> None:
        """The winner's stream goes on with this head (None: nothing for now)."""
        k = self.winner
        self.heads[k] = head
        node = (k + self.size) // 2
        while node:
            if self._beats(self.losers[node], k):
                self.losers[node], k = k, self.losers[node]
            self.winners[node] = k
            node //= 2

    def doubled(self) -> LoserTree:
        """The same streams with as many free leaves again."""
        out = LoserTree(2 * self.size)
        out.heads[: self.size] = self.heads
        for node in range(out.size - 1, 0, -1):
            out._play(node)
        return out


def merge_blocks(blocks: Iterator[tuple[str, list[tuple]]]) -> Iterator[tuple]:
    """Rows in order from (run, sorted rows), given in the order of their first rows.

    A run has a leaf only while it has rows that wait, so leaves are as many as runs that overlap.
    """
    waiting: list[deque] = [deque()]
    leaf_of: dict[str, int] = {}
    name_of: dict[int, str] = {}
    free = [0]
    tree = LoserTree(1)
    incoming = next(blocks, None)
    while True:
        while incoming is not None and (tree.heads[tree.winner] is None or incoming[1][0] <= tree.heads[tree.winner]):
            run, rows = incoming
            leaf = leaf_of.get(run)
            if leaf is None:
                if not free:
                    free = list(range(2 * tree.size - 1, tree.size - 1, -1))
                    tree = tree.doubled()
                    waiting += [deque() for _ in free]
                leaf = free.pop()
                leaf_of[run], name_of[leaf] = leaf, run
            waiting[leaf].extend(rows)
            tree.put(leaf, waiting[leaf][0])
            incoming = next(blocks, None)
        leaf = tree.winner
        if tree.heads[leaf] is None:
            return
        queue = waiting[leaf]
        yield queue.popleft()
        tree.replace(queue[0] if queue else None)
        if not queue:
            del leaf_of[name_of.pop(leaf)]
            free.append(leaf)


_INDEX = "range int, run string, block int, first string, sort string, capture string"


def _runs(limits: list[str]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str]] = []
        number, name = 0, ""
        for batch in batches:
            if batch.num_rows and not name:
                name = f"{batch.column(0)[0].as_py()} {batch.column(1)[0].as_py()}"
            rows.extend(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            while len(rows) >= RUN_ROWS:
                yield _cut_run(sorted(rows[:RUN_ROWS]), limits, f"{name} {number}")
                rows, number = rows[RUN_ROWS:], number + 1
        if rows:
            yield _cut_run(sorted(rows), limits, f"{name} {number}")

    return run


def _cut_run(rows: list[tuple[str, str]], limits: list[str], run: str) -> pa.RecordBatch:
    ranges = [bisect_right(limits, key) for key, _ in rows]
    blocks, firsts = [], []
    block, size = -1, 0
    for i, place in enumerate(ranges):
        if i == 0 or place != ranges[i - 1] or size == BLOCK_ROWS:
            block, size, first = block + 1, 0, rows[i][0]
        size += 1
        blocks.append(block)
        firsts.append(first)
    return pa.RecordBatch.from_arrays(
        [pa.array(ranges, pa.int32()), pa.array([run] * len(rows)), pa.array(blocks, pa.int32()), pa.array(firsts),
         pa.array([k for k, _ in rows]), pa.array([c for _, c in rows])],
        ["range", "run", "block", "first", "sort", "capture"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one range after the other; a block's rows are contiguous and sorted."""

    def blocks() -> Iterator[tuple[int, str, list[tuple]]]:
        open_block, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for place, run, block, _, key, capture in zip(*columns):
                if open_block != (place, run, block):
                    if rows:
                        yield open_block[0], open_block[1], rows
                    open_block, rows = (place, run, block), []
                rows.append((key, capture))
        if rows:
            yield open_block[0], open_block[1], rows

    source = blocks()
    ahead = next(source, None)
    while ahead is not None:
        place = ahead[0]

        def of_range() -> Iterator[tuple[str, list[tuple]]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == place:
                now, ahead = ahead, next(source, None)
                yield now[1], now[2]

        out: list[str] = []
        done = 0
        for _, capture in merge_blocks(of_range()):
            out.append(capture)
            if len(out) == 8192:
                yield _numbered(place, done, out)
                done, out = done + len(out), []
        if out:
            yield _numbered(place, done, out)


def _numbered(place: int, done: int, captures: list[str]) -> pa.RecordBatch:
    n = len(captures)
    return pa.RecordBatch.from_arrays(
        [pa.array([place] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), pa.array(captures)],
        ["range", "within", "capture"],
    )


def merge_index(captures: DataFrame) -> DataFrame:
    """All captures in the order of (url_key, timestamp, page_id), as `place` from 0.

    `captures` has url, timestamp, page_id and file; all columns are kept. Null URLs come first,
    null ids before others; equal captures stand beside one another. An empty table gives an
    empty one.
    """
    spark = captures.sparkSession
    sign = F.when(F.col("page_id").isNull(), F.lit(" ")).when(F.col("page_id") < 0, F.lit("-")).otherwise(F.lit("0"))
    shift = F.when(F.col("page_id") < 0, F.col("page_id") - F.lit(-(2**63))).otherwise(F.coalesce("page_id", F.lit(0)))
    sort = F.concat(url_key(F.col("url")), F.lit("\x01"), F.coalesce("timestamp", F.lit("")), F.lit("\x01"), sign, F.lpad(shift.cast("string"), 19, "0"))
    keyed = written(captures.select("file", sort.alias("sort"), F.to_json(F.struct("*")).alias("capture")), "captures")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = keyed.select("sort").orderBy(F.xxhash64("sort"), "sort").limit(ranges * RANGE_SAMPLE)
    keys = sorted(r["sort"] for r in sample.collect())
    limits = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    runs = keyed.mapInArrow(_runs(limits), _INDEX)
    dealt = runs.repartition(ranges, "range").sortWithinPartitions("range", "first", "run", "block", "sort")
    merged = written(dealt.mapInArrow(_merge, "range int, within long, capture string"), "merged")
    before = {r["range"]: r["n"] for r in merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for place in sorted(before):
        offsets.append((place, total))
        total += before[place]
    starts = spark.createDataFrame(offsets, "range int, offset long")
    fields = F.from_json("capture", captures.schema)
    placed = merged.join(F.broadcast(starts), "range").select(fields.alias("c"), (F.col("offset") + F.col("within")).alias("place"))
    return placed.select("c.*", "place")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages written as archives, read back and merged into one index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return merge_index(read_archives(spark, path).drop("payload"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d),
b AS (SELECT page_id, n, d, CASE WHEN top IS NOT NULL AND top <> page_id THEN top END AS refers_to,
  regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM p LEFT JOIN m USING (d)),
k AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)),
  ':(80|443)$', ''), '^www\\.', ''), '.')), ',') || ')' || regexp_extract(bare, '^[^/?]*(.*)$', 1) AS url_key FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id) - 1 AS place FROM k
"""
