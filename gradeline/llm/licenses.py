"""License statements by ordered signature rules, with built-in functions only.

A text that names nothing licence-like is left after one prefilter. In the others the keywords
of rules are looked up, and each text meets just the rules of its keywords: the rules are a
table of fixed size, joined on the keyword. Detections are intervals. One that lies within
another is suppressed; of equal intervals the rule that comes first in the order stays.

Beside the rules every text has its base phrases counted, which nothing suppresses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeline.llm.common import row_key
from gradeline.llm.spans import match_ends

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# License, keywords of which its name holds one, name as a pattern, identifier as a pattern.
LICENSES = (
    ("mit", "mit|expat", r"\bmit\b|\bexpat\b", r"mit"),
    ("mit-0", "mit", r"\bmit[\s-]+(?:no[\s-]+attribution|0)\b", r"mit-0"),
    ("x11", "x11", r"\bx11\b|\bmit/x11\b", r"x11"),
    ("isc", "isc", r"\bisc\b", r"isc"),
    ("bsd", "bsd", r"\bbsd\b", r"bsd"),
    ("bsd-0", "bsd", r"\b(?:0|zero)[\s-]+clause\s+bsd\b", r"0bsd"),
    ("bsd-2", "bsd", r"\b(?:bsd[\s-]+2|2[\s-]+clause\s+bsd|simplified\s+bsd|freebsd)\b", r"bsd-2-clause"),
    ("bsd-3", "bsd", r"\b(?:bsd[\s-]+3|3[\s-]+clause\s+bsd|new\s+bsd|revised\s+bsd)\b", r"bsd-3-clause"),
    ("bsd-4", "bsd", r"\b(?:bsd[\s-]+4|4[\s-]+clause\s+bsd|original\s+bsd)\b", r"bsd-4-clause"),
    ("apache-1", "apache", r"\bapache(?:\s+software)?\s+licen[cs]e,?\s+(?:version\s+)?1(?:\.[01])?\b", r"apache-1\.[01]"),
    ("apache-2", "apache", r"\bapache(?:\s+licen[cs]e)?,?\s+(?:version\s+|v)?2(?:\.0)?\b", r"apache-2\.0"),
    ("apache", "apache", r"\bapache(?:\s+software)?\b", r"apache"),
    ("gpl", "gpl", r"\b(?:gnu\s+)?gpl\b", r"gpl"),
    ("gpl-2", "gpl", r"\b(?:gnu\s+)?gpl[\s-]*(?:v|version\s+)?2(?:\.0)?\b", r"gpl-2\.0(?:-only|-or-later)?\+?"),
    ("gpl-3", "gpl", r"\b(?:gnu\s+)?gpl[\s-]*(?:v|version\s+)?3(?:\.0)?\b", r"gpl-3\.0(?:-only|-or-later)?\+?"),
    ("gpl", "general public", r"\b(?:gnu\s+)?general\s+public\b", r"gpl"),
    ("gpl-2", "general public", r"\b(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:version\s+|v)2\b", r"gpl-2\.0"),
    ("gpl-3", "general public", r"\b(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:version\s+|v)3\b", r"gpl-3\.0"),
    ("lgpl", "lgpl", r"\b(?:gnu\s+)?lgpl\b", r"lgpl"),
    ("lgpl-2", "lgpl", r"\b(?:gnu\s+)?lgpl[\s-]*(?:v|version\s+)?2(?:\.[01])?\b", r"lgpl-2\.[01](?:-only|-or-later)?\+?"),
    ("lgpl-3", "lgpl", r"\b(?:gnu\s+)?lgpl[\s-]*(?:v|version\s+)?3(?:\.0)?\b", r"lgpl-3\.0(?:-only|-or-later)?\+?"),
    ("lgpl", "lesser general", r"\b(?:gnu\s+)?lesser\s+general\s+public\b", r"lgpl"),
    ("agpl", "agpl", r"\b(?:gnu\s+)?agpl\b", r"agpl"),
    ("agpl-3", "agpl", r"\b(?:gnu\s+)?agpl[\s-]*(?:v|version\s+)?3(?:\.0)?\b", r"agpl-3\.0(?:-only|-or-later)?\+?"),
    ("agpl-3", "affero", r"\b(?:gnu\s+)?affero\s+general\s+public\b", r"agpl-3\.0"),
    ("mpl-1", "mozilla", r"\bmozilla\s+public\s+licen[cs]e,?\s+(?:version\s+|v)?1(?:\.[01])?\b", r"mpl-1\.[01]"),
    ("mpl-2", "mozilla", r"\bmozilla\s+public\s+licen[cs]e,?\s+(?:version\s+|v)?2(?:\.0)?\b", r"mpl-2\.0"),
    ("mpl", "mozilla", r"\bmozilla\s+public\b", r"mpl"),
    ("mpl-2", "mpl", r"\bmpl[\s-]*(?:v)?2(?:\.0)?\b", r"mpl-2\.0"),
    ("epl", "eclipse", r"\beclipse\s+public\b", r"epl-[12]\.0"),
    ("edl", "eclipse", r"\beclipse\s+distribution\b", r"edl-1\.0"),
    ("eupl", "eupl", r"\beupl\b", r"eupl-1\.[012]"),
    ("cddl", "cddl", r"\bcddl\b", r"cddl-1\.[01]"),
    ("cpl", "common public", r"\bcommon\s+public\b", r"cpl-1\.0"),
    ("ibm", "ibm", r"\bibm\s+public\b", r"ipl-1\.0"),
    ("artistic", "artistic", r"\bartistic\b", r"artistic-[12]\.0"),
    ("psf", "python software|psf", r"\bpython\s+software\s+foundation\b|\bpsf\b", r"psf-2\.0|python-2\.0"),
    ("php", "php", r"\bphp\b", r"php-3\.0[1]?"),
    ("ruby", "ruby", r"\bruby\b", r"ruby"),
    ("perl", "perl", r"\bperl\b", r"artistic-1\.0-perl"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)?\b", r"zlib"),
    ("libpng", "libpng", r"\blibpng\b", r"libpng(?:-2\.0)?"),
    ("boost", "boost", r"\bboost\s+software\b", r"bsl-1\.0"),
    ("business", "business source", r"\bbusiness\s+source\b", r"busl-1\.1"),
    ("elastic", "elastic", r"\belastic\b", r"elastic-2\.0"),
    ("sspl", "server side", r"\bserver\s+side\s+public\b", r"sspl-1\.0"),
    ("unlicense", "unlicense", r"\bunlicense\b", r"unlicense"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", r"wtfpl"),
    ("ofl", "open font", r"\b(?:sil\s+)?open\s+font\b", r"ofl-1\.[01]"),
    ("odbl", "open database", r"\bopen\s+database\b", r"odbl-1\.0"),
    ("odc-by", "open data commons", r"\bopen\s+data\s+commons(?:\s+attribution)?\b", r"odc-by-1\.0"),
    ("pddl", "public domain dedication", r"\bpublic\s+domain\s+dedication\b", r"pddl-1\.0"),
    ("cc0", "cc0", r"\bcc0\b", r"cc0-1\.0"),
    ("cc-by", "creative commons", r"\bcreative\s+commons\s+attribution\b", r"cc-by-[1-4]\.0"),
    ("cc-by-sa", "creative commons", r"\bcreative\s+commons\s+attribution[\s-]+share[\s-]*alike\b", r"cc-by-sa-[1-4]\.0"),
    ("cc-by-nc", "creative commons", r"\bcreative\s+commons\s+attribution[\s-]+non[\s-]*commercial\b", r"cc-by-nc-[1-4]\.0"),
    ("cc-by-nd", "creative commons", r"\bcreative\s+commons\s+attribution[\s-]+no[\s-]*deriv\w*", r"cc-by-nd-[1-4]\.0"),
    ("cc-by", "cc", r"\bcc[\s-]by\b", r"cc-by"),
    ("cc-by-sa", "cc", r"\bcc[\s-]by[\s-]sa\b", r"cc-by-sa"),
    ("cc-by-nc", "cc", r"\bcc[\s-]by[\s-]nc\b", r"cc-by-nc"),
    ("cc-by-nd", "cc", r"\bcc[\s-]by[\s-]nd\b", r"cc-by-nd"),
    ("cc-by-nc-sa", "cc", r"\bcc[\s-]by[\s-]nc[\s-]sa\b", r"cc-by-nc-sa"),
    ("cc-by-nc-nd", "cc", r"\bcc[\s-]by[\s-]nc[\s-]nd\b", r"cc-by-nc-nd"),
)
# How a license is stated, strongest first: pattern around the name or identifier, and its score.
STATEMENTS = (
    (r"spdx-license-identifier:\s*(?:{id})(?![\w.-])", 1.0),
    (r"\b(?:licen[cs]ed|released|distributed|published|available|provided|dual[\s-]licen[cs]ed)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{name})(?:\s+licen[cs]e)?", 1.0),
    (r"\b(?:under|see|subject\s+to)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{name})\s+licen[cs]e", 0.9),
    (r"(?:{name})\s+licen[cs]e", 0.8),
)
# Notices without a license's name: label, keyword, pattern, score.
NOTICES = (
    ("all-rights-reserved", "reserved", r"\ball\s+rights\s+reserved\b", 0.7),
    ("copyright", "copyright", r"\bcopyright\s+(?:\(c\)\s*|©\s*)?(?:19|20)\d\d\b", 0.6),
    ("public-domain", "public domain", r"\b(?:in|into|to)\s+the\s+public\s+domain\b", 0.8),
    ("cc-by-nc", "cc", r"\bcc[\s-]by[\s-]nc(?:[\s-]+[1-4]\.0)?\b", 0.9),
    ("cc-by", "cc", r"\bcc[\s-]by(?:[\s-]+[1-4]\.0)?\b", 0.8),
    ("cc-by-sa", "cc", r"\bcc[\s-]by[\s-]sa(?:[\s-]+[1-4]\.0)?\b", 0.8),
    ("apache-2", "apache", r"\bapache\s+licen[cs]e,?\s+version\s+2(?:\.0)?\b", 0.9),
    ("cc0", "cc0", r"\bcc0(?:\s+1\.0)?\b", 0.8),
    ("proprietary", "proprietary", r"\bproprietary\s+and\s+confidential\b", 0.7),
)
BASE_SCORE = 0.95
# Every rule's match holds a match of this: statements hold the word license or a verb before under.
GATE = "(?i)" + "|".join(
    [r"licen[cs]e", r"(?:released|distributed|published|available|provided)\s+under\s", *(pattern for _, _, pattern, _ in NOTICES)]
)


def rules() -> list[tuple[int, str, str, str, float]]:
    """(order, label, keyword, pattern, score) of every rule: statements of each license, then notices.

    A rule comes once for each of its keywords. Every match of the rule holds one of them, in
    lower case and with single spaces.
    """
    found = []
    for pattern, score in STATEMENTS:
        for label, keywords, name, identifier in LICENSES:
            held = keywords.split("|") if "{name}" in pattern else _first_letters(identifier)
            found.append((label, held, "(?i)" + pattern.replace("{name}", name).replace("{id}", identifier), score))
    found += [(label, [keyword], "(?i)" + pattern, score) for label, keyword, pattern, score in NOTICES]
    return [(i, label, k, *rest) for i, (label, held, *rest) in enumerate(found) for k in held]


def _first_letters(identifier: str) -> list[str]:
    """The literal start of each alternative of an identifier, such as cc-by- of cc-by-[1-4]."""
    return sorted({re.match("[a-z0-9-]+", part)[0] for part in re.sub(r"\(.*?\)", "", identifier).split("|")})


def phrase_pattern(phrase: str) -> str:
    return f"(?i)(?<!{WORD})" + GAP.join(phrase.split(" ")) + f"(?!{WORD})"


def _detections(given: DataFrame) -> DataFrame:
    """(row, label, score) of the rule matches that nothing suppresses."""
    spark: SparkSession = given.sparkSession
    table = spark.createDataFrame(rules(), "rank int, label string, keyword string, pattern string, score double")
    keywords = sorted({r[2] for r in rules()}, key=lambda k: (-len(k), k))
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.instr(F.col("low"), k) > 0)
    likely = given.where(F.col("text").rlike(GATE)).select("row", "text", F.regexp_replace(F.lower("text"), r"\s+", " ").alias("low"))
    met = likely.select("row", "text", F.explode(held).alias("keyword")).join(F.broadcast(table), "keyword")
    met = met.withColumn("matches", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).where(F.size("matches") > 0)
    ends = match_ends(F.col("text"), F.col("pattern"), F.col("matches"))
    spans = F.zip_with("matches", ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end")))
    placed = met.select("row", "rank", "label", "score", F.inline(spans)).distinct()
    wider = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max("end").over(wider) >= F.col("end"), F.lit(False))
    return placed.withColumn("inside", inside).where("NOT inside").select("row", "label", "score")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z read as a-z.
    Base phrases count where their words stand consecutively; first_word and last_word are the
    smallest and largest place of one, null without. The score is that of the strongest
    detection. Null texts are empty: no words, no labels, score 0. Rows that agree in id and
    text get the same; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("row"), text)
    found = _detections(given).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))

    df = given.withColumn("n_words", F.regexp_count("text", F.lit(WORD + "+")).cast("long"))
    none = F.array().cast("array<string>")
    likely = F.col("text").rlike(r"(?i)licen|cc[^a-z0-9]")
    for i, (phrase, _) in enumerate(PHRASES):
        every = F.regexp_extract_all("text", F.lit(phrase_pattern(phrase)), F.lit(0))
        df = df.withColumn(f"m{i}", F.when(likely, every).otherwise(none))
    for i, (phrase, _) in enumerate(PHRASES):
        ends = match_ends(F.col("text"), F.lit(phrase_pattern(phrase)), F.col(f"m{i}"))
        df = df.withColumn(f"e{i}", F.when(F.size(f"m{i}") > 0, ends))
    starts = [F.zip_with(f"m{i}", f"e{i}", lambda m, e: e - F.length(m)) for i in range(len(PHRASES))]
    df = df.withColumn("starts", F.flatten(F.array_compact(F.array(*starts))))
    before = lambda start: F.regexp_count(F.substring("text", F.lit(1), start.cast("int")), F.lit(WORD + "+")).cast("long")
    n_base: Column = F.size("starts").cast("long")
    base = F.array_compact(F.array(*[F.when(F.size(f"m{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    df = df.select(
        "id", "row", "n_words", n_base.alias("n_base"),
        F.when(n_base > 0, before(F.array_min("starts"))).alias("first_word"),
        F.when(n_base > 0, before(F.array_max("starts"))).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
    )
    both = df.join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return both.select(
        "id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"),
    )
