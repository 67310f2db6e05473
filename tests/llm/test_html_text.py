from gradeline.llm.html_text import extract_text, main_text

LONG = "This is the body of the article and it is long enough to be sure that it was written as text for the people who read it. " * 2
LEAN = "Zuxtra velmor prandig ostelun fravik umbrel doskan tirelg wenzor malvik hestu " * 2


def page(body, tail="</article><aside><p>{x}</p></aside><footer>&copy; us</footer></body></html>"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head line</h1>{body}" + tail.replace("{x}", LONG)


def test_article_only():
    body = (
        f"<p>{LONG}</p><p><b>Short&amp;sweet.<br>Two&nbsp;lines\n here<p>{LEAN}</p><!-- <p>gone</p> --><p><a href='#'>A link that is all of it</a></p>"
        f"<div class='newsletter box'><p>{LONG}</p></div><form><p>{LONG}</p></form><section id=comments><p>{LONG}</p></section><p>End.</p>"
    )
    clean = " ".join(LONG.split())
    want = ["Head line", clean, "Short&sweet. Two lines here", " ".join(LEAN.split()), "End."]
    assert main_text(page(body)).split("\n\n") == want
    assert main_text(page(body, tail="")).split("\n\n") == want


def test_short_blocks_follow_their_neighbours():
    flat = f"<div><p>Menu</p><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><h2>Title</h2><p>{LONG}</p><p>A short line.</p><p>{LONG}</p><p>By us</p><p>x</p><div class=footer>{LONG}</div></div>"
    got = main_text(flat).split("\n\n")
    clean = " ".join(LONG.split())
    assert got == ["Title", clean, "A short line.", clean, "By us"]


def test_odd_markup():
    assert main_text("") == "" and main_text("<p></p><br>") == ""
    assert main_text("<article>a < b &lt; c &unknown; &amp d<script>never closed") == "a < b < c &unknown; & d"
    assert main_text("<nav><p>out</nav><article><p title='a>b'>in</article>") == "in"
    assert main_text("<article><!-- never closed <p>x</p>") == ""


def test_columns_and_empty_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, page(f"<p>{LONG}</p>"), "x")], "page_id long, url string, html string, text string")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted((r.page_id or 0, r.text[:9], r.n_chars == len(r.text)) for r in got.collect())
    assert rows == [(0, "Head line", True), (1, "", True), (1, "", True)]
    assert extract_text(df.limit(0)).count() == 0
    big = spark.createDataFrame([(1, "u", page(f"<p>{LONG}</p>" * 3000))], "page_id long, url string, html string")
    assert extract_text(big).first()["text"].count("\n\n") == 3000


CLEAN = " ".join(LONG.split())
# Markup within an article, and what of it is text.
INSIDE = [
    (f"<figure><img src=x><figcaption>A caption of the picture.</figcaption></figure><p>{LONG}</p>", ["A caption of the picture.", CLEAN]),
    (f"<p>{LONG}</p><p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> holds.</p>", [CLEAN, "So E=m holds."]),
    (f"<div class='related work'><h2>Related work</h2><p>{LONG}</p><p>{LONG}</p></div>", ["Related work", CLEAN, CLEAN]),
    (f"<div class='post-header'><h1>Title</h1></div><p>{LONG}</p>", ["Title", CLEAN]),
    (f"<header><h1>Title</h1><p>By us</p></header><p>{LONG}</p>", ["Title", "By us", CLEAN]),
    (f"<div class=header><h2>Part two</h2></div><p>{LONG}</p>", ["Part two", CLEAN]),
    (f"<section class='share-prices'><p>{LONG}</p></section>", [CLEAN]),
    (f"<div class='no-ads-here'><p>{LONG}</p></div><p class=note>Noted.</p>", [CLEAN, "Noted."]),
    (f"<p>{LONG}</p><table><tr><td>One</td><td>Two</td></tr></table><pre>a  b</pre>", [CLEAN, "One", "Two", "a b"]),
    (f"<p>{LONG}</p><div class='related'><ul><li><a href=a>More of this</a></li><li><a href=b>And that</a></li></ul></div>", [CLEAN]),
    (f"<p>{LONG}</p><div class='social share'>Tell your friends</div>", [CLEAN]),
    (f"<p>{LONG}</p><div class=comment-list><p>{LONG}</p></div><div id=respond><p>{LONG}</p></div>", [CLEAN]),
    (f"<p>{LONG}</p><div class='ad-slot'><p>{LONG}</p></div><div class='site-footer'>{LONG}</div>", [CLEAN]),
    (f"<p>{LONG}</p><div class=cookie_notice><p>{LONG}</p></div><aside><p>{LONG}</p></aside>", [CLEAN]),
]


def test_labelled_parts_of_an_article():
    for markup, want in INSIDE:
        assert main_text(f"<html><body><nav><a href=/>Home</a></nav><article>{markup}</article><footer>us</footer>").split("\n\n") == want


def test_labelled_parts_of_pages_without_article_elements():
    flat = lambda markup: main_text(f"<body><div class=top-menu><a href=/>Home</a></div><div>{markup}</div><div class=footer>{LONG}</div>").split("\n\n")
    assert flat(f"<div class='entry_header'><h1>Title</h1></div><p>{LONG}</p>") == ["Title", CLEAN]
    assert flat(f"<div class='header'><h1>Site</h1><p>{LONG}</p></div><p>{LONG}</p><p>{LONG}</p>") == [CLEAN, CLEAN]
    assert flat(f"<p>{LONG}</p><div class='related'><p>{LONG}</p></div><p>{LONG}</p>") == [CLEAN, CLEAN]
