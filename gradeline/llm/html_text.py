"""Main text of web pages by two-pass block rules.

First pass: a page is cut into blocks at block-level tags. Blocks inside menus, footers,
sidebars, forms and the like, or with much of their text in links, are out; long blocks are in if they stand in an article or have
enough stop words; the others are ambiguous, short ones and those with few stop words.
Parts are known by their element or by a class or id that begins or ends with a telling word. Where
an article uses a word that also names content (related, header, share), the part must be short or
full of links as well, and headings of an article's own header stay. Captions and formulas are text.
Second pass: an ambiguous block takes the label of the nearest decided block around it, within
its own article if it stands in one; the article's edges count as decided for it.

One page is one row, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from gradeline.llm.common import ROW, from_rows, texts, whole_rows

SHORT = 70
LONG = 200
FEW_STOP_WORDS = 0.08
MANY_STOP_WORDS = 0.2
LINK_SHARE = 0.4

# Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    """the of and to in is that it for was with as on be at by this had not are but from or have an they which
    one you were her all she there would their we him been has when who will more no if out so what a
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch
    le la les de des du un une et est en que qui dans pour pas sur au aux par avec il elle ne se ce son plus ou mais sa
    el los las del y que en un una por con no para su al lo como más pero sus o este sí porque esta entre cuando""".split()
)
# Elements whose content is never text, and those whose blocks are out.
RAW = frozenset("script style noscript template textarea title svg iframe object select annotation annotation-xml".split())
OUT = frozenset("nav footer aside form button menu dialog".split())
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
    section summary table tbody td tfoot th thead tr ul""".split()
)
HOLDER = frozenset(
    "article aside body button details dialog div dl fieldset figure footer form header main menu nav ol section table ul blockquote".split()
)
ARTICLE = frozenset("article main".split())
# Words in class or id that mark a part as no article, anywhere and, with a second sign, within one.
STRONG = frozenset(
    """ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer menu modal nav
    navbar navigation newsletter notice pagination popup replies respond sidebar sponsor sponsored subscribe toolbar""".split()
)
WEAK = frozenset("banner header masthead promo promotion related share sharing social widget".split())
# A header of these is the headline of the text.
OWN = frozenset("article content entry post story".split())
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>|<[!?][^>]*>""", re.S)


def hint_of(values: list[str]) -> str:
    """What classes and ids say about a part: `strong`, `weak` or nothing."""
    found = ""
    for name in " ".join(v.strip("\"'") for v in values).lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        ends = {parts[0], parts[-1]} if parts else set()
        if parts[-1:] == ["header"] and OWN & set(parts):
            continue
        if ends & STRONG:
            return "strong"
        if ends & WEAK:
            found = "weak"
    return found


@dataclass
class Block:
    article: int
    out: bool
    weak: int = 0
    heading: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order; unclosed elements end with what holds them."""
    found: list[Block] = []
    holders: list[tuple[str, bool, int, int]] = []
    out, weak, parts, article, articles, links = False, 0, 0, 0, 0, 0
    block = Block(0, False)
    at, size = 0, len(page)

    def close() -> Block:
        if block.parts:
            found.append(block)
        return Block(article, out, weak)

    def add(text: str) -> None:
        if text:
            text = html.unescape(text)
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())

    while at < size:
        mark = _MARK.search(page, at)
        if mark is None:
            add(page[at:])
            break
        add(page[at : mark.start()])
        at = mark.end()
        if mark[2] is None:
            continue
        name, closing = mark[2].lower(), mark[1] == "/"
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            block.parts.append(" ")
        elif name in BLOCK:
            links = 0
            if name in HOLDER and closing:
                for k in range(len(holders) - 1, -1, -1):
                    if holders[k][0] == name:
                        _, out, weak, article = holders[k]
                        del holders[k:]
                        break
            block = close()
            if name in HOLDER and not closing:
                holders.append((name, out, weak, article))
                hint = hint_of(_ATTRIBUTE.findall(mark[3])) if name not in ("body", "main", "article") else ""
                out = out or name in OUT or hint == "strong" or (hint == "weak" or name == "header") and not article
                if hint == "weak" and article and not weak:
                    parts += 1
                    weak = parts
                if name in ARTICLE and not article:
                    articles += 1
                    article = articles
            block = Block(article, out, weak, not closing and re.fullmatch("h[1-6]", name) is not None)
    close()
    return found


def main_text(page: str) -> str:
    """The blocks that are article text, two line breaks between them."""
    found = [(block, text) for block in blocks(page) if (text := block.text())]
    _settle_weak(found)
    kept = [(block, text, _first_label(block, text)) for block, text in found]
    labels = [label for _, _, label in kept]
    final = []
    for i, (block, _, label) in enumerate(kept):
        near = _inherited(kept, labels, i) if label in ("short", "likely") else label
        final.append(near)
    return "\n\n".join(text for (_, text, _), label in zip(kept, final) if label == "in")


def _settle_weak(found: list[tuple[Block, str]]) -> None:
    """Parts of an article with a weak hint are out if they are short or mostly links as well."""
    size: dict[int, list[int]] = {}
    for block, text in found:
        if block.weak:
            total = size.setdefault(block.weak, [0, 0])
            total[0] += len(text)
            total[1] += block.linked
    for block, _ in found:
        if block.weak and not block.heading:
            length, linked = size[block.weak]
            block.out = block.out or length < LONG or linked > LINK_SHARE * length


def _first_label(block: Block, text: str) -> str:
    if block.out or block.linked > LINK_SHARE * len(text):
        return "apart" if block.out and block.article else "out"
    if len(text) < SHORT:
        return "short"
    words = [w.strip(".,;:!?\"'()«»„“”").lower() for w in text.split()]
    stop = sum(w in STOP_WORDS for w in words) / len(words)
    if block.article or stop >= MANY_STOP_WORDS and len(text) > LONG:
        return "in"
    return "likely" if stop >= FEW_STOP_WORDS else "short"


def _inherited(kept: list, labels: list[str], i: int) -> str:
    """The label of the nearest decided block; an article's edge counts as in, the page's as out.

    Parts set apart within an article say nothing about their neighbours. Of two equally near
    labels a heading and a block with some stop words take the better one.
    """
    block = kept[i][0]

    def look(step: int) -> tuple[int, str]:
        k = i + step
        while 0 <= k < len(kept) and kept[k][0].article == block.article and labels[k] not in ("in", "out"):
            k += step
        if not 0 <= k < len(kept) or kept[k][0].article != block.article:
            return abs(k - i), "in" if block.article else "out"
        return abs(k - i), labels[k]

    (before, one), (after, two) = look(-1), look(1)
    if one == two:
        return one
    if before == after:
        return "in" if labels[i] == "likely" or block.heading or block.article else "out"
    return one if before < after else two


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page) for page in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
            [ROW, "text", "n_chars"],
        )


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but the html, with `text` (empty if there is none) and `n_chars`, its code points.

    Columns of these names are replaced. Null and empty pages give an empty text; a page without
    markup is one block; whole pages are read, however long. Rows repeat as they come.
    """
    given = pages.select(whole_rows(pages.drop(html_col)), F.col(f"`{html_col}`").alias("html"))
    schema = StructType(given.schema.fields[:1]).add("text", StringType()).add("n_chars", LongType())
    return from_rows(given.mapInArrow(_extract, schema), F.col("text").alias("text"), F.col("n_chars").alias("n_chars"))
