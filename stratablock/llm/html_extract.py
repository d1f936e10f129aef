"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one decides by the blocks
themselves: more than LINKED of the characters in links is boilerplate, LONG
characters or more of which DENSE of the words are stop words is text.  All else is
ambiguous: short blocks, and long ones whose words say nothing.  Pass two gives an
ambiguous block the label of its nearest decided neighbour; of two at the same
distance that differ, text wins.

Tags and classes are evidence beside that.  Blocks in navigation, footers, asides,
dialogs and reader comments (STRONG), or in forms and elements whose class, id or role
says advert, notice, sidebar and the like (WEAK), are boilerplate, and no neighbour of
blocks outside.  WEAK evidence gives way to dense blocks where a page has no other
text.  Classes of body, article, main and headings never mark anything.  Within an
article or main element only its own blocks are neighbours, and what stands outside of
it is dropped, unless the only dense blocks are there.  Where no neighbour is decided,
blocks within such an element are text, and so are those of a page without any.

A null page counts as empty and gives an empty text.  Scripts, styles and comments
are skipped unparsed; drawings, formulas, objects, templates and choices are parsed,
but say nothing; unclosed tags end with their parent; a quoted ">" ends no tag.  Work is
linear in the page's length, however deep its elements.  Repeated rows each get a row;
columns besides the named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .pretoken import groups

LONG, DENSE, LINKED = 80, 0.20, 0.5
GOOD, BAD, OPEN = 1, -1, 0
NONE, WEAK, STRONG = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe|textarea|title)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    # a quote opens a value after = only, and only if it is closed
    r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)"""
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STRONG = frozenset("nav header footer aside menu dialog button head option datalist".split())
_WEAK = frozenset("form fieldset".split())
_MAIN = frozenset("article main".split())
#: Elements whose class, id and role aren't looked at.
_UNMARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: What stands in these is no text and parts no block; they may end at "/>".
_FOREIGN = frozenset("svg math object template select".split())
#: Words of class, id and role that are evidence against the article.
_MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar aside widget related recommended recommendations footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login discussion share sharing social pagination pager copyright "
    "toolbar complementary contentinfo search skip skiplink".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Names that begin or end with these tell how a page is laid out or what is switched on, not what an element holds.
_PREFIXES, _STATES = frozenset("no not without with has is".split()), frozenset("open closed on off enabled disabled none count layout".split())
#: Function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and a to in is it that for was on are as with his they at be this have from or had by but not what all were we when your can said there an which their if will "
    "der die das und ist nicht ein eine einen dem den des im mit von zu auf für sich als auch an es aus bei nach wie er sie war oder "
    "le la les un une des et est dans que qui en du au aux pas pour par sur ne se ce il elle avec plus son sa ou mais "
    "el los las una y o de que en no por con para su al lo como más pero sus del es".split()
)


@dataclass
class Block:
    region: int  # number of the main element it stands in; 0: none
    evidence: int
    doubtful: bool = False  # its main element is marked as a comment
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    text: str = ""
    label: int = OPEN


def evidence_of(rest: str) -> tuple[int, bool]:
    """What an element's attributes say: how strongly, and whether of comments."""
    if not rest:
        return NONE, False
    found, comments = NONE, False
    for m in _ATTRIBUTE.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = re.findall("[a-z0-9]+", name)
            if len(words) > 1 and (words[0] in _PREFIXES or words[-1] in _STATES):
                continue
            if not _COMMENTS.isdisjoint(words):
                found, comments = STRONG, True
            elif not _MARKED.isdisjoint(words):
                found = max(found, WEAK)
    return (STRONG if _HIDDEN.search(rest) else found), comments


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, white space reduced, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, evidence, region, doubtful
    opened: Counter[str] = Counter()
    evidence, region, doubtful, regions, in_link = NONE, 0, False, 0, 0
    foreign = 0  # open elements of _FOREIGN
    block = Block(0, NONE)

    def flush() -> None:
        nonlocal block
        if block.parts:
            text = "".join(block.parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                block.text = text
                out.append(block)
        block = Block(region, evidence, doubtful)

    def say(text: str) -> None:
        if foreign:
            return
        block.parts.append(text)
        if in_link:
            block.linked += len(text.strip())

    def push(tag: str) -> None:
        nonlocal foreign
        stack.append((tag, evidence, region, doubtful))
        opened[tag] += 1
        foreign += tag in _FOREIGN

    def pop() -> str:
        nonlocal evidence, region, doubtful, foreign
        tag = stack.pop()[0]
        opened[tag] -= 1
        foreign -= tag in _FOREIGN
        _, evidence, region, doubtful = stack[-1] if stack else ("", NONE, 0, False)
        return tag

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a" and not foreign:
                in_link = 0
            if opened[tag]:
                if tag not in _INLINE or stack[-1][0] == tag:
                    while pop() != tag:
                        pass
                    if not foreign and tag not in _FOREIGN:
                        flush()
            elif tag not in _INLINE and tag not in _FOREIGN and not foreign:
                flush()
            continue
        rest = m["rest"]
        if tag in _FOREIGN or foreign and tag != "body":
            if tag not in _VOID and tag not in _INLINE and not rest.endswith("/"):
                push(tag)
            continue
        if tag in ("br", "hr", "img"):
            say(" ") if tag == "br" else None
            if tag != "hr":
                continue
        if tag == "a":
            in_link = 1
            block.links += 1
        own, comments = evidence_of(rest)
        if tag in _INLINE and not own:
            continue
        if tag in _VOID:
            flush()
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] in (tag, "p"):
            pop()
        if tag == "body":
            while stack:
                pop()
        if tag in _MAIN and not region and evidence < STRONG:
            regions += 1
            evidence, region, doubtful = NONE, regions, comments
        elif tag in _STRONG and not (tag == "header" and region):
            evidence = STRONG
        elif tag in _MAIN and comments:  # an article within an article
            evidence = STRONG
        elif tag in _WEAK:
            evidence = max(evidence, WEAK)
        if tag not in _UNMARKED:
            evidence = max(evidence, own)
        push(tag)
        flush()
    if at < len(page):
        say(page[at:])
    flush()
    return out


def is_dense(text: str, stop_words: Collection[str] = STOP_WORDS) -> bool:
    if len(text) < LONG:
        return False
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in stop_words for w in words) >= DENSE * len(words)


def first_pass(blocks: list[Block], stop_words: Collection[str] = STOP_WORDS) -> None:
    """Labels by link density, length and stop words, and by the evidence of tags and classes."""
    linked = [b.linked > LINKED * len(b.text) and (b.links > 1 or not b.region) for b in blocks]
    dense = [not x and is_dense(b.text, stop_words) for b, x in zip(blocks, linked)]
    for b, many, prose in zip(blocks, linked, dense):
        b.label = BAD if many or b.evidence else GOOD if prose else OPEN
    if any(b.region and not b.doubtful and b.label != BAD for b in blocks):
        for b in blocks:
            b.label = BAD if b.doubtful else b.label
    elif not any(b.region and b.label != BAD or b.label == GOOD for b in blocks) and any(b.evidence == WEAK and prose for b, prose in zip(blocks, dense)):
        for b, many, prose in zip(blocks, linked, dense):
            if b.evidence == WEAK and not many:
                b.evidence, b.label = NONE, GOOD if prose else OPEN


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided neighbour."""
    good = {bool(b.region) for b in blocks if b.label == GOOD}
    named = any(b.region and b.label != BAD for b in blocks)
    if True in good or named and False not in good:
        for b in blocks:
            b.label = b.label if b.region else BAD
    one_page = named and good == {False}  # the dense blocks aren't in the article elements: then these decide nothing
    n = len(blocks)
    before: list[tuple[int, int]] = [(n + 1, OPEN)] * n
    after = list(before)
    for seen, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        near: dict[int, int] = {}
        for i in order:
            b = blocks[i]
            where = 0 if one_page else b.region
            if b.label == OPEN:
                j = near.get(where)
                if j is not None:
                    seen[i] = (abs(i - j), blocks[j].label)
            elif not b.evidence and (b.region or not named or one_page):
                near[where] = i
    for b, (da, la), (dz, lz) in zip(blocks, before, after):
        if b.label == OPEN:
            b.label = GOOD if la == lz == OPEN else la if da < dz else lz if dz < da else max(la, lz)


def main_text(page: str, stop_words: Collection[str] = STOP_WORDS) -> str:
    blocks = blocks_of(page)
    first_pass(blocks, stop_words)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label == GOOD)


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stop_words: Collection[str] = STOP_WORDS) -> DataFrame:
    """<id>, <url>, text, n_chars per row.  stop_words: those of the pages' languages, in lower case."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 2):
            texts = [main_text(t, stop_words) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), text_of(html_col).alias("_html"))
    return rows.mapInArrow(extract, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(read_table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extract": op9_html_extract}
