import html
import html.parser as html_parser
import random

from stratablock.llm.html_extract import STOP_WORDS, html_extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now.</div>
<article><h1>A &lt;title&gt;</h1><p><b>It is</b> the&nbsp;first
 one.<br>Next<p>Ti.</p><div class="share-box">Share me</div><aside>More to read</aside><form>Name <input name=x></form>
<ul class="menu"><li><a href="1">One</a><li><a href="2">Two</a></ul><p>&eacute;nd &#233;</article>
<section id="comments"><p>I was the first reader of this and it is a comment that is long enough to be taken for a text.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "A <title> It is the first one. Next Ti. énd é"


def test_without_article():
    text = "This is the first of the paragraphs that are long enough and that have many of the words which are in all texts."
    page = f"<body><div id=nav><a href=a>Start</a></div><div><h2>Head line</h2><p>{text}</p><p>Short one.</p><p>{text}</p></div><div class='footer'>All rights</div>"
    assert main_text(page) == f"Head line {text} Short one. {text}"


def test_odd_pages():
    assert main_text("") == ""
    assert main_text("just a few words") == "just a few words"
    assert main_text("<article>That it.") == "That it."
    assert main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert main_text("<script>never closed <p>x") == ""
    assert main_text("<div" * 20_000) == ""
    assert main_text("<article>" + "<b>" * 20_000 + "x") == "x"
    assert main_text("<!-- <p>x</p>") == ""
    assert main_text("<div class=ad>never closed <article><p>Kept</article>") == "Kept"


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (3, "w", "<article>" + "word " * 200_000, "z")]
    got = sorted(map(tuple, html_extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=str)
    want = [(i, u, main_text(h or ""), len(main_text(h or ""))) for i, u, h, _ in rows]
    assert got == sorted(want, key=str)
    assert html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_references_are_decoded_once():
    assert main_text(f"<article><p>{html.escape('&amp; <b>')}</article>") == "&amp; <b>"


def test_drawings_and_the_like_end():
    for tag in ("svg", "math", "object", "template", "select"):
        assert main_text(f'<article><p>one</p><{tag} class="i"/><p>two</p></article>') == "one two"
        assert main_text(f"<article><p>one <{tag}><g><p>not</p><title>nor</title><b>this</b></g> or that</{tag}> two</p><p>three</article>") == "one two three"
        assert main_text(f"<div><article><p>one<{tag}>not</article><p>out</div><article>two") == "one two"
        assert main_text(f"<{tag}><article>not</article></{tag}><article>one") == "one"
    assert main_text("<article><svg><svg/><path d=x /><a>not</a></svg>one</article>") == "one"
    assert main_text("<article>" + "<svg/>" * 20_000 + "x") == "x"


PROSE = "This is the first of the paragraphs that are long enough and that have many of the words which are in all texts."
SPARSE = "Words without meaning stand here; nothing binds them, nobody reads such lists: apples, pears, plums, cherries, grapes."


def test_marks_that_are_none():
    """Layout classes, and classes of body, article and headings, blank nothing."""
    assert main_text(f"<body class='no-sidebar'><div><p>{PROSE}</p></div></body>") == PROSE
    assert main_text("<article class='post comments-open'><p>Hello there</p></article>") == "Hello there"
    assert main_text("<article><h1 class='article-header'>Head</h1><p>x</p></article>") == "Head x"
    assert main_text("<article><p title='a>b' id=\"c>d\">Text</p><p>don't = 'x</p></article>") == "Text don't = 'x"
    assert main_text(f"<body class=widget><div class=widget><p>{PROSE}</p><p>Short.</p></div><nav>Menu</nav>") == f"{PROSE} Short."
    assert main_text(f"<div class=widget><p>{PROSE}</p></div><article>Short.</article>") == "Short."


def test_comments_are_left_out():
    assert main_text(f"<article><p>A</p><article class=comment>{PROSE}</article></article>") == "A"
    assert main_text(f"<article>A</article><section id=comments><article><p>{PROSE}</p></article></section>") == "A"
    assert main_text(f"<article class='comment'>{PROSE}</article><article>A</article>") == "A"


def test_ties_and_neighbours():
    menu = "<ul><li><a href=1>One thing</a> <a href=2>Two</a></ul>"
    assert main_text(f"<div><p>{PROSE}</p><p>tie</p>{menu}</div>") == f"{PROSE} tie"
    assert main_text(f"<div><p>{PROSE}</p><p>near</p><p>far</p>{menu}</div>") == f"{PROSE} near"
    assert main_text(f"<div>{menu}<p>{SPARSE}</p></div><div><p>{PROSE}</p><p>{SPARSE}</p></div>") == f"{SPARSE} {PROSE} {SPARSE}"
    assert main_text(f"<div>{menu}<p>{SPARSE}</p><p>x</p></div><div><p>{PROSE}</p></div>") == f"x {PROSE}"


def test_each_rule_matters(monkeypatch):
    """Without stop words, without length or without link density, the result is another."""
    import stratablock.llm.html_extract as H

    page = f"<div><p><a href=1>{PROSE}</a> <a href=2>x</a></p><p>This is it</p><p>{SPARSE}</p><p>y</p></div><div><p>{PROSE}</p><p>Last.</p></div>"
    want = f"{SPARSE} y {PROSE} Last."
    assert main_text(page) == want
    assert main_text(page, frozenset()) != want
    for name, value in (("LONG", 10**9), ("LONG", 1), ("LINKED", 2), ("DENSE", 0)):
        with monkeypatch.context() as m:
            m.setattr(H, name, value)
            assert H.main_text(page) != want, name


def test_pages_without_their_tags(tmp_path):
    """With all container tags of real pages made to plain ones, stop words, length and links still find the text."""
    import os
    import re
    from collections import Counter

    import pyarrow.parquet as pq
    import pytest

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("the tables aren't here")
    pages = [h or "" for h in pq.read_table(path)["html"].to_pylist()]
    bare = [re.sub("<(/?)(nav|article|footer)", r"<\1div", re.sub(" class=[^>]*", "", h)) for h in pages]
    want = [Counter(main_text(h).split()) for h in pages]

    def shares(texts):
        got = [Counter(t.split()) for t in texts]
        both = sum((a & b).total() for a, b in zip(got, want))
        return both / max(1, sum(a.total() for a in got)), both / sum(b.total() for b in want)

    precision, recall = shares([main_text(h) for h in bare])
    assert precision > 0.95 and recall > 0.9
    assert max(shares([main_text(h, frozenset()) for h in bare])) < 0.05


class Tree(html_parser.HTMLParser):
    """A page as nested lists: [tag, attributes, children], texts being strings."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open = [["", {}, []]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.open.append([tag, dict(attrs), []])
        self.open[-2][2].append(self.open[-1])

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_blocks(page):
    """(text, characters in links, links, evidence, main element) of each block, by recursion over the tree."""
    out, now = [], {"text": "", "linked": 0, "links": 0}

    def end(evidence, main):
        if now["text"].split():
            out.append((" ".join(now["text"].split()), now["linked"], now["links"], evidence, main))
        now.update(text="", linked=0, links=0)

    def walk(node, evidence, main, link):
        tag, attrs, children = node
        for child in children:
            if isinstance(child, str):
                now["text"] += child
                now["linked"] += len(child.strip()) if link else 0
            elif child[0] in ("a", "b"):
                now["links"] += child[0] == "a"
                walk(child, evidence, main, link or child[0] == "a")
            else:
                end(evidence, main)
                inner, region = evidence, main
                if child[0] == "article" and not main and evidence < 2:
                    inner, region = 0, id(child)
                elif child[0] in ("nav", "aside", "footer") or "comments" in child[1].get("class", "").split():
                    inner = 2
                elif child[0] == "form" or child[0] == "div" and {"ad", "widget"} & set(child[1].get("class", "").split()):
                    inner = max(inner, 1)
                walk(child, inner, region, link)
                end(inner, region)

    walk(Tree(page).open[0], 0, 0, False)
    end(0, 0)
    return out


def plain_text(page):
    """The rules stated again, each ambiguous block looking at all others."""
    found = plain_blocks(page)
    many = [linked > len(t) / 2 and (links > 1 or not main) for t, linked, links, _, main in found]
    dense = [not m and len(b[0]) >= 80 and sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in b[0].lower().split()) >= 0.2 * len(b[0].split()) for b, m in zip(found, many)]
    evidence, main = [b[3] for b in found], [b[4] for b in found]
    say = ["bad" if m or e else "good" if d else "" for m, e, d in zip(many, evidence, dense)]
    if not any(x == "good" or a and x != "bad" for x, a in zip(say, main)) and any(e == 1 and d for e, d in zip(evidence, dense)):
        say = [("good" if d else "") if e == 1 and not m else x for x, e, d, m in zip(say, evidence, dense, many)]
        evidence = [0 if e == 1 and not m else e for e, m in zip(evidence, many)]
    named = any(a and x != "bad" for x, a in zip(say, main))
    inside, outside = (any(x == "good" and bool(a) == side for x, a in zip(say, main)) for side in (True, False))
    apart = named and (inside or not outside)
    if apart:
        say = [x if a else "bad" for x, a in zip(say, main)]
    kept = []
    for i, (block, x) in enumerate(zip(found, say)):
        if not x:
            near = [(abs(i - j), say[j] != "good") for j in range(len(found)) if say[j] and not evidence[j] and (not apart or main[j] == main[i])]
            x = "bad" if near and min(near)[1] else "good"
        if x == "good":
            kept.append(block[0])
    return " ".join(kept)


def random_page(rng):
    def text():
        kind = rng.random()
        if kind < 0.3:
            return " ".join(rng.choices(PROSE.split(), k=rng.randint(12, 40)))
        return " ".join(rng.choices(SPARSE.split(), k=rng.randint(12, 30) if kind < 0.5 else rng.randint(1, 6)))

    def inline():
        return "".join(rng.choice(["{} ", "{} ", "<b>{}</b> ", "<a href='x>y'>{}</a> "]).format(text()) for _ in range(rng.randint(1, 3)))

    def part(depth):
        kind = rng.random()
        if kind < 0.55 or depth > 3:
            return f"<p>{inline()}</p>"
        tag = rng.choice(["div", "div", "div class='ad'", "div class=widget", "article", "nav", "aside", "footer", "form", "section class=comments", "ul", "li", "div class=content"])
        return f"<{tag}>{''.join(part(depth + 1) for _ in range(rng.randint(0, 4)))}</{tag.split()[0]}>"

    return "".join(part(0) for _ in range(rng.randint(1, 6)))


def test_against_a_plain_version():
    rng = random.Random(5)
    for _ in range(3000):
        page = random_page(rng)
        assert main_text(page) == plain_text(page), page


def test_deep_pages_take_linear_time():
    import time

    def spent(n):
        began = time.perf_counter()
        main_text("<div>" * n + "x" + "</p></b>" * n + "</div>" * n)
        return time.perf_counter() - began

    spent(1000)
    assert spent(40_000) < 16 * max(spent(5_000), 0.02)
