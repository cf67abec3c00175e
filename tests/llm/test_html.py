"""Main text of pages."""

import html
import re
import time

import pytest

from threatloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="a">One</a><li><a href="b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this page, please accept all of them now.</div><!-- x > y -->
%s
<aside><p>Related things that are not the article at all.</p></aside><form><p>Your name</p><input name=q></form>
<section id="comments"><h3>Comments</h3><p>A reader says that this is a fine article, very long indeed, and more.</p></section>
<footer>&copy; someone</footer></body></html>"""


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>A &amp; B</h1><p>First   <b>bold</b>\n text.<p>Second &lt;p&gt;<br>line</article>", "A & B\nFirst bold text.\nSecond <p> line"),
        ("<main><div><div><p>One paragraph only, of some length, in nested boxes.</p></div></div></main>", "One paragraph only, of some length, in nested boxes."),
        ("<div><p><b>Never closed<br><p>Another paragraph here</div>", "Never closed\nAnother paragraph here"),
        ("<article><ul><li>a first point<li>a second point</ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>", "a first point\na second point\nc1\nc2\nc3"),
        ("<article><p>Text <a href='x'>with a link</a> inside.</p><script>bad()</script><p>End &#233;&nbsp;x</p></article>", "Text with a link inside.\nEnd é\xa0x"),
    ],
)
def test_articles(body, text):
    assert html_text.main_text(PAGE % body) == text


def test_density_picks_the_article_without_marked_elements():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30))
    body = "".join(f"<p>{'A sentence of the article goes here. ' * 6}</p>" for _ in range(5))
    text = html_text.main_text(f"<body><div><ul>{links}</ul></div><div>{body}</div><div><span>x</span><a href=y>y</a></div></body>")
    assert text.count("\n") == 4 and "link number" not in text


STORY = "<article>%s<h1>Headline</h1><p>" + "A sentence of the article goes here. " * 6 + "</p></article>"
WANT = "Headline\n" + ("A sentence of the article goes here. " * 6).strip()


@pytest.mark.parametrize(
    "around",
    [
        '<div class="content-sidebar-wrap">%s</div>', '<div class="has-sidebar">%s</div>', '<div class="social issues">%s</div>', '<div id="page-with-comments"><div>%s</div></div>',
        '<form id="aspnetForm">%s</form>', '<div role="form">%s<div class="sidebar">Not this one.</div></div>',
    ],
)
def test_wrappers_of_the_whole_article_stay(around):
    assert html_text.main_text(PAGE % (around % (STORY % ""))) == WANT


def test_headers_in_an_article_and_hidden_parts():
    assert html_text.main_text(PAGE % (STORY.replace("<h1>Headline</h1>", '<header class="entry-header"><h1>Headline</h1></header>') % "")) == WANT
    assert html_text.main_text(PAGE % (STORY.replace("<h1>Headline</h1>", '<div class="article-header"><h1>Headline</h1></div>') % "")) == WANT
    assert html_text.main_text(PAGE % (STORY % "<a hidden>not seen</a><p hidden=''>nor this</p><p aria-hidden='true'>nor that</p>")) == WANT
    notes = "".join(f"<article class='comment'><p>{'A reader wrote quite a lot about it. ' * 9}</p></article>" for _ in range(4))
    for around in ("%s", "<section class='comment-list'>%s</section>"):
        assert html_text.main_text(PAGE % ((STORY % "") + around % notes)) == WANT
    advert = '<div class="ad">An advert that is longer than the short story.</div><article><h1>Short</h1></article>'
    assert html_text.main_text(f"<body>{advert}</body>") == "Short"


def test_sibling_articles_are_all_returned():
    teaser = '<div><article><a href="/1">Another story</a></article><article><a href="/2">And one more</a></article></div>'
    assert html_text.main_text(PAGE % ((STORY % "") * 3 + teaser)) == "\n".join([WANT] * 3)


def plain_density(node):
    """(density by the formula, from whole walks of the subtree) of a node; counts what ``weigh`` adds up."""
    def walk(n, linked):
        c = sum(len(x.replace(" ", "").replace("\n", "")) for x in n.children if isinstance(x, str))
        linked = linked or n.tag == "a"
        sums = [c, 0, c if linked else 0, 0]
        for child in n.children:
            if not isinstance(child, str) and not child.out:
                below = walk(child, linked)
                sums = [a + b for a, b in zip(sums, (below[0], below[1] + 1, below[2], below[3] + (linked or child.tag == "a")))]
        return sums

    return walk(node, False)


def test_densities_equal_plain_walks():
    import math
    import random

    rng = random.Random(4)

    def some(depth):
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.randint(0, 12)
        tag = rng.choice(["div", "section", "b", "ul", "a"])
        return f"<{tag}>" + "".join(some(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    for _ in range(60):
        _, nodes = html_text.parse(f"<body>{some(5)}{some(4)}</body>")
        html_text.weigh(nodes)
        body = next(n for n in nodes if n.tag == "body")
        plain = {id(n): plain_density(n) for n in nodes}
        c, _, lc, _ = plain[id(body)]
        share = lc / c if c else 0.0
        inside = set()
        for n in nodes:
            if n.parent is not None and (n.parent.tag == "a" or id(n.parent) in inside):
                inside.add(id(n))  # links in links are broken markup, counted by the outermost
        density = {}
        for n in nodes:
            c, t, lc, lt = plain[id(n)]
            if n.tag == "a":
                lt += 1
            if c and id(n) not in inside and n.chars:
                assert (n.chars, n.tags) == (c, t)
                assert n.link_chars == lc
                t, lt = max(1, t), n.link_tags
                density[id(n)] = c / t * math.log(max(1.0, c / max(1, lc) * (t / max(1, lt)))) / math.log(c / max(1, c - lc) * lc + share * c + math.e)
                assert n.density == pytest.approx(density[id(n)])
        for n in nodes:
            if id(n) in density:
                sums = sum(x.density for x in n.children if not isinstance(x, str) and not x.out and x.tag not in html_text.INLINE)
                assert n.sum == pytest.approx(sums or n.density)


def test_odd_pages():
    assert html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("plain &amp; text") == "plain & text"
    assert html_text.main_text("<div>open <b>tags") == "open tags"
    assert html_text.main_text("<p>a</p><!-- never ends <p>b</p>") == "a"
    assert html_text.main_text("<head><title>x</title><body><p>no head end</p>") == "no head end"


def test_work_is_linear():
    started = time.time()
    for page in ("<div>" * 50_000 + "x", "<a href='" * 20_000, "<p>" * 50_000, "<li>" * 50_000, "<" * 100_000, "<b>" * 50_000 + "<p>x" * 1000, "<a " * 50_000 + ">"):
        html_text.main_text(page)
    assert time.time() - started < 60


def test_pages_of_the_table(spark):
    from conftest import FOLDER

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_table_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "v", "<p>a</p>", None), (2, "v", "<p>a</p>", None)], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "v", "a", 1), (2, "v", "a", 1)], key=str)
    assert html_text.extract_text(pages.limit(0)).collect() == []
