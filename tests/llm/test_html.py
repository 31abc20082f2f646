import html
import math
import random
import re
from xml.etree import ElementTree

import pytest

from mediaquarry.llm.html import extract, main_texts, op7_html_text

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=x>Home</a></header><div id="cookie-notice">We use cookies to make this site work better for you.</div>
<div id=page><ul class="main-menu"><li><a href=1>One</a><li><a href=2>Two</a></ul><div class="content"><h1>My title &amp; more</h1><div class="text"><p>First  para with <a href=q>link</a> and <b>bold</b>
text goes on for a good while, so that it counts.<p>Second para, it is also rather long; it says a lot of things &lt;here&gt; that matter.<script>var x="<p>no</p>";</script> 3 < 4 ok<ul><li>item one of the list<li>item two</ul></div></div>
<div class="sidebar"><p>Popular posts of the week and other things to read.</p></div><form><label>Mail</label><input></form><section class="comments"><p>Great article, thanks a lot for it, I like this very much indeed!</p></section></div><footer>(c) us</footer>"""


def test_a_page_without_an_article():
    assert extract(PAGE).split("\n") == [
        "My title & more", "First para with link and bold text goes on for a good while, so that it counts.",
        "Second para, it is also rather long; it says a lot of things <here> that matter. 3 < 4 ok", "item one of the list", "item two",
    ]


def test_an_article_with_everything_around_it():
    body = "".join(f"<p>Sentence number {i} of the story, told at some length for the reader.</p>" for i in range(6))
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><main><article><header><h1>Head</h1></header>
    {body}<aside>Related things</aside><div class="ad-slot">Buy now</div><table><tr><td>cell one<td>cell two</table><div class="comments"><p>First!</p></div></article></main>
    <div class="newsletter">Sign up for our letter, it comes every single week of the year.</div><footer>x</footer></body></html>"""
    want = ["Head", *(f"Sentence number {i} of the story, told at some length for the reader." for i in range(6)), "cell one", "cell two"]
    assert extract(page).split("\n") == want


def test_names_of_what_holds_the_article_say_nothing():
    story = "".join(f"<p>Paragraph {i} goes on for quite some time about the matter at hand.</p>" for i in range(4))
    text = "\n".join(f"Paragraph {i} goes on for quite some time about the matter at hand." for i in range(4))
    side = '<div class="sidebar"><h2>More</h2><p>Things to read elsewhere on this fine site.</p></div>'
    assert extract(f'<body><div class="layout sidebar-right"><article>{story}</article></div>{side}</body>') == text
    assert extract(f'<body><div class="page with-sidebar"><h1>T</h1>{story}{side}</div></body>') == "T\n" + text
    comments = '<div id="commentList">' + '<article class="comment"><p>I have a very long opinion on all of this and will not keep it to myself at all.</p></article>' * 9 + "</div>"
    assert extract(f'<body><div class="header"><h1>Site</h1></div><article class="post"><h1>T</h1>{story}{comments}</article></body>') == "T\n" + text
    assert extract(f'<body><div class="content"><h1>T</h1>{story}</div>{comments}</body>') == "T\n" + text


@pytest.mark.parametrize("tag", ["div", "article"])
def test_text_in_several_blocks_of_the_body(tag):
    blocks = [[f"Part {b} paragraph {i} goes on for quite some time about the matter at hand." for i in range(8)] for b in range(2)]
    page = "".join(f"<{tag}>" + "".join(f"<p>{p}</p>" for p in block) + f"</{tag}>" for block in blocks)
    assert extract(f"<body>{page}<footer>x</footer></body>").split("\n") == sum(blocks, [])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a</p>", "a"), ("<", "<"), ("a < b", "a < b"), ("<!-- x", ""), ("<script>x", ""), ("<p>a<br>b</p>", "a b"),
        ("<p>&eacute;&#x41;&amp;lt;&nbsp;x</p>", "éA&lt; x"), ("<div>" * 20_000 + "deep", "deep"), ("<p hidden>no</p><p>yes</p>", "yes"), ('<p title="a > b">t</p>', "t"),
        ("<p>one</p>\n\n<p> two\n three </p>", "one\ntwo three"), ("<nav>only menu</nav>", ""), ("</p></div>", ""), ("<a \"", '<a "'),
    ],
)
def test_small_pages(page, text):
    assert extract(page) == text


def test_long_pages_take_linear_time():
    assert len(extract("<p>" + "word " * 400_000 + "</p>")) == 5 * 400_000 - 1
    assert len(extract("<p>x</p>" * 50_000).split("\n")) == 50_000


def test_odd_pages(spark):
    rows = [(1, "u", None, 5), (None, None, "<p>x</p>", 5), (3, "u", "<p>x</p>", None), (3, "u", "<p>x</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [tuple(r) for r in main_texts(df).collect()]
    assert got == [(1, "u", "", 0), (None, None, "x", 1), (3, "u", "x", 1), (3, "u", "x", 1)]
    assert main_texts(df.limit(0)).count() == 0


def article(page):
    """The text of a page of the tables, which hold theirs in one article of headings and paragraphs."""
    body = page.split("<article>")[1].rsplit("</article>")[0]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>|<br>", " " if "<br>" in b else "", b))).strip() for b in re.split("</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in op7_html_text(spark, folder).collect():
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_density_decides(spark):
    """All pages come out right without a tag that names the article, and nearly all without class names as well."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    assert all(extract(p) == article(q) for p, q in zip(plain, pages, strict=True))
    bare = [re.sub(r' class="[^"]*"', "", p) for p in plain]
    assert sum(extract(p) == article(q) for p, q in zip(bare, pages, strict=True)) >= 0.97 * len(pages)


def composite(root):
    """The main text of a tree of elements, by the definition: each figure is counted anew from all that an element holds."""
    size = lambda e: len("".join(e.itertext()).replace("\n", ""))
    links = lambda e: [x for x in e.iter() if x.tag == "a"]
    above = {child: e for e in root.iter() for child in e}
    overall = sum(map(size, links(root))) / max(1, size(root))

    def density(e):
        c, t = size(e), max(1, sum(1 for _ in e.iter()) - 1)
        if not c:
            return 0.0
        inside = c if e.tag == "a" else sum(map(size, links(e)))
        lt = len(links(e)) - (e.tag == "a")
        base = math.log(math.log(c / max(1, c - inside) * inside + overall * c + math.e))
        return c / t * math.log(max(math.e, c / max(1, inside) * t / max(1, lt))) / (base if overall and base > 1e-6 else 1.0)

    blocks = [e for e in root.iter() if e.tag not in ("a", "b") and size(e)]
    of = {e: density(e) for e in blocks}
    total = {e: sum(of.get(c, 0.0) for c in e) for e in blocks}
    best = max(blocks, key=lambda e: (total[e], of[e], -blocks.index(e)))
    path = [best]
    while path[-1] is not root:
        path.append(above[path[-1]])
    threshold = min(of[e] for e in path)
    taken = [e for e in blocks if e is best or (e not in path and above.get(e) in path and above[e] is not best and (e.tag == "h2" or of[e] >= threshold))]
    return "\n".join("".join(p.itertext()).replace("\n", "") for e in root.iter() if e in taken for p in e.iter() if p.tag in ("p", "h2"))


@pytest.mark.parametrize("seed", range(40))
def test_densities_as_by_their_definition(seed):
    """Random pages of nested parts whose text lies in paragraphs and headings, some of it in links and bold."""
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))

    def paragraph():
        tag = rng.choice(("p", "p", "p", "h2"))
        parts = [rng.choice(("{}", "{}", "<b>{}</b>", '<a href="x">{}</a>')).format(words(rng.randint(1, 12))) for _ in range(rng.randint(1, 3))]
        return f"<{tag}>{' '.join(parts)}</{tag}>"

    def part(depth):
        return "<div>" + "".join(part(depth - 1) if depth and rng.random() < 0.4 else paragraph() for _ in range(rng.randint(1, 5))) + "</div>"

    page = "<body>" + "".join(part(3) for _ in range(rng.randint(1, 5))) + "</body>"
    assert extract(page) == composite(ElementTree.fromstring(page))
