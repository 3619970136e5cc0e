import html
import re
import time

import pytest
from llm_helpers import words

from tagloom.llm import html_text, queries
from tagloom.llm.html_text import main_text


def article_of(page):
    """The article of the tables' pages, whose blocks are p and h1, by cutting at tags."""
    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1]).replace("<br>", " ")
    blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_query_on_tables(spark, sf):
    got = {r["page_id"]: r for r in queries.op12_html_extraction(spark, sf).collect()}
    pages = queries.table(spark, sf, "pages").collect()
    assert len(got) == len(pages) > 0
    for p in pages:
        r = got[p["page_id"]]
        assert r["text"] == article_of(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def paragraphs(rng, n, size=40):
    return [words(rng, rng.randint(size // 2, size)) + "." for _ in range(n)]


def p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


NOISE = {
    "menu": '<ul class="main-nav">' + "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(9)) + "</ul>",
    "header": '<header><a href="/">Site</a> <span>the best news of the whole world since ever</span></header>',
    "footer": "<footer><p>Copyright by us, all rights are reserved, for ever and a day and in all lands.</p></footer>",
    "sidebar": '<div id="sidebar"><h3>More</h3><p>A rather long teaser text that sounds like an article but is none at all.</p></div>',
    "aside": "<aside><p>Did you know that there is much more to read than this page has?</p></aside>",
    "notice": '<div class="cookie-notice">We use cookies to give you the best of all experiences here.</div>',
    "advert": '<div class="adBox ad-slot-3"><p>Buy this now, it is cheap and good and you will not regret it.</p></div>',
    "form": '<form action="/s"><label>Search <input name="q"></label><textarea>type here</textarea><button>Go</button></form>',
    "script": '<script>var t="</p><p>no text</p>"; if (a < b) {}</script><style>p > b {color: red}</style><noscript>Turn it on</noscript>',
    "comments": '<section id="comments"><h2>2 comments</h2>' + "".join(f"<div><p>{'I do agree with all that was said here. ' * 20}</p></div>" for _ in range(30)) + "</section>",
    "comment": "<!-- <p>not to be seen</p> -->",
    "hidden": '<div style="display: none"><p>nobody sees this text at all, so it is no part of it</p></div>',
}


@pytest.mark.parametrize("tag", ["article", "div", "main", "section", 'div class="content has-sidebar"', 'td class="post-body"'])
@pytest.mark.parametrize("kind", sorted(NOISE))
def test_each_kind_of_noise_goes(tag, kind, rng):
    texts = paragraphs(rng, 7)
    name = tag.split()[0]
    body = f"<{tag}><h1>A title</h1>{p(texts[:3])}<h2>Part</h2>{p(texts[3:])}</{name}>"
    body = f"<table><tr>{body}</tr></table>" if name == "td" else body
    want = "\n".join(["A title", *texts[:3], "Part", *texts[3:]])
    for page in (f"{NOISE[kind]}{body}", f"{body}{NOISE[kind]}", f"<div>{NOISE[kind]}{body}</div>", f"<div>{body}{NOISE[kind]}{NOISE['menu']}</div>"):
        assert main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == want


def test_noise_inside_an_article(rng):
    texts = paragraphs(rng, 4)
    page = f"<article><header><h1>Head</h1></header>{p(texts[:2])}{NOISE['advert']}{NOISE['script']}{NOISE['aside']}{p(texts[2:])}<p>Short.</p>{NOISE['comments']}{NOISE['form']}</article>"
    assert main_text(page) == "\n".join(["Head", *texts, "Short."])


def test_unnamed_links_lose_by_density(rng):
    texts = paragraphs(rng, 6)
    lists = "<div>" + "".join(f'<p><a href="/{k}">Another page with number {k}</a></p>' for k in range(40)) + "</div>"
    assert main_text(f"<body>{lists}<div>{p(texts)}</div>{lists}</body>") == "\n".join(texts)


def test_other_sections_above_the_threshold_stay(rng):
    a, b = paragraphs(rng, 9, 60), paragraphs(rng, 3, 60)
    links = "<div>" + "".join(f'<a href="/{k}">item {k}</a> ' for k in range(60)) + "</div>"
    assert main_text(f"<body>{links}<div><div><h2>One</h2>{p(a)}</div><div><h2>Two</h2>{p(b)}</div></div>{links}</body>") == "\n".join(["One", *a, "Two", *b])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""), ("plain text &amp; more", "plain text & more"), ("<p>a<p>b", "a\nb"), ("<p>a &lt;b&gt; &#233;&#xe9;&eacute;&copy &unknown; &am</p>", "a <b> ééé© &unknown; &am"),
        ("<p>  a\n\t b&nbsp;c<br>d </p>", "a b c d"), ("<ul><li>one<li>two <b>bold</b>text</ul>", "one\ntwo boldtext"), ("<table><tr><td>x<td>y<tr><td>z</table>", "x\ny\nz"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("<p title='x > y' data-a=\"<p>\">q</p>", "q"), ("<p title=it's>a</p><p>it's b</p>", "a\nit's b"), ("a < b and c <3", "a < b and c <3"),
        ("<p>open <b>bold<p>next</b> one", "open bold\nnext one"), ("</p></div>x</span>", "x"), ("<p>a<!-- b --!>c<!-->d<!-- e", "acd"), ("<p>x<script>y", "x"), ("<P CLASS=A>U</P>", "U"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"), ("<p>a <span hidden>b</span>c</p>", "a c"), ("<a href=x><div>in</div></a><p>out</p>", "in\nout"), ("<head><title>t</title><p>text", "text"),
        ("<form><p>all is in a form</p></form>", "all is in a form"), ("<nav>only a menu</nav>", ""), ("<?xml version='1'?><p>x</p><![CDATA[y]]>", "x"), ("<pre>a\n  b</pre>", "a b"), ("<p>x</p\n>y<", "x\ny<"),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


def test_long_and_deep_pages():
    began = time.time()
    assert len(main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000)) == 4
    assert main_text("<b>" * 50_000 + "x" + "</i>" * 50_000) == "x"
    assert len(main_text("<p>" + "long text " * 500_000)) == 4_999_999
    assert len(main_text("<p>ab</p>" * 100_000).split("\n")) == 100_000
    main_text('<p x="' * 20_000), main_text("<!-" * 50_000), main_text("<" * 100_000), main_text("<a " * 50_000), main_text("</" * 50_000), main_text("<p =" * 30_000)
    assert time.time() - began < 60


def test_table_cases(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "n"), (1, "u", "<p>a</p>", "n"), (None, None, None, None), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract_text(df.limit(0)).count() == 0
