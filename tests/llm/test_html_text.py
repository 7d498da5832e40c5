import html
import re
import time

from twinframe.llm.html_text import article_blocks, main_text


def text_of(page):
    return " ".join(article_blocks(page))


def plain_article(page):
    """Text of the one article element of the tables' pages, whose blocks are p and h1."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    words = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks)
    return " ".join(filter(None, words))


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    from twinframe.llm.queries import QUERIES

    got = QUERIES["op2_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


PARAGRAPH = "A sentence of some length, with a comma, stands here. Another one follows it; it is no shorter."


def test_layout_without_semantic_elements():
    page = (
        "<html><body><div class='menu'><a href='/a'>Home</a> <a href='/b'>News</a></div>"
        "<div id=top-banner>Buy this now, it is cheap. Really, it is.</div><div class='x1'><div class='story'>"
        f"<h2>Head &amp; line</h2><div>{PARAGRAPH}</div><div>{PARAGRAPH}</div><div>Short one.</div></div></div>"
        "<div class='comments'><p>I like this article, really. It is good.</p></div><div class='foot-er'>x</div></body></html>")
    assert text_of(page) == f"Head & line {PARAGRAPH} {PARAGRAPH} Short one."


def test_names_of_wrappers_do_not_count():
    page = (
        "<body><div class='header'>Site name, and more.</div><div class='page has-sidebar'><div class='with-nav'>"
        f"<div class='post-header comments-open'><h1>Title</h1></div><div class='text'><p>{PARAGRAPH}<p>{PARAGRAPH}</div>"
        "<div class='left-sidebar'><p>Another text, not of the article.</p></div></div></div></body>")
    assert text_of(page) == f"Title {PARAGRAPH} {PARAGRAPH}"


def test_semantic_elements_are_left_out():
    page = (
        f"<body><header><h1>Site</h1></header><nav>Menu</nav><main><article><header><h1>Title</h1></header><p>{PARAGRAPH}"
        f"<form><label>Mail, please.</label><input></form><aside>See also, please.</aside><p hidden>no</p><p>{PARAGRAPH}</article>"
        "<section id='comments'><p>First, of course!</p></section></main><footer>Imprint, all of it.</footer></body>")
    assert text_of(page) == f"Title {PARAGRAPH} {PARAGRAPH}"


def test_inline_white_space_and_references():
    page = (
        f"<article><p>one<b>two</b> <i>three</i>\n\t four<br>five &lt;b&gt; &#x41;&#66;&nbsp;&eacute;&amp <!-- no -->six"
        f"<script>var x = '</p>';</script><style>p{{}}</style></p><p>{PARAGRAPH}</p></article>")
    assert text_of(page).startswith("onetwo three four five <b> AB é& six A sentence")


def test_no_part_of_the_article_is_left_behind():
    many = f"<p>{PARAGRAPH}</p>" * 9
    text = " ".join([PARAGRAPH] * 9)
    for tag in ("article", "main"):
        around = "<body><div class='foot-er'>x</div><{0}>{1}</{0}></body>"
        assert text_of(around.format(tag, f"<section>{many}</section><section><p>{PARAGRAPH}</p></section>")) == f"{text} {PARAGRAPH}"
        assert text_of(around.format(tag, f"<section><h1>T</h1>{many}</section><section><p>End.</p></section>")) == f"T {text} End."
        items = many.replace("p>", "li>")
        assert text_of(around.format(tag, f"<h2>T</h2><p>Intro.</p><ul>{items}</ul><p>End.</p>")) == f"T Intro. {text} End."
    page = f"<body><div class='x'>Home</div><div><div>{many}</div><div><b><p>{PARAGRAPH}</p></b></div></div></body>"
    assert text_of(page) == f"{text} {PARAGRAPH}"


def test_marks_on_the_article_itself():
    two = f"<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    wanted = f"Title {PARAGRAPH} {PARAGRAPH}"
    for opening, closing in (
            ("<article><section id='search-algorithms'>", "</section></article>"), ("<article class='post tag-social'>", "</article>"),
            ("<main><section id='related-work'>", "</section></main>"), ("<div class='two-column-sidebar'>", "</div>"),
            ("<form action='x'><div>", "</div></form>"), ("<form class='search'><main>", "</main></form>"),
            ("<article><div class='social related'>", "</div></article>")):
        page = f"<body><nav>Menu</nav>{opening}<h2 id='social-impact'>Title</h2>{two}{closing}<div class='footer'>End.</div></body>"
        assert text_of(page) == wanted, opening
    both = f"<article><h2>One</h2>{two}<section id='related-work'><h2 id='search'>Title</h2>{two}</section><div class='share'>Tell.</div></article>"
    assert text_of(both) == f"One {PARAGRAPH} {PARAGRAPH} {wanted}"


def test_adverts_and_comments_inside_the_article():
    """They share the paths of the paragraphs; class and role tell them apart."""
    two = f"<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    for tag in ("article", "main"):
        for opening in ("div class=advertisement", "div class='advert sponsored'", "section class=comments",
                        "section class='comment-list'", "ol class='comments-area'", "div role=navigation", "div class='share-box'"):
            closing = opening.split()[0]
            apart = f"<{opening}><p>BUY or say this, it is as long as a paragraph. It even has marks; many of them, too.</p></{closing}>"
            page = f"<body><nav>Menu</nav><{tag}><h1>Title</h1>{two}{apart}{two}</{tag}></body>"
            assert text_of(page) == f"Title {PARAGRAPH} {PARAGRAPH} {PARAGRAPH} {PARAGRAPH}", page
            several = f"<{opening}>" + "<p>READER says, at some length, that all of it is right; or wrong, perhaps.</p>" * 3 + f"</{closing}>"
            page = f"<body><{tag}><div class='post-header'><h1>Title</h1></div>{two}{two}{several}</{tag}></body>"
            assert text_of(page) == f"Title {PARAGRAPH} {PARAGRAPH} {PARAGRAPH} {PARAGRAPH}", page


def test_time_grows_with_the_page():
    for part in ("<a ", "<script ", "<!", "</a", "<a '", '<a "', "<script></script ", "<noscript></noscript ", "<a<", "< a="):
        start = time.perf_counter()
        text_of(part * 200_000)
        assert time.perf_counter() - start < 10, part


def test_elements_without_an_end():
    for tag in ("<svg class=i/>", "<svg class='i'/>", "<svg class=i>", "<template>", "<noscript>", "<iframe src='x'/>", "<textarea>"):
        page = f"<article><h1>Title</h1><p>a {tag} b</p><p>{PARAGRAPH}</p><div>{tag}<p>{PARAGRAPH}</p></div></article>"
        assert text_of(page) == f"Title a b {PARAGRAPH} {PARAGRAPH}", tag
    assert text_of(f"<article><p>{PARAGRAPH}<svg><text>x</text></svg><noscript>y<p>z</noscript></p></article>") == PARAGRAPH
    assert text_of("<p>b<template>" * 20_000).startswith("b b")


def test_formulas_and_fallback_texts_are_text():
    page = (
        f"<article><h1>Title</h1><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation>"
        f"</semantics></math> hold.</p><object data='x'><param name='a'><p>A picture of it.</p></object><p>{PARAGRAPH}</p></article>")
    assert text_of(page) == f"Title Let x=2 hold. A picture of it. {PARAGRAPH}"


def test_broken_markup():
    for page in ("", "<", "<p", "no markup at all, but text.", "<p>a<p>b</i></div></p>", "<!-- open", "<script>x",
                 "<a href=\"x>y", "<div " * 3000, "<div>" * 3000 + "deep, deep." + "</div>" * 10, "a &", "<p>" * 5000 + "x"):
        text_of(page)
    assert text_of("no markup at all, but text.") == "no markup at all, but text."
    assert text_of("<nav>only a menu</nav>") == ""


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<p>{PARAGRAPH}"), (3, "u", f"<p>{PARAGRAPH}"), (None, "u", "x"),
            (4, "u", "<p>" + PARAGRAPH * 20_000)]
    pages = spark.createDataFrame([(*r, "text", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(main_text(pages).collect(), key=str)
    assert [(r.page_id, r.url, len(r.text)) for r in got] == sorted(
        [(1, "u", 0), (2, None, 0), (3, "u", len(PARAGRAPH)), (3, "u", len(PARAGRAPH)), (None, "u", 1),
         (4, "u", len(PARAGRAPH) * 20_000)], key=lambda x: str(x).replace("(", "Row(page_id=", 1))
    assert main_text(pages.limit(0)).count() == 0
