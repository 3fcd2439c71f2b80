from __future__ import annotations

import re
import time
from html import unescape

from termlake.llm import pages

from ..conftest import SMALL

PAGE = """<html><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="layout"><div class="sidebar-2">side stuff that is long</div><main><article class="post post-12">
<header><h2>Title &amp; more</h2></header><div class="entry"><p>First para with <a href=x>link</a> and text, long enough.</p><p>Second&nbsp;para<br>line two &lt;tag&gt;</p><ul><li>one<li>two</ul><form>Mail<input></form>
<div class=ad>buy</div><script>var t="</p>";</script></div></article><section class="comments"><p>Nice post! I really loved it, it is a very very long comment that goes on and on and on.</p></section></main></div><footer>foot</footer></body></html>"""


def test_parts_of_a_page():
    assert pages.extract(PAGE, None) == "Title & more\nFirst para with link and text, long enough.\nSecond para line two <tag>\none\ntwo"
    assert pages.extract("just text &amp; more", None) == "just text & more" and pages.extract("", None) == "" and pages.extract("<p>a<script>'</p>'</script>b", None) == "ab"
    assert pages.extract("<div><p>" + "x " * 50_000 + "<b>end", None).endswith("x end")


def test_all_pages_equal_their_articles(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in pages.query(spark, SMALL).collect()}
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(x for x in blocks if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_hosts_outvote_odd_pages(spark):
    good = "<body><div class='story 7'><p>" + "long text here, " * 20 + "</p></div><div class='links'><p>" + "short " * 5 + "</p></div></body>"
    odd = "<body><div class='story 9'><p>brief</p></div><div class='links'><p>" + "noise text that is longer " * 20 + "</p></div></body>"
    df = spark.createDataFrame([(i, "http://h.example/a", odd if i == 5 else good) for i in range(6)] + [(9, None, odd), (10, "http://h.example/b", None), (None, "x", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got[5] == "brief" and got[9].startswith("noise") and got[10] == "" and got[None] == "" and len(got) == 9
    assert pages.main_text(df.limit(0)).count() == 0


def test_many_hosts_join_by_salts(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    a = sorted((r.page_id, r.text) for r in pages.main_text(df).collect())
    monkeypatch.setattr(pages, "BROADCAST_BYTES", 1)
    assert sorted((r.page_id, r.text) for r in pages.main_text(df).collect()) == a


def test_marked_words_inside_an_article_stay():
    assert pages.extract('<article><p>One.</p><div class="related-work"><p>Two.</p></div><p class="promotion-history">Three.</p></article>', None) == "One.\nTwo.\nThree."
    assert pages.extract("<article><p>One <span class='ad'>buy</span> more <button>go</button> now.</p><div class='ad-box'>x</div></article>", None) == "One more now."


def template(body, k):
    return f"""<body><div class="site-header"><p>{"A name of a site. " * 9}</p></div><div class="content"><div class="text p{k}">{body}</div><div class="share-this-story"><p>{"Tell your friends about it. " * 3}</p></div>
<div class="comment-list"><p>{"I do not agree with any of that. " * 30}</p></div></div><div class="sidebar"><ul>{"<li>some other story of ours</li>" * 30}</ul></div><div id="footer">The end.</div></body>"""


def test_hosts_without_article_elements(spark):
    bodies = [f"<h1>Story {k}</h1><p>{'What was seen there. ' * (3 + k)}</p>" for k in range(5)]
    bodies[2] += '<p class="comment-by-editor">Corrected later.</p>'
    rows = [(k, f"http://a.example/{k}", template(b, k), "x", 1) for k, b in enumerate(bodies)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, host string, path int")
    got = [(r.page_id, r.text) for r in pages.main_text(df).collect()]
    want = [(k, re.sub("<[^>]*>", "\n", b.replace("</h1><p>", "\n")).strip().replace(" \n", "\n").replace("\n\n", "\n")) for k, b in enumerate(bodies)]
    assert sorted(got) == sorted(want + want[:1])


def test_weak_marks_count_by_the_vote_of_the_host(spark):
    page = lambda k, extra: f"<article><p>{'Text of the story. ' * 5}{k}</p>{extra}</article>"
    slot = '<div class="more-related-things"><p>Other stories.</p></div>'
    rows = [(k, "http://b.example/x", page(k, slot)) for k in range(5)] + [(k, "http://c.example/x", page(k, slot if k == 5 else "")) for k in range(5, 9)] + [(9, "http://d.example/x", page(9, slot))]
    got = {r.page_id: "Other" in r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: k in (5, 9) for k in range(10)}


def test_broken_markup_takes_linear_time():
    for piece in ('<a href="x ', "<a href='x \"y ", "<p class=\"a' ", "<svg>", "<!", "</", "<div><p>", "<div></i>", "<b><li>", "<b "):
        took = []
        for n in (10_000, 80_000):
            began = time.process_time()
            pages.parse(piece * n)
            took.append(time.process_time() - began)
        assert took[1] < 40 * max(took[0], 0.02), piece
    assert pages.extract('<p>a<a href="x>b</a> c</p>', None) == "ab c"


def test_tokens():
    html = """<p class="a>b" id='c'>x<!-- <p> --><![CDATA[y]]></P ><br/><title>no</title>1 < 2<?php ?></p"""
    assert [t for t in pages.tokens(html) if t[0] != "text"] == [("open", "p", """ class="a>b" id='c'"""), ("close", "p", ""), ("open", "br", "/")]
    assert "".join(t[1] for t in pages.tokens(html) if t[0] == "text") == "x1 < 2"


def test_comments_and_share_boxes_on_hosts_of_one_and_two_pages(spark):
    story = "<p>It was a long day at the river. They came home late.</p>"
    talk = "<p>I agree with all of this, and I have more to say about it than the story has.</p>" * 4
    one = f'<div class="post">{story}<div class="post-share-buttons"><p>Tweet me</p></div><div class="related-posts"><p>More</p></div></div><div class="user-comments">{talk}</div>'
    two = f'<div class="post">{story}</div><div class="reader_replies">{talk}</div>'
    three = f'<div class="post">{story}<div class="tell-and-share"><p><a href="#">Post</a> <a href="#">Mail it</a></p></div></div><div class="what-readers-comment"><div class="one">{talk}</div><div class="one">{talk}</div></div>'
    rows = [(1, "http://one.example/", one), (2, "http://two.example/a", two), (3, "http://two.example/b", two), (4, "http://three.example/", three), (5, "http://four.example/", one)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"It was a long day at the river. They came home late."}


def test_weak_marks_alone_do_not_count_on_one_page():
    page = '<article><p>One.</p><div class="related-work"><p>Two <a href="#">x</a>.</p></div><div class="comment-by-editor"><p>Three.</p></div><p class="promotion-history">Four.</p></article>'
    assert pages.extract(page, None) == "One.\nTwo x.\nThree.\nFour."
