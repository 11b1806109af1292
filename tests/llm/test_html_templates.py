"""Main text on templates whose class names or nesting mislead."""

import pytest
from papyrine.llm import html_main

BODY = "<h1>A heading</h1><p>" + "Words of the article. " * 40 + "</p>"
TEXT = "A heading\n" + " ".join(["Words of the article."] * 40)


def texts(spark, pages):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_main.main_text(frame).collect()}


@pytest.mark.parametrize("name", ["class='content with-sidebar'", "class=no-comments", "class=ad-free", "class=has-nav", "id=share-story", "class='page sidebar'"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrapper_named_after_boilerplate_keeps_the_article(name, inner):
    page = f"<body><nav><a href=/>Home</a></nav><div {name}><{inner}>{BODY}</{inner}><div class=sidebar>noise</div></div><footer>f</footer></body>"
    path = html_main.best_container(html_main.parse(page)).path()
    assert html_main.extract(page, path) == html_main.extract(page, None) == TEXT


def test_boilerplate_by_name_still_goes():
    comments = "<div id=comments><article class=comment-body>" + "A reader says more. " * 90 + "</article></div>"
    page = f"<body><div class=post>{BODY}</div>{comments}<div class=cookie-banner>c</div><div class=ad-1>d</div><div class=site-footer>s</div></body>"
    assert html_main.extract(page, None) == TEXT


def test_heading_outside_the_body_of_a_long_page_stays(spark):
    page = "<body><nav><a href=/>Home</a></nav><div class=wrap><div class=post><h1>A heading of some sixty characters that stands above it all</h1><div class=body><p>" + "Long text. " * 700 + "</p></div></div></div><footer>f</footer></body>"
    got = texts(spark, [(f"http://long.org/{i}", page) for i in range(3)])
    assert all(t.startswith("A heading of some sixty") and t.endswith("Long text.") for t in got.values())


def test_inner_container_still_sheds_links_and_boilerplate():
    links = "".join(f"<p><a href=/{i}>Another story of the day</a></p>" for i in range(20))
    page = f"<body><div class=list>{links}</div><div class=post>{BODY}</div><div class=site-footer>s</div></body>"
    assert html_main.extract(page, None) == TEXT


def test_page_of_another_template_keeps_its_article(spark):
    usual = f"<html><body><div>{BODY}</div></body></html>"
    other = "<html><body><div>A small box.</div><section class=story><h2>Other</h2><p>" + "Quite another page. " * 60 + "</p></section></body></html>"
    for url in (None, "http://one.org/"):
        got = texts(spark, [(url, usual)] * 4 + [(url, other)])
        assert all(got[i] == TEXT for i in range(4))
        assert "Other\n" + " ".join(["Quite another page."] * 60) in got[4]
