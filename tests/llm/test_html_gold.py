"""Gold pages: articles in page templates, with the text that must come out."""

import time

import pytest

from papyrine.llm import html_main

ARTICLES = {
    "plain": ("<h1>On tides</h1><p>Water rises twice a day.</p><p>The moon &amp; the sun pull it.</p>", "On tides\nWater rises twice a day.\nThe moon & the sun pull it."),
    "price": ("<h1>Shares</h1><p class='share-price'>The price was 12.</p><p>It fell later.</p>", "Shares\nThe price was 12.\nIt fell later."),
    "related": ("<h1>Paper</h1><p>We show a bound.</p><section class='related-work'><h2>Related work</h2><p>Others did too.</p></section>", "Paper\nWe show a bound.\nRelated work\nOthers did too."),
    "math": ("<h1>Sums</h1><p>Formula <math><mi>x</mi><mo>+</mo><mn>1</mn></math> end</p>", "Sums\nFormula x+1 end"),
    "table": ("<h2>Counts</h2><table><tr><td>one<td>1<tr><td>two<td>2</table><ul><li>a<li>b</ul>", "Counts\none\n1\ntwo\n2\na\nb"),
    "inline": ("<h1>A\n  title</h1><p>Line <b>bold</b>,<br>next <a href=/x>linked</a> end.<p>Last\xa0one.", "A title\nLine bold, next linked end.\nLast one."),
}
LONG = " ".join(["A paragraph of the usual length, which every article of these pages has."] * 6)
TEMPLATES = {
    "ids": "<body><div id=nav><a href=/>Home</a></div><div id=main>{}</div><div id=sidebar>Side text that is rather long, longer than some articles are, by far.</div></body>",
    "article": "<body><nav><a href=/>Home</a></nav><main><article>{}</article></main><aside>Aside</aside><footer>Foot</footer></body>",
    "classes": "<body><div class=site-header>Site</div><div class='layout with-sidebar'><div class='post entry wide long one two'>{}</div><div class='post entry wide long three sidebar'>Links</div></div></body>",
    "comments": "<body><header>Site</header><div class=post>{}</div><div id=comments><p>First!</p><p>Second!</p></div><form><input name=q>Search</form></body>",
    "notices": "<body><div class=cookie-banner>We use cookies.</div><div class=ad>Buy</div><section class=story>{}</section><script>var a = '</p>';</script><style>p {{}}</style></body>",
}


@pytest.fixture(scope="module")
def extracted(spark):
    pages, wanted = [], {}
    for t, template in TEMPLATES.items():
        for a, (body, text) in ARTICLES.items():
            wanted[len(pages)] = (t, a, f"{text}\n{LONG}")
            pages.append((len(pages), f"https://{t}.example/{a}", template.format(f"{body}<p>{LONG}</p>")))
    frame = spark.createDataFrame([*pages, *pages[:3]], "page_id long, url string, html string")
    return wanted, [(r.page_id, r.text, r.n_chars) for r in html_main.main_text(frame).collect()]


def test_gold_pages(extracted):
    wanted, rows = extracted
    assert len(wanted) >= 30 and len(rows) == len(wanted) + 3
    wrong = {(*wanted[i][:2], text) for i, text, _ in rows if text != wanted[i][2]}
    assert not wrong and all(n == len(text) for _, text, n in rows)


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * 2 * n, lambda n: "<div>" * n + "</q>" * n, lambda n: "<p><button>" + "<div>" * 2 * n, lambda n: "<header>" * n, lambda n: "<table><tr><td>" * (n // 2), lambda n: "<ul><li>" * n, lambda n: "<a b='" * n,
])
def test_odd_pages_take_linear_time(make):
    """Twice the page takes about twice the time; the machine's speed does not matter."""

    def seconds(n):
        page, least = make(n) + "end", float("inf")
        for _ in range(3):
            began = time.process_time()
            html_main.extract(page, None)
            least = min(least, time.process_time() - began)
        return least

    assert seconds(16_000) < 3 * seconds(8_000) + 0.05


#: Parts that stand inside an article: (markup, text that stays of it).
PARTS = [
    ("<div class='user-comments'>nice post</div>", ""), ("<div id=comment-list><p>One</p><p>Two</p></div>", ""), ("<section class='cookieConsent'>cookies!</section>", ""), ("<div class=gdprbox>We care.</div>", ""),
    ("<div class='share-buttons'>Share: fb tw</div>", ""), ("<div class='related-posts'><a href=/1>Rel one</a></div>", ""), ("<div class='menu'><a href=/>Home</a> <a href=/b>Back</a></div>", ""), ("<div class=reply><textarea></textarea><button>Send</button>Your reply</div>", ""),
    ("<p style='display:none'>hidden</p>", ""), ("<div style='color:red; display: none !important'>hidden</div>", ""), ("<span hidden>hidden</span>", ""), ("<div class='newsletter-box'>Sign up now</div>", ""), ("<div id='disqus_thread'>Loading</div>", ""),
    ("<ul class=menu><li>Soup of the day</li><li>Bread</li></ul>", "Soup of the day\nBread"), ("<h2 class=banner>The second part</h2>", "The second part"), ("<p class=related>A related finding is this.</p>", "A related finding is this."),
    ("<section id=reply><p>The minister's reply was short.</p></section>", "The minister's reply was short."), ("<p class=notice>Notice how it bends.</p>", "Notice how it bends."), ("<p style='display:block'>shown</p>", "shown"),
    ("<p class='cookie-recipe'>Mix the dough.</p>", "Mix the dough."), ("<div class='social-history'>A history of towns.</div>", "A history of towns."), ("<p class=share-price>It rose.</p>", "It rose."), ("<dl class=promotion><dt>Rank</dt><dd>Major</dd></dl>", "Rank\nMajor"),
]


@pytest.mark.parametrize(("part", "stays"), PARTS)
@pytest.mark.parametrize("around", ["<body><nav><a href=/>Home</a></nav><article>{}</article><footer>Foot</footer></body>", "<body><div id=top><main><div class=text>{}</div></main></div></body>"])
def test_parts_inside_an_article(around, part, stays):
    page = around.format(f"<h1>Title</h1><p>{LONG}</p>{part}<p>Last words of it.</p>")
    assert html_main.extract(page, None) == "\n".join(x for x in ("Title", LONG, stays, "Last words of it.") if x)
