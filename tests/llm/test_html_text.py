import re

from cairn.llm import html_text
from cairn.llm.html_text import main_text


def test_template_page():
    page = (
        '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(3);</script></head>'
        '<body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad 3 --><div class="ad">Buy the thing and the other thing now.</div><article><h1>Head &amp; tail</h1>'
        "<p><b>First  of\n all.<br><p>Ou.</p><p>Third &lt;x&gt;&nbsp;one</p></article><footer>&copy; x</footer></body></html>"
    )
    assert main_text(page) == "Head & tail\nFirst of all.\nOu.\nThird <x> one"


def test_containers_inside_the_article():
    page = (
        '<article><header><h1>Title</h1></header><p>One <a href="x">linked</a> word.</p><aside>Side text</aside><form><input> Mail</form><div class="cookie-notice"><p>We use cookies</p></div>'
        '<ul><li>point one<li>point two</ul><div class="share-bar">Share</div><p>Last</p><section id="comments"><p>Reader: the best of the year</p></section></article><div>Outside of the article and so on</div>'
    )
    assert main_text(page) == "Title\nOne linked word.\npoint one\npoint two\nLast"


def test_without_article_densities_decide():
    long = "This is the story of a man and the sea that he was to cross with the boat of his father, and it was not the last of them."
    page = f"<body><div><a href=a>Home</a> <a href=b>News of the day</a></div><div>{long}</div><div>Short one</div><p>{long}</p><div>x1 y2 z3 " + "zq " * 40 + "</div><div>Tail</div></body>"
    assert main_text(page) == f"{long}\nShort one\n{long}"


def test_odd_input():
    assert main_text(None) == main_text("") == main_text("<script>while(1){}") == main_text("<!-- open") == ""
    assert main_text("<article>a<p class=x>b<p>c</article>") == "a\nb\nc"
    assert main_text("<article>1 < 2 and a<b</article") != None
    assert main_text("<article>" + "<p>word</p>" * 30000 + "</article>").count("\n") == 29999
    assert main_text('<article class="post with-sidebar"><p>kept</p></article>') == "kept"


LONG = "This is the story of a man and the sea that he was to cross with the boat of his father, and it was not the last of them."
POOR = "Zorblat mendrivel quastony perwindle axmoor tilvane brocket sundrily vextable arnolith, dresk umbrial cantover plissade."


def test_names_and_signs_only_lower_a_block():
    for name in ('class="legal-news"', 'id="search-engines"', 'class="follow-up"', 'class="notice-period"', 'id="related-work-in-the-field"'):
        assert main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG} x</p></div></article>") == f"{LONG}\n{LONG} x", name
    for name in ('class="cookie-notice"', 'id="comments"', 'class="ad"', 'class="share-buttons top"', 'class="footer-links"', 'role="complementary"', 'class="userComments"', 'class="reader-comments"', 'id="ad1"', 'class="newsletter-form"', 'class="related-articles"', 'class="x relatedStories"'):
        assert main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG} x</p></div></article>") == LONG, name
    assert main_text(f"<article><p>{LONG}</p><p>The mark © is of 1909.</p><p>© sign first</p></article>") == f"{LONG}\nThe mark © is of 1909.\n© sign first"
    assert main_text(f"<body><p>{LONG}</p><div>© 2024 {LONG}</div></body>") == LONG
    # a hinted block needs stop words of its own where no neighbour speaks for it
    assert main_text(f'<body><div><a href=x>Home</a></div><div class="follow-up"><p>{POOR}</p></div><div><div><p>{LONG}</p></div></div></body>') == LONG


def test_malformed_tags():
    assert main_text('<article><p>one <a title="x>link</a> two</p><p class="y">three</p></article>') == "one link two\nthree"
    assert main_text("<article><p title=don't>one</p><p title='it'>two</p></article>") == "one\ntwo"
    assert main_text('<article><p title="a > b" data-x="<i>">one</p><img alt="5 > 3">two</article>') == "one\ntwo"
    assert main_text("<article><svg/>one<svg><path d='M'/></svg> two</article>") == "one two"
    assert main_text("<article>" + "<p title=\"x>word</p>" * 5000 + "</article>").count("\n") == 4999


def test_teasers_and_marks_that_are_not_believed():
    teaser = '<article><h2><a href="x">Another story</a></h2><p>In short.</p></article>'
    assert main_text(f"<main><article><h1>Head</h1><p>{LONG}</p></article></main>{teaser}{teaser}") == f"Head\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p></article><article><p>{LONG} y</p></article>") == f"{LONG}\n{LONG} y"
    assert main_text(f"<article></article><div>{LONG}</div>") == LONG
    assert main_text(f"<article><p>Sh is.</p></article><div>{LONG} {LONG}</div><div>{LONG}</div>") == f"{LONG} {LONG}\n{LONG}"


def test_other_languages_go_by_length():
    finnish = "Mies lähti aamulla merelle isänsä veneellä eikä palannut enää koskaan kotiin, vaikka kaikki odottivat häntä rannalla."
    assert main_text(f"<body><div><a href=a>Etusivu</a> <a href=b>Uutiset</a></div><p>{finnish}</p><p>Lyhyt.</p><p>{finnish}</p></body>") == f"{finnish}\nLyhyt.\n{finnish}"


def pages_with_article(spark, sf):
    import html

    for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        yield r.html, "\n".join(x for x in want if x)


def test_the_two_passes_find_articles_that_nothing_marks(spark, monkeypatch):
    rows = [(h.replace("<article>", "<div>").replace("</article>", "</div>"), want) for h, want in pages_with_article(spark, "sf0.01")]
    right = sum(main_text(h) == want for h, want in rows)
    assert right >= 0.9 * len(rows), right
    why = [b.why for h, _ in pages_with_article(spark, "sf0.01") for b in classified(h) if b.label == "good"]
    assert set(why) == {"density", "neighbour"} and why.count("density") > 0.5 * len(why)
    page = f"<body><div>{LONG}</div><div>x</div><div><div>{POOR}</div></div></body>"
    before = main_text(page)
    monkeypatch.setattr(html_text, "STOP_WORDS", frozenset())
    assert before != main_text(page)


def classified(page):
    blocks = html_text.blocks_of(page)
    html_text.classify(blocks)
    return blocks


def test_nearest_decided_neighbours_by_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        blocks = [html_text.Block(rng.choice(["short", LONG, POOR]), rng.choice([0, 0, 3, 80]), rng.random() < 0.1, 0, 0, rng.random() < 0.2, False, rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(1, 15))]
        html_text.classify(blocks)
        first = [b.label if b.why != "neighbour" else "" for b in blocks]
        for i, b in enumerate(blocks):
            if first[i]:
                continue
            far = lambda j: abs(i - j) + html_text.BOUNDARY * sum(x.gap for x in blocks[min(i, j) + 1 : max(i, j) + 1]) + html_text.BEFORE_HEADING * (b.heading and j < i)  # noqa: B023, E731
            decided = [(far(j), first[j]) for j in range(len(blocks)) if first[j]]
            near = {x for d, x in decided if d == min(decided)[0]} or {"bad"}
            assert b.label == ("good" if "good" in near else "bad")


def test_all_pages_keep_their_article(spark):
    d = "/root/testdata/sf0.01"
    import html

    for r in html_text.op6_query(spark, d).join(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_text.extract_main_text(empty).collect() == []
    rows = [(1, None, None, "clash"), (1, "u", "<main>a</main>", None), (None, "u", "<main>a</main>", None)]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, "", 0), (1, "u", "a", 1), (None, "u", "a", 1)], key=str)


def test_a_form_around_the_page_is_no_form():
    page = '<body><form id="aspnetForm" action="x"><nav><a href="/">Home</a></nav><article><h1>Head</h1><p>{}</p></article><footer>Foot</footer></form></body>'
    assert main_text(page.format(LONG)) == f"Head\n{LONG}" and main_text(page.format("Sh is.")) == "Head\nSh is."
    assert main_text(f"<body><form><h1>Head</h1><p>{LONG} {LONG}</p><form class=search>Look for it in the shop</form></form></body>") == f"Head\n{LONG} {LONG}"
    assert main_text(f"<article><p>{LONG}</p><form>Write to us of the thing that you are to buy and when it is, as we have been there for you</form></article>") == LONG
    assert main_text(f"<body><p>{LONG} {LONG}</p><form><p>{LONG} x</p></form></body>") == f"{LONG} {LONG}"


def test_names_decide_by_their_head():
    for name in ("post-share-story", "article-ad-body", "content-social-text"):
        assert main_text(f'<body><div class="{name}"><h1>Head</h1><p>{LONG} {LONG}</p></div></body>') == f"Head\n{LONG} {LONG}", name
    for name in ("article-comments", "comment-body", "related-articles", "main-nav-wrapper", "share-buttons", "post-comments-list", "ad-content"):
        assert main_text(f'<body><p>{LONG} {LONG}</p><div class="{name}"><p>{LONG} {LONG} x</p></div></body>') == f"{LONG} {LONG}", name


def test_densities_carry_the_result(spark, monkeypatch):
    """Without the marks of articles and all lists of names, then without the elements for menus and footers too."""
    pages = list(pages_with_article(spark, "sf0.01"))
    bare = lambda h: re.sub("</?article>", "", h)
    barer = lambda h: re.sub(r"<(/?)(?:nav|footer)\b", r"<\1div", bare(h))
    share = lambda f: sum(main_text(f(h)) == want for h, want in pages) / len(pages)
    assert share(lambda h: h) == 1
    monkeypatch.setattr(html_text, "BOILERPLATE_NAMES", frozenset())
    monkeypatch.setattr(html_text, "HINTS", frozenset())
    assert share(bare) >= 0.88 and share(barer) >= 0.88
    for off in ({"LINKS_MOST": 9}, {"SHORT": 0, "LONG": 0}, {"BOUNDARY": 0, "BEFORE_HEADING": 0}):
        with monkeypatch.context() as m:
            for k, v in off.items():
                m.setattr(html_text, k, v)
            assert share(barer) < 0.7, off
