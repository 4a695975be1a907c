import html
import random

import corpus
import pytest

from barline.llm import page_text as op

CASES = {
    "<article><h1>T &amp; x</h1><p>One <b>two</b>\n three<p>Four</article><footer>f</footer>": "T & x\nOne two three\nFour",
    "<body><nav><a href=/>Home</a></nav><p>" + "text " * 30 + "</p><p>Short.</p></body>": "text " * 29 + "text\nShort.",
    "<div id='main-menu'><ul><li>a<li>b</ul></div><main><p>Body text</main>": "Body text",
    "<article><p>keep</p><form><p>name</p><input></form><div class='ad banner'><div>buy</div> now</div><p>also</p></article>": "keep\nalso",
    "<article><p>keep</p><section id=comments><p>first!</p></section></article>": "keep",
    "<article><p>a<!-- <p>b</p> --><script>var x='</p><p>no';</script><style>p{}</style> c</p></article>": "a c",
    "<article><p title='a > b'>x &lt;y&gt; &#233;&#x1F600; &nbsp;z</p></article>": "x <y> é\U0001f600 z",
    "<nav><p>never closed<article><p>Main</p></article>": "Main",
    "<div class=cookieNotice>We use cookies</div><p>Plain page</p>": "Plain page",
    "<p>Recommendations, commentary and navigating are words.</p>": "Recommendations, commentary and navigating are words.",
    "<article><header><h1>Title</h1></header><p>x</article>": "Title\nx",
    "<header><h1>Site</h1></header><article><p>x</article>": "x",
    "<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>": "yes",
    "<article><br>a<br/>b<img alt='>'>c</article>": "a bc",
    "no markup at all": "no markup at all",
    "<article><p>cut off in a ta<": "cut off in a ta<",
    "": "",
    "<script>only()</script>": "",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert op.main_text(page) == CASES[page]


STORY = "".join(f"<p>{c * 1000}</p>" for c in "abc")
STORY_TEXT = "\n".join(c * 1000 for c in "abc")
TEASER = "<article><h3>Other</h3><p>" + "teaser " * 20 + "</p></article>"


def test_story_outside_of_article_elements():
    """Surge and dive choose the story, not the name of the element around it."""
    for page in (
        f"<body><div class=story>{STORY}</div><div class=cards>{TEASER * 3}</div></body>",
        f"<body>{TEASER}<div class=story>{STORY}</div>{TEASER}</body>",
        f"<main><div class=story>{STORY}</div>{TEASER * 2}</main>",
        f"<body><div>Site name</div><nav>n</nav><div class=story>{STORY}</div><aside>x</aside><div>Imprint</div></body>",
        f"<body><div class=story><p>{'a' * 1000}</p>{TEASER}<p>{'b' * 1000}</p><p>{'c' * 1000}</p></div></body>",
    ):
        assert op.main_text(page) == STORY_TEXT


def test_article_is_a_weight():
    page = "<body><div>%s</div><article><p>%s</article></body>"
    assert op.main_text(page % ("Some words of the house", "x" * 100)) == "x" * 100
    assert op.main_text(page % ("y" * 1000, "x" * 100)) == "y" * 1000
    assert op.main_text(page % ("y" * 900, "x" * 1000)) == "y" * 900 + "\n" + "x" * 1000


TAIL = "<p>" + "z" * 100 + "</p>"


@pytest.mark.parametrize("insert", [
    "<div class=ad>buy</div>", "<form><p>name</form>", "<p class=notice>note</p>", "<p class=notice>note", "<div class=ad><p>buy</div><div class=promo>x</div>",
])
@pytest.mark.parametrize("page", [
    "<body>{0}{1}{2}</body>", "<body><div>{0}{1}{2}</div></body>", "<body><div>{0}</div>{1}<div>{2}</div></body>",
    "<body><div><div>{0}</div>{1}<div>{2}</div></div></body>", "<article><section>{0}</section>{1}<section>{2}</section></article>",
])
def test_inserts_do_not_cut_the_tail_off(page, insert):
    assert op.main_text(page.format(STORY, insert, TAIL)) == STORY_TEXT + "\n" + "z" * 100


def test_links_of_the_text_are_kept_and_link_lists_go():
    links = "".join(f"<li><a href=/{i}>Reference number {i}</a>" for i in range(5))
    want = "\n".join(f"Reference number {i}" for i in range(5))
    report = "<p><a href=r>Full report (PDF)</a></p>"
    story = f"<h2><a href=/s>Linked heading</a></h2>{STORY}{report}<ul>{links}</ul>"
    text = f"Linked heading\n{STORY_TEXT}\nFull report (PDF)\n{want}"
    for box in ("article", "main", "div", "body"):
        assert op.main_text(f"<{box}>{story}</{box}>") == text
    assert op.main_text(f"<article>{STORY}<div class=ad>x</div><h2>See</h2><ul>{links}</ul></article>") == f"{STORY_TEXT}\nSee\n{want}"
    assert op.main_text(f"<div><ul>{links}</ul></div><div class=story>{STORY}</div><div><ul>{links}</ul></div>") == STORY_TEXT
    assert op.main_text(f"<div id=page><ul>{links}</ul><div class=ad>x</div><div>{STORY}</div></div>") == STORY_TEXT


OPEN = {
    "<article><p class=notice>no<p>a<p>b</p></article><p>": "a\nb",
    "<article><p class=notice>no <b>x</b><div>a</div></article>": "a",
    "<article><p>a<p class=ad>no</article><footer>f</footer>": "a",
    "<article><ul><li class=ad>no<ul><li>no</ul>no<li>a<li>b</ul><p>c</article>": "a\nb\nc",
    "<article><ul><li>a<li class=ad>no</ul><p>b</article>": "a\nb",
    "<article><dl><dt class=ad>no<dd class=ad>no<dt>a<dd>b</dl></article>": "a\nb",
    "<article><table><tr><td class=ad>no<table><tr><td>no</table>no<td>a<tr><th class=ad>no<tr><td>b</table>c</article>": "a\nb\nc",
    "<article><table><tr class=promo><td>no<td>no<tr><td>a</table><p>b</article>": "a\nb",
    "<article><p>a</p><div><div class=ad><p>no</div><p>b</div><section><div class=ad>no</section><p>c</article>": "a\nb\nc",
    "<article><section><p>a</p><div class=ad><section><section>no</section></section>no</div><p>b</section></article>": "a\nb",
    "<head><title>t</title><meta x><body><p>a</body>": "a",
    "<article><div class=ad><p>no</div><p>a</p></section></article>": "a",
}


@pytest.mark.parametrize("page", OPEN)
def test_skipped_elements_without_end_tags(page):
    assert op.main_text(page) == OPEN[page]


def test_null_and_long():
    assert op.main_text(None) == ""
    long = "wörd " * 200_000
    assert op.main_text(f"<article><p>{long}</article>") == long.strip()
    assert len(op.main_text("<p>" * 50_000 + "x")) == 1
    assert op.main_text("<" * 20_000).strip("<") == ""


def test_stretches():
    assert op.stretches([0, 5, 0, 0, 0, 7, 1, 0]) == [(1, 2, 5), (5, 7, 8)]
    assert op.stretches([]) == []
    assert op.stretches([3, 0, 0, 4]) == [(0, 4, 4)]
    assert op.stretches([3, 0, 0, 0, 4]) == [(0, 1, 3), (4, 5, 4)]


def test_made_pages_round_trip():
    rnd = random.Random(6)
    for _ in range(200):
        blocks = [corpus.sentence(rnd, rnd.randint(1, 60)) + rnd.choice([".", " <&> \"q\"", " é"]) for _ in range(rnd.randint(1, 12))]
        inner = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
        page = f"<html><head><title>t</title></head><body><nav><a>Home page here</a></nav><div class='sidebar'><p>{corpus.sentence(rnd, 9)}</p></div>{rnd.choice(['<article>%s</article>', '<main>%s</main>']) % inner}<aside>{corpus.sentence(rnd, 20)}</aside><footer>&copy;</footer></body></html>"
        assert op.main_text(page) == "\n".join(" ".join(b.split()) for b in blocks)


def test_frame(spark):
    rows = [(1, "u", "<article><p>é x</article>", "t", 1), (None, None, None, None, None), (1, "u", "<article><p>é x</article>", "t", 1)]
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    got = op.extract(spark.createDataFrame(rows, schema))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, "u", "é x", 3), (1, "u", "é x", 3), (None, None, "", 0)], key=repr)
    assert op.extract(spark.createDataFrame([], schema)).count() == 0


TALE = "A long sentence of the story, with its words. " * 3


@pytest.mark.parametrize("page", [
    '<article class="share-story"><p>{}</p></article>',
    '<article class="post with-sidebar"><p>{}</p></article>',
    "<article><div class=related-work><p>{}</p></div></article>",
    "<article><section class=social-history><p>{}</p></section></article>",
    "<article><h2 id=comments-on-policy>{}</h2></article>",
    "<article><p id=menu-items>{}</p></article>",
    "<body><div class=widget><p>{}</p></div></body>",
    "<main class='hidden-gems'><div class='notice-board'><p>{}</p></div></main>",
])
def test_names_do_not_take_the_story(page):
    assert op.main_text(page.format(TALE)) == TALE.strip()


@pytest.mark.parametrize("name", [
    "comments", "comment-list", "related-posts", "share_buttons", "cookieBanner", "ad-slot-2", "newsletter-signup", "site-footer", "skip-link",
])
def test_names_of_parts_still_count(name):
    page = f"<article><p>{TALE}</p><div class='x {name}'><p>Other words here.</p></div></article>"
    assert op.main_text(page) == TALE.strip()
