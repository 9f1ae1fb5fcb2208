import pytest

from waymark.llm.html_extraction import main_text

LONG = "This sentence of the article has enough words to count as text. "
PARTS = [
    f"<section id=discussion><p>{LONG}</p></section>", f"<h2 id=related-work>Related work</h2><p>{LONG}</p>",
    "<h2 id=social-impact>Social impact</h2>", "<h3><span id=how-to-search-a-table>How to search</span></h3>",
    "<p class=notice>Mind this short notice.</p>", f"<div class=promotion-history><p>{LONG}</p></div>",
]


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_names_inside_the_text_lose_nothing(part, outer):
    page = f"<body><div class=comments><p>A comment.</p></div><{outer}><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></{outer}></body>"
    text = main_text(page)
    want = main_text(page.replace(" id=", " data-x=").replace(part, part.replace(" class=", " data-x=")))
    assert text == want and text.count("\n") >= 3 and "A comment" not in text


def test_named_link_lists_in_an_article_go():
    links = "".join(f"<li><a href={i}>Another article {i}</a></li>" for i in range(5))
    assert "Another" not in main_text(f"<article><h1>T</h1><p>{LONG * 3}</p><div class=related><ul>{links}</ul></div></article>")


def test_readable_text_of_embedded_elements_stays():
    math = "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>"
    page = f"<article><p>{LONG}Let {math} hold.</p><svg><title>t</title><text>A label</text></svg><object><p>Instead</p></object><xmp>a <b> c</xmp></article>"
    assert main_text(page).split("\n") == [f"{LONG}Let x=2 hold.", "A label", "Instead", "a <b> c"]


@pytest.mark.parametrize("open_, close", [("<main>", "</main>"), ("<article>", "</article>"), ("<div>", "</div>")])
def test_all_articles_of_a_page_count(open_, close):
    articles = "".join(f"<article><h2>Part {i}</h2>{f'<p>{LONG}</p>' * (i + 2)}</article>" for i in range(3))
    text = main_text(f"<body><div><a href=1>one</a> <a href=2>two</a></div>{open_}{articles}{close}</body>")
    assert [text.count(f"Part {i}") for i in range(3)] == [1, 1, 1] and text.count(LONG.strip()) == 9 and "one" not in text


BOXES = [
    f"<section class=comments><h3>Comments</h3><div class=comment><p>BOX {LONG * 3}</p></div><div class=comment><p>BOX {LONG}</p></div></section>",
    f"<section id=comments><p>BOX {LONG * 9}</p></section>", f"<div class=sidebar><p>BOX {LONG}</p></div>",
    f"<div class='advert'><p>BOX {LONG}</p></div>", f"<div class=cookie-notice><p>BOX {LONG}</p></div>",
    f"<div class=newsletter-signup><p>BOX {LONG}</p><input name=mail><button>BOX</button></div>",
    f"<div class=promo-panel><p>BOX {LONG}</p><input name=mail></div>", f"<div class=comment-list><p>BOX {LONG}</p></div>",
]


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("outer", ["article", "main"])
@pytest.mark.parametrize("before", [True, False])
def test_boxes_inside_an_article_go(box, outer, before):
    body = f"<h1>Title</h1><p>{LONG * 3}</p><p>{LONG}</p>"
    text = main_text(f"<body><{outer}>{box + body if before else body + box}</{outer}></body>")
    assert text == f"Title\n{(LONG * 3).strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("box", BOXES[:6])
def test_boxes_go_without_an_article(box):
    body = f"<h1>Title</h1><p>{LONG * 3}</p><p>{LONG}</p>"
    text = main_text(f"<body><div>{body}{box}</div></body>")
    assert "BOX" not in text and LONG.strip() in text


@pytest.mark.parametrize("title", ["<h1>Title</h1>", "<article>", "<main>", ""])
def test_a_form_around_the_page_loses_nothing(title):
    inner = f"{title}<p>{LONG * 3}</p><p>{LONG}</p>"
    want = main_text(f"<body><div>{inner}</div></body>")
    page = f"<body><form method=post><input type=hidden name=state>{inner}</form></body>"
    assert main_text(page) == want and LONG.strip() in want
    assert "Mail" not in main_text(f"<body><article><p>{LONG * 3}</p><form><p>Mail address</p><input></form></article></body>")


def test_comments_in_highlighted_code_stay():
    page = f"<article><p>{LONG * 2}</p><pre><code>x = 1 <span class=comment># one</span></code></pre></article>"
    assert main_text(page).endswith("x = 1 # one")


def test_a_named_part_with_most_of_the_text_stays():
    for name in ("sidebar", "cookie-notice", "comments"):
        assert main_text(f"<body><div class={name}><p>{LONG * 3}</p></div></body>") == (LONG * 3).strip()
        assert LONG.strip() in main_text(f"<body><main><h1>T</h1><div class={name}><p>{LONG * 3}</p></div></main></body>") or name == "comments"


def test_a_long_footer_under_a_short_article_goes():
    for tail in (f"<footer>{LONG}</footer>", f"<div class=ad>{LONG}</div>", f"<aside><p>{LONG}</p></aside>"):
        assert main_text(f"<body><article><h1>T</h1><p>Short.</p></article>{tail}</body>") == "T\nShort."
