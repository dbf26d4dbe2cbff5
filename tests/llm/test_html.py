import html as stdlib
import math
import random
import re

import numpy as np

from quernstone.llm import html
from quernstone.sources.tables import table


def article(page: str) -> str:
    """What the made-up pages hold between their article tags, by patterns."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [stdlib.unescape(re.sub(r"<[^>]+>", " " , re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", x))) for x in re.split(r"</?(?:p|h\d|li|ul)\b[^>]*>", inside)]
    return "\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)


def test_every_page_gives_its_article(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    out = html.op6_html_extraction(spark, sf).collect()
    assert len(out) == len(pages)
    wrong = [r.page_id for r in out if r.text != article(pages[r.page_id].html) or r.url != pages[r.page_id].url or r.n_chars != len(r.text)]
    assert not wrong, (wrong[:5], [r.text for r in out if r.page_id == wrong[0]], article(pages[wrong[0]].html))


def test_page_without_article_tag():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="main-menu"><a href=x>Home</a></div>
    <div class="content"><h2>Head  line</h2><p>First <b>bold</b> text that is quite long, so that the ratio of text to tags is high here.</p>
    <p>A second paragraph of the article, also with a good many words &amp; signs &lt;x&gt;.</p><p>Short.</p>
    <div class="advert-box"><p>Buy now, a long enough advert to look like text to anyone who counts characters only.</p></div></div>
    <aside>Links and more links</aside><section id="comments"><p>Reader says a very long thing that has as many characters as the article's paragraphs.</p></section>
    <form><p>Subscribe to our letter with your address and a long explanation of it</p></form><footer>(c)</footer></body></html>"""
    assert html.main_text(page) == "Head line\nFirst bold text that is quite long, so that the ratio of text to tags is high here.\nA second paragraph of the article, also with a good many words & signs <x>.\nShort."


def test_marks_on_paragraphs_and_long_lists():
    page = """<body><nav><ul><li>Home</ul></nav><main><article><div class="article-header"><h1 class="page-header">Title</h1></div><p>Intro.</p><p class="advert">Buy a thing that takes many words to praise.<p>Next.</p>
    <ul><li>A list item that holds far more text than all the other blocks of this article taken together<li>and another one that is nearly as long as the one before it was</ul>
    <p class="cookie-notice">We use cookies on this page, as you may know by now.</p><div style="display: none">Not shown</div><p>End.</p></article><div class="page-header">Site</div></main></body>"""
    assert html.main_text(page).split("\n") == ["Title", "Intro.", "Next.", "A list item that holds far more text than all the other blocks of this article taken together", "and another one that is nearly as long as the one before it was", "End."]
    page = "<body><div id=menu>Menu</div><div class=post><p>Before.</p><blockquote>" + "<p>A long quote that goes on and on, with many words in it.</p>" * 5 + "</blockquote><p>After.</p></div><div class=comments>No</div></body>"
    assert html.main_text(page).split("\n")[0] == "Before." and html.main_text(page).endswith("\nAfter.") and "No" not in html.main_text(page)


def test_edge_cases(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain text"), (4, "u", "<p>open <b>tag"), (5, "u", "</div></p>stray"), (6, "u", "<script>x</script>"), (None, "u", "<p>a</p>"), (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<article><p>" + "w " * 200_000 + "</article>"), (9, "u", "<a"), (9, "u", "<a")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, n_chars int")
    out = {r.page_id: r.text for r in html.extracted(df).collect()}
    assert (out[1], out[2], out[3], out[4], out[5], out[6], out[None], out[7]) == ("", "", "plain text", "open tag", "stray", "", "a", "deep")
    assert len(out[8]) == 399_999
    assert html.extracted(df.limit(0)).count() == 0


def sentence(i: int) -> str:
    return f"A sentence of the article that is long enough to have a high ratio of text to tags, number {i}."


def paragraphs(*numbers: int) -> str:
    return "".join(f"<p>{sentence(i)}</p>" for i in numbers)


def text(*numbers: int) -> str:
    return "\n".join(map(sentence, numbers))


def test_article_over_sibling_sections():
    for page in (
        f"<div class=content><div class=intro>{paragraphs(1)}</div><div class=text>{paragraphs(2, 3, 4)}</div></div>",
        f"<section>{paragraphs(1)}</section><section>{paragraphs(2, 3, 4)}</section>",
        f"<table><tr><td>{paragraphs(1)}</td><td>{paragraphs(2, 3, 4)}</td></tr></table>",
    ):
        assert html.main_text(f"<body><nav><a href=x>Home</a></nav>{page}<footer>(c)</footer></body>") == text(1, 2, 3, 4), page
    inner = f"<div class=intro>{paragraphs(1)}</div><div class=text>{paragraphs(2, 3, 4)}</div>"
    assert html.main_text(f"<body><div><a href=x>Up</a></div><div class=content>{inner}</div></body>") == text(1, 2, 3, 4)


def test_marks_on_wrappers():
    for wrapper in ('<div class="page has-sidebar">', '<div id="content-with-menu">', '<div class="post no-comments">', "<form action=x>", '<div class="sidebar-layout">', "<div class=menu>", '<body style="display:none">'):
        for a, b in (("", ""), ("<article>", "</article>"), ("<main>", "</main>")):
            page = f"<html>{wrapper}<nav><a href=x>Home</a></nav>{a}{paragraphs(1, 2, 3)}{b}"
            assert html.main_text(page) == text(1, 2, 3), page
    # the marks still hold for what is beside the article
    assert html.main_text(f"<body><div>{paragraphs(1, 2)}</div><div id=comments>{paragraphs(3, 4, 5, 6, 7)}</div></body>") == text(1, 2)
    assert html.main_text(f"<body><article>{paragraphs(1, 2)}</article><div class=related><article>{paragraphs(3)}</article><article>{paragraphs(4)}</article></div></body>") == text(1, 2)
    # where all is marked, the clusters decide
    assert html.main_text(f"<body><div class=comments>{paragraphs(1, 2)}</div></body>") == text(1, 2)


def plain(page: str) -> str:
    """The page as a soup of div elements with neutral classes."""
    for tag in ("article", "nav"):
        page = page.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    return page.replace("<footer>", '<div class="z">').replace("</footer>", "</div>").replace('class="ad"', 'class="x7"')


def soup() -> list[tuple[str, str]]:
    """Pages of div elements without an article element, with neutral classes, and what they are about."""
    links = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(6))
    story = f"<h2>Head</h2>{paragraphs(1, 2)}<p>Short.</p>{paragraphs(3)}"
    words = f"Head\n{text(1, 2)}\nShort.\n{text(3)}"
    return [
        (f"<body><div class=a1>{links}</div><div class=b2>{story}</div><div class=c3>{links}</div></body>", words),
        (f"<body><div class=a1>{links}</div><div class=b2>{story}<div>{links}</div></div></body>", words),
        (f"<table><tr><td>{links}<td>{story}</table>", words),
        ("<div>" * 70 + f"<div><div>{links}</div><div>{story}</div></div>", words),
    ]


def right(spark) -> tuple[int, int, int]:
    """Pages of the table as they are and as div soup, and pages of soup(), whose text comes out right, of all."""
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    as_is = sum(html.main_text(p) == article(p) for p in pages)
    neutral = sum(html.main_text(plain(p)) == article(p) for p in pages)
    return as_is, neutral, sum(html.main_text(p) == want for p, want in soup())


def test_div_soup_with_neutral_classes(spark):
    n = table(spark, "/root/testdata/sf0.01", "pages").count()
    as_is, neutral, small = right(spark)
    assert as_is == n and neutral >= 0.99 * n and small == len(soup())


def test_without_the_ratios_the_soup_fails(spark, monkeypatch):
    for constant in (lambda r: np.ones(len(r)), lambda r: np.zeros(len(r)), lambda r: np.where(np.arange(len(r)) == 0, 1.0, -1.0)):
        monkeypatch.setattr(html, "evidence", constant)
        _, neutral, small = right(spark)
        assert neutral == 0 and small == 0


def test_class_words_count_as_a_whole():
    kept = '<p class="share-price">Up three.</p><div class="ad-hoc">Made for it.</div><p class="promoted-quote">Said so.</p>'
    page = f"<body><div class=menu-bar>Menu</div><div>{paragraphs(1)}{kept}{paragraphs(2)}<div class='advert box--wide'>{paragraphs(9)}</div></div></body>"
    assert html.main_text(page) == f"{text(1)}\nUp three.\nMade for it.\nSaid so.\n{text(2)}"


def test_evidence_against_a_plain_version():
    def plainly(ratios):
        x = [math.log(1 + r) for r in ratios]
        s = []
        for i in range(len(x)):
            near = [(math.exp(-0.5 * ((i - j) / html.SIGMA) ** 2), x[j]) for j in range(len(x)) if abs(i - j) <= html.REACH]
            s.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        low, high = min(s), max(s)
        for _ in range(30):
            up = [v for v in s if v >= (low + high) / 2]
            down = [v for v in s if v < (low + high) / 2]
            if not up or not down:
                break
            low, high = sum(down) / len(down), sum(up) / len(up)
        d = [(max(a, b) - (low + high) / 2) / ((high - low) / 2) for a, b in zip(s, x)] if high > low else [0.0] * len(x)
        return [v / (1 + abs(v)) for v in d]

    rng = random.Random(6)
    for n in (1, 2, 5, 9, 40, 300):
        ratios = [rng.choice([1, 3, 40, 200]) * rng.random() for _ in range(n)]
        assert np.allclose(html.evidence(np.array(ratios)), plainly(ratios))


def test_deep_and_broken_pages():
    for page, chars in (("<div>" * 20_000 + "deep", 4), ("<p>a</p>" * 20_000, 39_999), ("</div>" * 20_000, 0), ("<ul><li>x" * 20_000, 39_999), ("<div><span>" * 20_000 + "</div>" * 30_000 + "x", 1)):
        assert len(html.main_text(page)) == chars
