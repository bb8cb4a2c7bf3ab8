from __future__ import annotations

import pytest

from tabulary.llm.html_blocks import blocks_of, extract, main_text

SENTENCE = "The people of the town went to the river and saw that it was the best of the days in the year."
PAGE = f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>Title</title><style>p{{margin:0}}</style>
<script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- ad <p>no</p> --><div class="ad">{SENTENCE}</div><article><h1>A &amp; B</h1><p><b>{SENTENCE}<br>
<p>Be.</p><p>x</p></article><div id="comments"><p>{SENTENCE}</p></div><footer>&copy; me &middot; {SENTENCE}</footer>"""


def test_article_page():
    assert main_text(PAGE) == f"A & B\n{SENTENCE}\nBe.\nx"
    assert main_text(PAGE + "</body></html>") == main_text(PAGE)


def test_boilerplate_inside_an_article_goes():
    page = f"""<article><h1>Head</h1><p>{SENTENCE}</p><aside>{SENTENCE}</aside><div class="share-bar">{SENTENCE}</div>
    <form>{SENTENCE}<input value="x"></form><ul class="relatedPosts"><li>{SENTENCE}</li></ul>
    <section id="reader-comments"><p>{SENTENCE}</p></section><p>{SENTENCE} End</p></article>"""
    assert main_text(page) == f"Head\n{SENTENCE}\n{SENTENCE} End"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><article>{}</article></body>",
        "<body class='no-sidebar widget'><main>{}</main></body>",
        "<body class='sidebar'><p>{}</p></body>",
        "<div id='page' class='with-sidebar'><p>{}</p></div>",
        "<div id='page' class='with-sidebar'><article>{}</article></div>",
        "<div class='sidebar-layout'><div class='adPage'><article>{}</article></div></div>",
        "<div class='sidebar-layout'><main>{}</main></div><article>" + SENTENCE * 3 + "</article>",
        "<div class='sidebar-layout'><article>{}</article></div><article>Teaser</article>",
        "<article class='post has-header-image'>{}</article>",
        "<article id='social-policy'>{}</article>",
        "<main class='banner'><div class='social'><article id='social-policy'>{}</article></div></main>",
    ],
)
def test_names_of_wrappers_and_states_do_not_drop_the_article(page):
    assert SENTENCE in main_text(page.format(SENTENCE)).split("\n")
    mixed = f"<div class='share'>Share</div><p>Short.</p><p>{SENTENCE}</p>"
    assert main_text(page.format(mixed)).startswith(f"Short.\n{SENTENCE}")


def test_articles_of_comments_and_teasers_still_go():
    comments = f"<section class='comments'><article class='comment'>{SENTENCE}</article></section>"
    body = f"<p>{SENTENCE}</p><p>End.</p>"
    for page in (
        f"<article>{body}</article>{comments}",
        f"<article>{body}{comments}</article>",
        f"<main><article>{body}</article>{comments}</main>",
        f"<main>{body}{comments}</main>",
        f"<article>{body}<article class='comment'>{SENTENCE}</article></article>",
    ):
        assert main_text(page) == f"{SENTENCE}\nEnd."


def test_short_and_odd_articles_stay_whole():
    assert main_text("<nav>x</nav><article>One.</article><footer>y</footer>") == "One."
    odd = "zzz### qqq$$$ " * 20
    assert main_text(f"<article><p>{odd}</p><p>k</p></article>") == f"{odd.strip()}\nk"
    linked = f"<p><a href=/x>{SENTENCE}</a></p>"
    assert main_text(f"<article>{linked}<p>{SENTENCE}</p></article>") == f"{SENTENCE}\n{SENTENCE}"


def test_pages_without_article_follow_the_rules():
    page = f"""<div><a href=/>Home</a> <a href=/b>About us and all the others of the firm</a></div><h2>Head line</h2>
    <p>{SENTENCE}</p><p>Short one.</p><p>{SENTENCE}</p><p>&copy; all of the rights of the firm</p><div>Tail</div>"""
    assert main_text(page) == f"Head line\n{SENTENCE}\nShort one.\n{SENTENCE}"
    assert main_text("<p>only this</p>") == ""
    noise = "lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore dolore magna"
    assert main_text(f"<p>{SENTENCE}</p><p>{noise}</p>") == SENTENCE


@pytest.mark.parametrize(
    "text",
    [
        "Люди города пошли к реке и увидели, что это был лучший день в году, а потом вернулись домой.",
        "Ludzie z miasta poszli nad rzekę i zobaczyli, że to był najlepszy dzień w roku, po czym wrócili.",
        "镇上的人们走到河边，看到这是一年中最好的日子，然后他们高兴地回家了，晚上还一起唱歌。",
    ],
)
def test_pages_in_other_languages_are_judged_by_length_and_links(text):
    page = f"<div><a href=/>{text}</a></div><h2>{text[:9]}</h2><p>{text}</p><p>{text}</p><div class=ad>{text}</div>"
    assert main_text(page) == "\n".join([" ".join(text[:9].split()), text, text])


def test_code_tables_and_lists_among_good_blocks_stay():
    odd = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho"
    for part in (f"<pre>{odd}</pre>", f"<table><tr><td>{odd}</td></tr></table>", f"<ul><li>{odd}</li></ul>"):
        assert main_text(f"<p>{SENTENCE}</p>{part}<p>{SENTENCE}</p>") == f"{SENTENCE}\n{odd}\n{SENTENCE}"


@pytest.mark.parametrize("tag", ["svg", "object", "button"])
def test_skipped_elements_end_where_they_do(tag):
    text = f"<p>{SENTENCE}</p>"
    for mark in (f"<{tag}/>", f'<{tag} class="x" />', f"<{tag}>", f"<{tag}>x</{tag}>"):
        got = main_text(f"<article>{mark}{text}<{tag}>no</{tag}>{text}</article>")
        assert got == f"{SENTENCE}\n{SENTENCE}"
    nested = f"<svg><svg><text>no</text></svg><text>no</text></svg>{text}"
    assert main_text(f"<article>{nested}</article>") == SENTENCE


def test_references_and_white_space():
    page = "<main><p>a&nbsp;&nbsp;b &lt;tag&gt; &#233;&#x41; &amp;amp; &unknown; &am\n\t c<b> d</b>e 1 < 2</p></main>"
    assert main_text(page) == "a b <tag> éA &amp; &unknown; &am c de 1 < 2"


@pytest.mark.parametrize(
    "page",
    [
        None, "", " ", "<", "<!--", "<script>", "<p", '<p class="x', "</div></div>", "<a <b>>", "<article>" * 500,
        "<p title='>'>", "&", "&#xFFFFFFFF;", "<![CDATA[ x ]]>", "<?xml ?>", "\x00",
    ],
)
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_markup_with_many_quotes_stays_fast():
    assert main_text("<article>" + '<p class="' * 2000 + "x") == ""
    assert len(blocks_of("<div>" * 5000 + "x")) == 1


def test_extract(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 6), (3, "u", "", 7), (1, "u", PAGE, 5), (4, "v", "<article>" + "<p>w</p>" * 9000, 8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, label int")
    got = sorted(extract(frame).collect(), key=str)
    assert len(got) == 5
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == main_text(PAGE) and by_id[2].text == by_id[3].text == ""
    assert by_id[4].text == "\n".join(["w"] * 9000) and by_id[4].label == 8
    assert extract(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already has"):
        extract(frame, out="label")


def _article(page):
    """The article of a generated test page, by plain cuts."""
    import html
    import re

    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br)[^>]*>", inner)
    texts = (" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_generated_pages(spark, sf):
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert main_text(row.html) == _article(row.html)
