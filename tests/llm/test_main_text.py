import html as library
import random
import re

import pytest

from hydrorisk.llm.main_text import _regions, extract_main_text, main_text
from hydrorisk.llm.queries import op11_html_extraction

SF = "/root/testdata/sf0.01"
LONG = [
    "The river rose by two metres in the night, and by dawn the lower town was cut off from the road.",
    "Short one.",
    "Engineers opened the sluices at six; the water fell slowly during the day &amp; stood still at dusk.",
    "No one was hurt, the mayor said, but the damage to the fields is such that the harvest is lost.",
]
TEXT = [library.unescape(p) for p in LONG]
MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in LONG)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_marked_article_among_everything_else():
    body = f"""
    <header><h2>The Daily Example</h2><p>All the news that is an example, every day of the week, all year.</p></header>
    <nav>{MENU}</nav><div class="cookie-notice"><p>We use cookies to make this site work better for you and for us.</p></div>
    <main><article><header><h1>The flood</h1></header>{PARAGRAPHS}
    <div class="advert"><p>Buy one umbrella now and you will get a second one for nothing at all, today.</p></div>
    <form><label>Your mail</label><input><button>Sign up</button></form>
    <p>Last words<script>var t = "</p>not text";</script> of it.</p></article>
    <aside><h3>Most read</h3><p>A man in the next town found a very old coin in his garden last week.</p></aside>
    <section id="comments"><h2>3 comments</h2><article class="comment"><p>{'I do not believe a word of it. ' * 30}</p></article></section>
    </main><footer><p>&copy; Example. All rights reserved, and all wrongs too, as far as the law allows.</p></footer>
    <noscript>Switch it on</noscript>"""
    assert main_text(page(body)) == "\n\n".join(["The flood", *TEXT, "Last words of it."])


def test_text_surges_and_dives_where_nothing_is_marked():
    body = f"""
    <div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/a">About us</a></div>
    <div><div>Welcome!</div></div>
    <div><h1>The flood</h1>{PARAGRAPHS}</div>
    <div><div>Contact</div></div><div><a href="/i">Imprint</a></div>"""
    assert main_text(page(body)) == "\n\n".join(["The flood", *TEXT])


def test_regions_run_from_surge_to_dive():
    assert _regions([0, 5, 0, 0, 40, 3, 0, 30, 0, 0, 0, 8], 25) == [(3, 8)]
    assert _regions([30, 0, 0, 30], 25) == [(0, 1), (2, 4)]
    assert _regions([], 25) == []


def test_comments_without_marks_end_the_article():
    body = f"<div><h1>The flood</h1>{PARAGRAPHS}</div><div><h3>12 Comments</h3><p>{'What nonsense. ' * 40}</p></div>"
    assert main_text(page(body)) == "\n\n".join(["The flood", *TEXT])


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("no markup, yet more than a few words of text", "no markup, yet more than a few words of text"),
        ("<article></article>", ""),
        ("<article><p>a&nbsp;&#228;\n\t b<br>c<p><b>d<i>e</b></article>", "a ä b c\n\nde"),
        ("<article><p>one<p>two<ul><li>x<li>y</ul></article", "one\n\ntwo\n\nx\n\ny"),
        ("<article><p>1 < 2 &amp;lt; &am &unknown; <!-- no --> <![if x]>z<![endif]></article>", "1 < 2 &lt; &am &unknown; z"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</article>", "yes"),
        ("<nav><p>only a menu</nav><footer>and a footer</footer>", ""),
        ("<body class='has-sidebar'><div class='page-content'><article>kept</article></div>", "kept"),
        ("<main><h1>Title</h1><article><p>Text</article></main>", "Title\n\nText"),
        ("<article><table><tr><td>a<td>b</table></article>", "a\n\nb"),
        ("<article><div class='entry-header'><h1>T</h1></div><p class='byline'>By X</p><div class='ad-slot'>buy</div>t", "T\n\nBy X\n\nt"),
        ("<div class='right-side'>side text that is long enough to surge</div><div class='alert'>take care of this alert now</div>", ""),
    ],
)
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_very_long_page_is_kept_whole():
    words = [f"word{i}." for i in range(200_000)]
    html = page("<article>" + "".join(f"<p>{w}</p>" for w in words) + "</article>")
    assert main_text(html) == "\n\n".join(words)


def test_random_markup_never_fails():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div>", "</div", "<a href='", "<!--", "-->", "<script>", "</script>", "<![", "&#x0;", "<li>", "</ul>", "text ", "<", ">", '"', "<article>", "<td>", "&", "</article>"]
    for _ in range(500):
        assert isinstance(main_text("".join(rng.choices(bits, k=rng.randint(1, 60)))), str)


def test_given_pages_equal_their_articles(spark):
    """Every page of the table: the blocks between the marks of its article."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = op11_html_extraction(spark, SF).collect()
    assert len(found) == len(pages)
    for row in found:
        article = re.search(r"<article>(.*)</article>", pages[row.page_id].html, re.DOTALL).group(1)
        article = re.sub(r"</?b>", "", article).replace("<br>", " ")
        blocks = [" ".join(library.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(b for b in blocks if b)
        assert (row.url, row.n_chars) == (pages[row.page_id].url, len(row.text))


def test_table_with_nulls_clashing_names_and_no_rows(spark):
    rows = [(1, "<article>a", "old"), (None, None, None), (1, "<article>a", "old")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    found = extract_main_text(pages)
    assert found.columns == ["page_id", "html", "text"]
    assert sorted(r.text for r in found.collect()) == ["", "a", "a"]
    assert extract_main_text(pages.limit(0)).collect() == []
    assert "html2" in extract_main_text(pages.withColumnRenamed("html", "html2"), html="html2").columns
