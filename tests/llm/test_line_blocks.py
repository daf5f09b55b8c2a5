"""Pages with known main text: marked and unmarked chrome, broken markup, odd rows."""

import time

import pytest

from tests.llm import odd
from tracesift.llm import line_blocks

TEXT = [f"Absatz {i} — " + odd.prose(i, 30) for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WHOLE = " ".join(TEXT)

CHROME = [
    "<nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></nav>",
    "<header><h1>The Daily</h1><p>All the news of the day, in one place and for everyone.</p></header>",
    "<aside><p>Read also our long and interesting series about all other things.</p></aside>",
    "<div class='site-sidebar'><p>Weather: sunny with some clouds over the northern coast today.</p></div>",
    "<div id=cookieNotice><p>We use cookies and similar methods to recognise visitors, agree or leave.</p></div>",
    "<div class=\"ad\"><p>Buy now, it's cheap and good and will make you happy until the end.</p></div>",
    "<form action=/s><label>Search the whole site with words of your own</label><input name=q><textarea>x</textarea></form>",
    "<script>var t = '<p>not text</p>'; if (a < b && c > d) x();</script><style>p > a{color:red}</style>",
    "<!-- <p>hidden comment</p> --><noscript>Please turn on scripts</noscript>",
    "<section id='comments'><h2>Comments</h2><article><p>I read this twice and still disagree with nearly all of it.</p></article></section>",
    "<footer>&copy; 2020 The Daily &middot; all rights and lefts reserved by us.</footer>",
    "<p hidden>Not shown to anyone at all</p><div style='display: none'>nor this</div><div role=alert>Breaking: wet water</div>",
]


@pytest.mark.parametrize("place", ["before", "after", "both"])
@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main><div>%s</div></main>", "<div id=content>%s</div>"])
def test_marked_chrome(frame, place):
    chrome = "".join(CHROME)
    page = f"<html><head><title>T</title></head><body>{chrome * (place != 'after')}{frame % BODY}{chrome * (place != 'before')}</body></html>"
    assert line_blocks.main_text(page) == WHOLE


def test_chrome_inside_the_article():
    inside = "".join(CHROME).replace("<header><h1>The Daily</h1>", "<header>")
    assert line_blocks.main_text(f"<article>{BODY}{inside}{BODY}</article>") == f"{WHOLE} {WHOLE}"
    page = "<article><header><h1>The <i>Ti</i>tle</h1><p>by someone</p></header><div class='entry-header'>Kept</div><p>x</p></article>"
    assert line_blocks.main_text(page) == "The Title Kept x"


def test_surge_and_dive_without_any_marks():
    """Menus of links, short scattered lines and a far-off note: only the distribution tells them from the text."""
    menu = "".join(f"<div><a href='/{i}'>{odd.prose(i, 6)}</a></div>" for i in range(8))
    page = f"<body>{menu}<div>Contact</div>{menu}<h1>Title</h1>{BODY}<p>End.</p>{menu}<div>A short remark.</div>{menu}</body>"
    assert line_blocks.main_text(page) == f"Title {WHOLE} End."
    # two parts of text with links between them are both kept
    assert line_blocks.main_text(f"{menu}{BODY}{menu}{BODY}") == f"{WHOLE} {WHOLE}"
    # links within the text stay
    assert line_blocks.main_text(f"{menu}<p>{TEXT[0]}</p><div><a href=x>linked</a></div><p>{TEXT[1]}</p>") == f"{TEXT[0]} linked {TEXT[1]}"


def test_the_distribution_decides(monkeypatch):
    menu = "".join(f"<div><a href='/{i}'>link</a></div>" for i in range(8))
    page = f"{menu}<div>note</div>{menu}{BODY}"
    assert line_blocks.main_text(page) == WHOLE
    monkeypatch.setattr(line_blocks, "SURGE", 0)
    assert line_blocks.main_text(page) == f"note {WHOLE}"


def test_cards_beside_the_article():
    cards = "".join(f"<article><h3>{t[:20]}</h3></article>" for t in TEXT[:3])
    assert line_blocks.main_text(f"{cards}<article>{BODY}</article>{cards}") == WHOLE


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("plain text only", "plain text only"),
        ("<article>a<b>b</b>c <i>d</i>\n\n e&nbsp;f</article>", "abc d e f"),
        ("<article><p>one<br>two<p>three<li>four<li>five", "one two three four five"),
        ("<article>a &amp;lt; b &lt;p&gt; &#x27;&#233;&am &amp", "a &lt; b <p> 'é&am &"),
        ("<article>x <!-- > --> y <!--> z --!> q</article>", "x y z --!> q"),
        ("<article>1 < 2 and 3 > 2 <></article>", "1 < 2 and 3 > 2 <>"),
        ("<article title='a > b' data-x=\"<p>\">in</article>out", "in"),
        ("<article>kept <a href=\"unclosed>lost", "kept lost"),
        ("<article><script>never closed <p>x</p>", ""),
        ("<article>a</b></i></section>b<div>c</article>d", "a b c"),
        ("<article><p class=ad>advert<p>text</article>", "text"),
        ("<form id=all><div><article>inside</article></div>outside</form>", "inside"),
        ("<body class=has-sidebar><div class='no-ads wide'>text</div></body>", "text"),
        ("<article><pre><span class='token comment'># note</span></pre></article>", "# note"),
        ("<ARTICLE><P>UP</P></ARTICLE><FOOTER>x</FOOTER>", "UP"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
        ("<a name=top><p>anchor, no link, so this text is text</p>", "anchor, no link, so this text is text"),
    ],
)
def test_markup(page, text):
    assert line_blocks.main_text(page) == text


def test_odd_rows(spark):
    page = f"<nav>x</nav><article>{BODY}</article>"
    long_page = f"<article>{'<p>wort</p>' * 200_000}</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", ""), (4, "x", long_page), (5, "y", "\x00퟿￿")]
    table = spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], "page_id long, url string, html string, keys string, `n.chars` int")
    got = line_blocks.extract(table, ["page_id", "url", "n.chars"], "html").collect()
    want = [WHOLE, WHOLE, WHOLE, "", "", " ".join(["wort"] * 200_000), "\x00퟿￿"]
    order = lambda r: (str(r[0]), r[3])
    assert sorted(map(tuple, got), key=order) == sorted(((i, u, 1, t, len(t)) for (i, u, _), t in zip(rows, want, strict=True)), key=order)
    assert line_blocks.extract(table.limit(0), ["page_id"], "html").count() == 0


@pytest.mark.parametrize("piece", ["<div>", "<p><b>", "<a href=\"", "<!--", "</div", "<i>x</b>", "&amp", "< ", "<li>", "<article>", "='"])
def test_time_grows_with_the_length(piece):
    start = time.perf_counter()
    line_blocks.main_text("<article>" + piece * 100_000)
    assert time.perf_counter() - start < 20
