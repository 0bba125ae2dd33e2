import html
import re

import edges
from keylink.llm.html_text import blocks, extract_text

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header>Site name</header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News &amp; more</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for all of you</div>
<article><header><h1>The  title &eacute;</h1></header><p>First <b>para</b>graph &#8212; with a
line break<br>and <a href="x">a link</a> in the middle of many other words.<p>Unclosed &amp second
<form><input><label>Your name</label></form><script>var t="</p>";</script>
<section class="comments"><p>I like this article so much that I have to write a long comment</p></section>
<ul><li>one item</li><li>two</li></ul></article><aside><p>Sidebar text that goes on for a while here</p></aside>
<div id="ad-1">Buy now</div><footer>&copy; someone</footer></body></html>"""
TEXT = "The title é\n\nFirst paragraph — with a line break and a link in the middle of many other words.\n\nUnclosed & second\n\none item\n\ntwo"


def test_article_without_furniture(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 60 + "<b"), (1, "u", PAGE)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted(
        [(1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, ("word " * 60).strip())]
    )
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(edges.empty(spark), "text").collect() == []


def test_generated_pages(spark, sample):
    """Held against the articles of the test pages, cut out by their tags."""
    pages = spark.read.parquet(f"{sample}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", article)
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        assert got[r["page_id"]] == "\n\n".join(t for t in texts if t)


def test_elements_without_a_closing_tag_lose_nothing_else():
    prose = "word " * 60
    kept = lambda page: " ".join(b[0] for b in blocks(page)).split()
    for before in (
        "<head><title>no</title><style>p{}</style><body>", "<head><meta charset=x><body>", "<svg width=1 />",
        "<form action=x>", "<select>", "<button>", "<object data=x>", "<svg>", "<noscript>", "<template>",
    ):
        assert kept(f"<html>{before}<p>{prose}") == prose.split(), before
        assert kept(f"<html>{before}<p>{prose}<form>a</form><object>b</object><svg><g/></svg>") == prose.split(), before
    assert kept(f"<form>a</form><p>{prose}<object>b<object>c</object>d</object><svg><title/>e</svg>") == prose.split()
    assert kept(f"<form><p>{prose}<script>'</form>'") == prose.split()
    assert kept(f"<p>{prose}<script>no <p>end") == prose.split()


def texts(spark, *pages):
    rows = [(i, "u", p) for i, p in enumerate(pages)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


PROSE = "many words of an article that tells a story and goes on for quite a while before it ends"


def test_parts_of_an_article_stay(spark):
    article = f"<article><p>{PROSE}</p>{{}}<p>{PROSE}</p></article>"
    for part in (
        '<div class="legal">the law of the land says so</div>',
        '<section class="related-work"><p>others have tried this before</p></section>',
        '<p><a href="x">The whole report can be found here</a></p>',
        '<div id="header"><b>A second part</b></div>',
    ):
        inner = re.sub("<[^>]*>", "", part)
        assert texts(spark, article.format(part)) == [f"{PROSE}\n\n{inner}\n\n{PROSE}"], part
    links = "".join(f"<li><a href=x{i}>another story</a></li>" for i in range(4))
    assert texts(spark, article.format(f"<ul>{links}</ul>")) == [f"{PROSE}\n\n{PROSE}"]


def test_furniture_and_reader_comments_go(spark):
    page = f"<body>{{}}<article><p>{PROSE}</p></article>{{}}</body>"
    comment = '<ol class="commentlist"><li><p>I have to say that I liked this story more than the last one</p></li></ol>'
    for part in (
        comment, '<div class="legal">All rights reserved by someone</div>',
        '<div class="related"><p>Read also what happened to the other one last year</p></div>',
    ):
        assert texts(spark, page.format(part, ""), page.format("", part)) == [PROSE, PROSE], part
    inside = f"<article><p>{PROSE}</p>{comment}</article>"
    assert texts(spark, inside) == [PROSE]


def test_elements_within_a_line_do_not_end_it(spark):
    for element in (
        "<svg><path/></svg>", "<script>x</script>", "<button>no</button>", "<object>no</object>",
        "<select><option>no</select>", "<textarea>no</textarea>", "<!-- no -->", "<template>no</template>",
    ):
        got = texts(spark, f"<article><p>one {element} two {PROSE}</p><p>a{element}b {PROSE}</p></article>")
        assert got == [f"one two {PROSE}\n\nab {PROSE}"], element


def test_a_page_with_one_short_text(spark):
    assert texts(spark, "<html><body>Short answer to you.</body></html>", "Yes", "<p>One <b>word</b></p>") == [
        "Short answer to you.", "Yes", "One word",
    ]


def test_long_pages_and_clashing_columns(spark):
    page = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, page, "own", 7, "dot"), (2, None, "own", 7, "dot")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string, _html int, `a.b` string")
    got = {r["page_id"]: r for r in extract_text(frame).collect()}
    assert got[1]["text"] == "\n\n".join([PROSE] * 20_000) and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and (got[2]["_html"], got[2]["a.b"]) == (7, "dot")


def test_prose_outside_of_articles_beside_links(spark):
    links = "<ul>" + "<li><a href=x>some link</a></li>" * 3 + "</ul>"
    page = f"<body>{links}<div><p>{PROSE}</p><p>{PROSE} again</p></div>{links}</body>"
    assert texts(spark, page) == [f"{PROSE}\n\n{PROSE} again"]
