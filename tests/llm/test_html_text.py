import time
import pytest

from casebook.llm.html_text import composite, main_text, main_texts

PARAGRAPH = "Enough words in this paragraph to make it the dense part of the page, as articles are. "
CASES = {
    "": "",
    "just text <b>bold</b> &amp; <3 x": "just text bold & <3 x",
    "<body><nav><a href=/>home</a></nav><article><h1>T</h1><p><b>a.<br><p>b &copy; c</p></article><footer>f</footer>": "T a. b © c",
    "<p>one</p><script>if (a < b) { '</p>' }</script><style>p{}</style><p>t<i>w</i>o</p>": "one two",
    "<body><!-- <p>no</p> --><p>yes<p>and  \n more": "yes and more",
    "<p>a <a href=\"x>b</p> more": "a b more",
    "<body><form id=page><div><p>All of the page is in a form.</p><p>More of it.</p></div></form>": "All of the page is in a form. More of it.",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
    "<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl>": "a b c d",
    "<p>x&nbsp;y &#x41;&#66; &unknown; &lt;b&gt;</p>": "x y AB &unknown; <b>",
    "</p></div><p>still</p></body></html>": "still",
    "<nav>only</nav><footer>furniture</footer>": "",
    "<!-- never closed <p>x</p>": "",
    "<script>never closed <p>x</p>": "",
}


@pytest.mark.parametrize("markup", CASES)
def test_cases(markup):
    assert main_text(markup) == CASES[markup]


def test_page_without_article_element():
    page = f"""<body class="has-sidebar"><div id="header"><h1>Site</h1><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div>
      <div class="wrap"><div class="content"><h2>Title of it</h2><p>{PARAGRAPH * 3}<p>{PARAGRAPH}<blockquote>quoted</blockquote></div>
      <div class="right"><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></div></div>
      <div class="comments"><p>{PARAGRAPH * 9}</p></div><div class="site-footer">(c)</div>"""
    assert main_text(page) == f"Title of it {(PARAGRAPH * 3).strip()} {PARAGRAPH.strip()} quoted"


def test_article_with_furniture_inside():
    page = f"""<main><article class="post"><header class="entry-header"><h1>T</h1><div class="meta">by x</div></header>
      <p>{PARAGRAPH}</p><div class="ad">buy</div><aside>aside</aside><form>f<input></form><ul><li>one</li><li>two</li></ul></article>
      <section id="comments"><article class="comment"><p>{PARAGRAPH * 20}</p></article></section></main>"""
    assert main_text(page) == f"T {PARAGRAPH.strip()} one two"


def test_layout_class_around_everything():
    page = f"""<body><div class="layout has-sidebar"><div class="text"><p>{PARAGRAPH * 2}<p>{PARAGRAPH}</div><div id="sidebar">s</div></div>
      <div id="comments">{PARAGRAPH * 9}</div>"""
    assert main_text(page) == f"{(PARAGRAPH * 2).strip()} {PARAGRAPH.strip()}"


def test_long_and_deep_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(main_text("<p>" + "word " * 400_000 + "</p>")) == 1_999_999
    assert main_text("<a " * 20_000) == " ".join(["<a"] * 20_000)
    assert main_text("<" * 50_000 + "x") == "<" * 50_000 + "x"


@pytest.mark.parametrize(
    "page",
    ["<span>" * 100_000 + "</b>" * 100_000, "<b>x</b>" + "<span>" * 100_000 + "</b>" * 100_000, "<span>" * 100_000 + "<hr>" * 100_000,
     "<span>" * 100_000 + "<li>" * 100_000],
)
def test_unmatched_tags_take_linear_time(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 8


def test_density_falls_with_links_and_tags():
    assert composite(100, 0, 1, 0, 0.1) > composite(100, 50, 1, 1, 0.1) > composite(100, 100, 1, 1, 0.1) == 0
    assert composite(100, 0, 1, 0, 0.1) > composite(100, 0, 10, 0, 0.1)


def test_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r for r in main_texts(pages).collect()}
    assert got.keys() == source.keys()
    for i, markup in source.items():
        inner = re.sub(r"</?b>", "", re.search("<article>(.*?)</article>", markup, re.DOTALL)[1])
        want = " ".join(html.unescape(re.sub("<[a-zA-Z/][^>]*>", "\n", inner)).split())
        assert (got[i].text, got[i].n_chars) == (want, len(want))


def test_awkward_rows(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x", 2), (2, None, "", 3)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(str, got)) == sorted(
        str(r) for r in main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect()
    ) + sorted(map(str, got))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("None", "x", 1)]


def test_a_tag_name_does_not_decide():
    text = PARAGRAPH.strip()
    long = f"<p>{PARAGRAPH * 4}</p><p>{PARAGRAPH * 3}</p>"
    want = f"{(PARAGRAPH * 4).strip()} {(PARAGRAPH * 3).strip()}"
    # A small article neither replaces the main element around it nor text outside it.
    assert main_text(f"<body><main>{long}<article>teaser</article></main></body>").startswith(want)
    assert main_text(f"<body><div>{long}</div><article><a href=1>teaser</a></article></body>") == want
    assert main_text(f"<body><div class=has-sidebar>{long}</div><article><a href=1>teaser</a></article></body>") == want
    # All articles that share the text are kept, with a main element around them or not.
    parts = "".join(f"<article><h2>{i}</h2><p>{PARAGRAPH * k}</p></article>" for i, k in enumerate((1, 5, 2)))
    all_parts = " ".join(f"{i} {(PARAGRAPH * k).strip()}" for i, k in enumerate((1, 5, 2)))
    for page in (f"<main>{parts}</main>", f"<div>{parts}</div>", f"<main><section>{parts}</section><div><a href=1>x</a></div></main>"):
        assert main_text(f"<body>{page}<div><a href=1>a</a><a href=2>b</a></div></body>") == all_parts
    # Dense text beside an article is taken by its density, thin text is not.
    beside = f"<body><article><p>{PARAGRAPH * 4}</p><p>{PARAGRAPH * 4}</p></article><div><p>{PARAGRAPH * 6}</p></div><div><i>thin</i></div></body>"
    assert main_text(beside) == " ".join([text] * 14)


def test_link_lists_in_the_article_stay():
    links = "".join(f"<li><a href={i}>source {i}</a></li>" for i in range(4))
    table = "<table>" + "".join(f"<tr><td><a href={i}>chapter {i}</a></td></tr>" for i in range(4)) + "</table>"
    page = f"<body><article><p>{PARAGRAPH * 3}</p><ul>{links}</ul>{table}<ul class=pager>{links}</ul></article></body>"
    assert main_text(page) == f"{(PARAGRAPH * 3).strip()} source 0 source 1 source 2 source 3 chapter 0 chapter 1 chapter 2 chapter 3"


def test_math_and_svg_labels():
    page = f"""<article><p>{PARAGRAPH}<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2</annotation></semantics></math> holds.</p>
      <svg><title>t</title><desc>d</desc><defs><path/></defs><path d="M0"/><text>left</text><g><text>right <tspan>side</tspan></text></g></svg><p>after</p></article>"""
    assert main_text(page) == f"{PARAGRAPH}x=2 holds. left right side after"
    assert main_text("<article><svg><path d=1><p>never closed</article>") == "never closed"
