import html
import random
import re

from millrace.llm import html as h

BODY = "word " * 30


def text_of(page, **weights):
    return h.main_text(page, {**h.DEFAULT_WEIGHTS, **weights})


def test_region_against_all_pairs():
    pick = random.Random(6)
    for _ in range(500):
        scores = [pick.choice((-3, -1, 0, 1, 2)) for _ in range(pick.randint(0, 14))]
        start, end = h.best_region(scores)
        best = max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])
        assert sum(scores[start:end]) == best


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.extracted(pages).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)</article>", row.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[row.page_id].text == "\n".join(b for b in blocks if b)
        assert got[row.page_id].n_chars == len(got[row.page_id].text)


def test_other_layouts():
    page = f"""<body><div class=header>Site</div><div id="content"><h1>Title</h1><p>{BODY}</p><p>Short.</p>
      <div class="post-comments"><p>{BODY * 3}</p></div></div><div class="sidebar">{BODY}</div></body>"""
    assert text_of(page) == f"Title\n{BODY.strip()}\nShort."
    page = f"""<main><article><header>By me</header><h2>T</h2><div><p>{BODY}<p>{BODY}</div><aside>{BODY}</aside>
      <section id=comments><article class=comment><p>{BODY * 5}</article></section></article></main><div role=alert>{BODY * 9}</div>"""
    assert text_of(page) == f"T\n{BODY.strip()}\n{BODY.strip()}"
    assert text_of(f"<table><tr><td><ul><li>{BODY}<li>b</ul><td>c</table>") == f"{BODY.strip()}\nb"


def test_references_and_white_space():
    assert text_of("<p>a &amp;\n\t b&#33; &lt;i&gt; x&am<br>y</p>") == "a & b! <i> x&am y"
    assert text_of("<div><p>one<b>two</b></p>three<!-- no --> four</div>") == "onetwo\nthree four"
    assert text_of('<p title="a > b">in</p><script>var t="</p>";</script><style>p{}</style>') == "in"


def test_odd_pages(spark):
    pages = ["", None, " ", "<", "<p", "<!--", "<p>x", "</p></p>y", "<script>" * 50, "<b>" * 30_000 + "deep", "<div>x " * 30_000, "<li>a" * 20_000, "<a href='x" * 1000, "<td>z" * 1000]
    rows = spark.createDataFrame([(k % 3 or None, None, p, "clash") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    out = h.extracted(rows).collect()
    assert len(out) == len(pages) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert h.extracted(rows.where("false")).count() == 0
    assert text_of("<p>x") == "x" and text_of("</p></p>y") == "y" and text_of("<b>" * 30_000 + "deep") == "deep"


def test_weights():
    counts = h.counts_of(f"<nav><a>m</a></nav><article><p>{BODY}</p></article><footer>f</footer>")
    weights = h.weights_from(counts)
    assert weights[h.WORD] > 0 > weights["nav"] and weights["p"] < 0
    assert h.weights_from({}) == h.DEFAULT_WEIGHTS


def test_layout_wrappers_keep_their_page():
    inner = f"<article><h1>Title</h1><p>{BODY}</p></article>"
    want = f"Title\n{BODY.strip()}"
    names = ("content has-sidebar", "no-sidebar", "sidebar-right", "header-fixed", "menu-open", "with-comments", "page--has-ads", "noSidebar", "sidebar-layout", "comments-open")
    for name in names:
        for attribute in ("class", "id"):
            side = f"<div class='sidebar'><p>{BODY}</p></div><div class=comments><article><p>{BODY * 4}</p></article></div>"
            assert text_of(f"<body><div {attribute}='{name}'>{inner}</div><footer>f</footer></body>") == want, name
            assert text_of(f"<body><div {attribute}='{name}'><main>{inner}</main>{side}</div></body>") == want, name
            assert text_of(f"<body><div {attribute}='{name}'><div><h1>Title</h1><p>{BODY}</p></div></div></body>") == want, name
    assert text_of(f"<body class='comments-open'><div class='sidebar'>{inner}</div></body>") == want
    assert text_of(f"<div><h1>Title</h1><p>{BODY}</p></div><div class=sidebar-right><p>less</p></div>") == want
    for name in ("post-comments", "comments-area", "sidebar", "related-posts", "cookie-banner", "header footer"):
        assert text_of(f"<div>{want[:5]}<p>{BODY}</p></div><div class='{name}'><p>{BODY * 5}</p></div>") == want, name
        assert text_of(f"{inner}<div class='{name}'><article><p>{BODY * 5}</p></article></div>") == want, name
    assert text_of(f"<div class=comments><article><p>{BODY}</p></article></div>") == ""


def test_values_are_no_names():
    inner = f"<article><h1>Title</h1><p>{BODY}</p></article>"
    want = f"Title\n{BODY.strip()}"
    for attribute in (
        "data-hidden='false'", "title='the hidden truth'", "data-id='sidebar'", "data-role='banner'", 'style="content: hidden"', "alt='role=banner'",
        "aria-label='hidden menu'", "data-x=hidden", "title = \"a class='sidebar' of its own\"", "data-aria-hidden=true", "x='1' data-class=nav", "href=/hidden/id",
    ):
        assert text_of(f"<body><div {attribute}>{inner}</div><footer>f</footer></body>") == want, attribute
    for attribute in ("hidden", "HIDDEN", "title='x' hidden", "data-a=1 role='banner'", "aria-hidden = \"true\"", "hidden=''", "x=\"a'b\" hidden"):
        assert text_of(f"<body>{inner}<div {attribute}><p>{BODY * 5}</p></div></body>") == want, attribute
