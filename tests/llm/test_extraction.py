import re
import time
from html import unescape

from corpuslens.llm.extraction import extract, main_text, parse
from llm_support import SF
from pyspark.sql import functions as F

PARA = "This is a paragraph of the article, with commas, and enough words to count as text. "


def test_article_among_boilerplate():
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
    <nav><a href=x>Home</a></nav><header><h1>Site</h1></header><div id="cookie-notice"><p>{PARA}</p></div>
    <div class="content"><h1>Title &amp; more</h1><p>One<br>two &lt;b&gt;, {PARA}<p>Second <b>bold</b>text&nbsp;here, {PARA}
    <form><p>{PARA}</p></form><ul><li>a</li><li>b</li></ul></div><aside><p>{PARA}</p></aside>
    <section class="comments"><p>{PARA}</p></section><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == " ".join(f"Title & more One two <b>, {PARA} Second boldtext here, {PARA} a b".split())


def test_links_do_not_win():
    links = "".join(f"<li><a href='/{i}'>{PARA}</a></li>" for i in range(30))
    assert main_text(f"<body><div><ul>{links}</ul></div><div><p>{PARA * 3}</p><p>{PARA * 3}</p></div></body>") == " ".join((PARA * 6).split())


def test_siblings_that_score_are_kept():
    part = f"<div class=part><p>{PARA * 4}</p><p>{PARA * 3}</p></div>"
    assert main_text(f"<body><div>{part}{part}</div></body>").count("This is") == 14


def test_all_of_the_article_stays():
    beside = "<h2>Head</h2><ul><li>one<li>two</ul><blockquote>Quote</blockquote><table><tr><td>cell</table><figure><figcaption>Caption</figcaption></figure>bare text"
    links = "<ul>" + "<li><a href=x>link to it</a>" * 5 + "</ul>"
    for n in (1, 3, 12, 60):
        body = f"<div class=body>{f'<p>{PARA}</p>' * n}</div>"
        for tag in ("article", "main", "div"):
            page = f"<body><nav>menu</nav><{tag}><h1>Title</h1><p>short standfirst</p>{body}{beside}<section><p>Short section</p></section>{links}</{tag}></body>"
            want = f"Title short standfirst {PARA * n} Head one two Quote cell Caption bare text Short section"
            assert main_text(page).replace(" " + "link to it " * 4 + "link to it", "") == " ".join(want.split()), (n, tag)
    two = f"<body><main><article><p>{PARA * 9}</p></article><article><p>Short second</p></article></main></body>"
    assert main_text(two).endswith("Short second")


def test_wrappers_with_dropped_words_stay():
    text = f"<h1>Title</h1><p>{PARA * 3}</p><p>{PARA * 3}</p>"
    want = " ".join(f"Title {PARA * 6}".split())
    side = f"<div class=sidebar><p>{PARA}</p></div><div class='comments'><p>{PARA}</p></div>"
    for tag in ("div", "section"):
        for names in ("no-sidebar", "content has-sidebar", "hidden-print", "with-header", "widget-area-content", "legal"):
            for inner in (text, f"<article>{text}</article>", f"<div id=search>{text}</div>"):
                assert main_text(f"<body><nav>menu</nav><{tag} id=page class='{names}'>{inner}{side}</{tag}>{side}</body>") == want, (tag, names, inner)
    assert main_text(f"<body><div class=promo><p>{PARA}</p></div><div class=legal><p>{PARA}</p></div></body>").count("This is") == 2


def test_forms_and_headers_that_wrap_text_stay():
    text = f"<h1>Title</h1><p>{PARA * 3}</p><p>{PARA * 3}</p>"
    want = " ".join(f"Title {PARA * 6}".split())
    nav = "<nav>menu</nav><div class=sidebar><p>" + PARA + "</p></div>"
    for inner in (text, f"<article>{text}</article>", f"<div class=content>{text}</div>"):
        assert main_text(f"<body><form id='aspnetForm' action='/x'><input type=hidden value=1>{nav}{inner}<button>Go</button></form><footer>f</footer></body>") == want
    assert main_text(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p class=byline>By A. Writer</p></header><p>{PARA * 6}</p></article></body>") == " ".join(f"Title By A. Writer {PARA * 6}".split())
    assert main_text(f"<body><article><header><a href=/>Home</a> <a href=/x>All news</a></header>{text}<form><p>{PARA}</p><label>Mail</label></form></article></body>") == want


def test_soft_names_inside_the_article():
    text = f"<h1>Title</h1><p>{PARA * 6}</p>"
    for tag, name in (("section", "legal"), ("p", "alert"), ("div", "disclaimer"), ("div", "masthead"), ("div", "widget legal")):
        for wrap in ("article", "main", "div"):
            got = main_text(f"<body><nav>menu</nav><{wrap}>{text}<{tag} class='{name}'>The law says so, and it is part of this.</{tag}></{wrap}></body>")
            assert got == " ".join(f"Title {PARA * 6} The law says so, and it is part of this.".split()), (tag, name, wrap)
    for part in ("<div class=alert>Menu</div>", "<div class=legal><a href=x>All our terms, here.</a></div>", f"<div class='ad'><p>{PARA}</p></div>", f"<section class='legal comments'><p>{PARA}</p></section>",
                 f"<div class=newsletter><p>{PARA}</p></div>", f"<div class='cookie alert'><p>{PARA}</p></div>", f"<div hidden class=legal><p>{PARA}</p></div>"):
        assert main_text(f"<body><article>{text}{part}</article></body>") == " ".join(f"Title {PARA * 6}".split()), part
    assert main_text(f"<body><div class=legal><p>All rights are reserved, of course.</p></div><article>{text}</article></body>") == " ".join(f"Title {PARA * 6}".split())


def test_parsing_takes_linear_time():
    def spent(page):
        begin = time.process_time()
        main_text(page + "x")
        return time.process_time() - begin

    for make in (
        lambda n: "<div>" * n + "</p>" * n, lambda n: "<b>" * n + "<p>" * n, lambda n: "<ul><li><ul>" + "<b>" * n + "<li>" * n, lambda n: "<table><tr><td>" * n + "<p>" * n,
        lambda n: "<div>" * n + "</b>" * n, lambda n: "<i>" * n + "</div>" * n, lambda n: "<li><p>" * n,
    ):
        assert spent(make(40_000)) < 9 * spent(make(10_000)) + 0.5, make(1)  # four times the tags; a walk per tag takes 16 times as long
    begin = time.process_time()
    parse("<div>" * 100_000 + "</p>" * 100_000)
    assert time.process_time() - begin < 4


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<") .replace("<", "") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<!-- open comment <p>x") == "" and main_text("<script>never closed") == ""
    assert main_text("<p>a &amp b <p title='>'>c") == "a & b c"
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = extract(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        m = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)
        assert r["text"] == " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(h1|p)>|<br>", " ", m[1]))).split())
        assert r["n_chars"] == len(r["text"])


def test_hard_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>" + "long text, " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars")})
    got = extract(df).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 0), ("1", 0), ("2", 549_999), ("None", 0)]
    assert extract(df.limit(0)).count() == 0
