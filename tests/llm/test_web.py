import html
import re

from graphloom.llm import html_text, queries, url_filter


def test_pages_article_texts(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = queries.op6_html(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:b|br|i|a)\b[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_furniture_goes_and_short_lines_stay():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id='top-menu'><a href=1>One</a> <a href=2>Two</a></div>"
        "<div class=cookie-notice><p>We use cookies on this site, please agree to all of them now.</p></div>"
        "<div class=content><h2>Head &amp; line</h2><p>Long text of the\n article  here and there, it has many words.</p><p>Short.</p>"
        "<p>Another long text of the article &lt;here&gt; and there, with <a href=x>a link</a> and words.</p></div>"
        "<aside><p>Other things that you may read about in the sidebar here.</p></aside><form><label>Your name here please</label><input></form>"
        "<section class='comments'><p>A reader says a long remark about the text of the article.</p></section><footer>All of it &copy; us</footer><script>var x='<p>';</script></body></html>"
    )
    assert html_text.extract(page).split("\n") == [
        "Head & line",
        "Long text of the article here and there, it has many words.",
        "Short.",
        "Another long text of the article <here> and there, with a link and words.",
    ]


LONG = "This long sentence of the article has many words, so that its line has much text and few tags."


def test_furniture_inside_articles():
    page = (
        f"<article class=post><header class='entry-header'><h1>Head</h1></header><p>{LONG}</p><p class=ad>Buy this now.</p><p>Text <button>Press here</button> goes <span class='share-buttons'>Share</span>on.</p>"
        f"<div class=promotion-history><p>How she was promoted: {LONG}</p></div><p>Short.<ul><li>One<li>Two</ul><form><p>Name</p></form><div class='post-comments'><p>I say: {LONG}</p></div></article>"
        f"<article class=comment><p>No, {LONG}</p></article>"
    )
    assert html_text.extract(page).split("\n") == ["Head", LONG, "Text goes on.", f"How she was promoted: {LONG}", "Short.", "One", "Two"]


def test_declarations_do_not_empty_pages():
    body = f"<div class=sidebar><p>About us and others.</p></div><h1>Head</h1><p>{LONG}</p><p>And {LONG}</p>"
    want = ["Head", LONG, f"And {LONG}"]
    for open_, close in (("<form id=aspnetForm>", "</form>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div class='content-form'>", "</div>"), ("<div id=header><form>", "</form></div>")):
        assert html_text.extract(f"<body>{open_}{body}{close}<footer>Us</footer></body>").split("\n") == want, open_
    assert html_text.extract(f"<nav>{LONG}</nav><script>var x = '{LONG}'</script>") == ""


SOUP = (
    "<html><body><div class=x1><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><div class=x2><a href=4>Four and more</a><br><a href=5>Five and more</a></div>"
    f"<div class=x3><h1>The head</h1></div><div class=x4><p>{LONG}</p><p>Short.</p><div class=x5>A caption</div><p>Then {LONG}</p></div><div class=x6><p>At last {LONG}</p></div>"
    "<div class=x7><a href=6>Six</a> <a href=7>Seven</a> <a href=8>Eight</a></div><div class=x8>By us</div></body></html>"
)


def test_ratios_choose_where_markup_says_nothing():
    want = ["The head", LONG, "Short.", "A caption", f"Then {LONG}", f"At last {LONG}"]
    assert html_text.extract(SOUP).split("\n") == want
    assert html_text.extract(SOUP, cut=lambda level: 0.0) != html_text.extract(SOUP) != html_text.extract(SOUP, cut=lambda level: level.max())
    cells = SOUP.replace("<div", "<table><tr><td").replace("</div>", "</td></tr></table>").replace("</td></tr></table><p>Then", "</td></tr></table><p>Then")
    assert LONG in html_text.extract(cells) and "Seven" not in html_text.extract(cells)
    main = f"<main><p>{LONG}</p><p>Short.</p></main><div>By us</div>"
    assert html_text.extract(main).split("\n") == [LONG, "Short."]
    both = f"<main><h1>Head</h1><article><p>{LONG}</p></article><div><p>Read also</p></div></main>"
    assert html_text.extract(both).split("\n") == [LONG]


def test_deep_and_broken_pages():
    assert html_text.extract("<div class=ad>" * 3000 + "x").strip() in ("", "x")
    assert html_text.extract("<b>" * 20_000 + "deep") == "deep"
    assert html_text.extract("</p></div><p>a<p>b") == "a\nb"
    assert html_text.extract("<b>" * 20_000 + "<p>a</i>" * 20_000).count("a") == 20_000


def test_html_edge_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain"), (3, None, "plain"), (None, "u", "<nav>menu</nav>"), (5, "u", "<p>" + "word " * 60_000), (6, "u", "<p>a&ampb<p>c&nbsp;d<")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = [(r["page_id"], r["text"]) for r in html_text.main_text(df).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, "plain"), (3, "plain"), (None, ""), (5, ("word " * 60_000).strip()), (6, "a&b\nc d<")], key=str)
    assert html_text.main_text(df.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b.com", "", "block"), ("b.com", "/fr/x/", "block"), ("org", "/", "allow")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "HTTPS://WWW.Example.ORG/es/x?q#f", "http://example.org/es", "http://example.org/en/12", "http://myexample.org/es/1", "ftp://x.example.org/en/1/2#a://b"]
    urls += [f"http://{h}{p}" for h in ("com", "a.com", "b.com", "a.b.com", "x.a.b.com", "xa.b.com", "com.org", "org.com") for p in ("", "/", "/fr/", "/fr/x/y", "/fr/x", "/de/?a", "?q=/de/", "#/de/")]
    df = spark.createDataFrame([(i % 40, u, "x") for i, u in enumerate([*urls, *urls[:5]])], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    for n in (None, 1, 7):
        got = sorted(map(str, (tuple(r) for r in url_filter.judge(df, rules, ranges=n).collect())))
        assert got == sorted(str((i % 40, *brute(u))) for i, u in enumerate([*urls, *urls[:5]]))


def test_hosts_of_many_labels(spark):
    host = ".".join(["a"] * 60_000)
    df = spark.createDataFrame([(1, f"http://{host}.com/fr/x"), (2, f"http://{host}"), (3, "http://com\x01/x")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/fr/", "block"), ("com", "", "block"), ("a.b.c.com", "/", "block")], "host string, path string, verdict string")
    assert {r["page_id"]: r["rule"] for r in url_filter.judge(df, rules).collect()} == {1: "com/fr/", 2: None, 3: None}


def test_url_rules_without_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in url_filter.judge(df, rules, default="block").collect()] == ["block", "block"]
    assert url_filter.judge(df.limit(0), rules).count() == 0
