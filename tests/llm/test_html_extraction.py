import random
import re
import time

from tessera.llm import html_extraction

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Home</a></header><nav><ul><li>menu one</li></ul></nav>
<div class="cookie-notice"><p>we use cookies on this site and so on and on</p></div>
<div class="wrap-{0}"><article class="post-{0}"><h1>Title {0}</h1><p>First &amp; <b>bold</b>
 text&nbsp;here.<p>Second <i>one</i><br>more<ul><li>item a<li>item b</ul><div class="ad">buy</div><form>mail <input></form></article>
<section class="comments"><p>I disagree with all of this, and at length too, as readers do.</p></section></div>
<aside><p>related</p></aside><footer>&copy; 2024</footer></body></html>"""

WANT = "Title {0}\nFirst & bold text here.\nSecond one more\nitem a\nitem b"


def test_article_only():
    for n in (1, 22):
        assert html_extraction.Page(PAGE.format(n)).text([]) == WANT.format(n)


def test_odd_pages():
    for source, text in ((None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<!-- <p>b</p> -->c", "ac"), ("<script>x", ""), ("a<p>b</p", "a\nb</p"), ("<div>1<br>2&lt;</div>", "1 2<")):
        assert html_extraction.Page(source).text([]) == text


def test_only_whole_class_names_drop():
    for source, text in (
        ("<div class='content-with-sidebar'><p>a b</p></div>", "a b"), ("<article><div class='entry-header'><h1>T</h1></div><p>x</p></article>", "T\nx"),
        ("<p>x</p><blockquote class='social-quote'>q</blockquote>", "x\nq"), ("<p>a <math><mi>x</mi></math> b</p>", "a x b"),
        ("<form id='aspnet'><article><h1>T</h1><p>x</p></article></form>", "T\nx"), ("<p>x</p><form><p>write to us</p><input></form>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p></article><header>site</header>", "T\nx"), ("<div class='main-nav'>m</div><p>x</p>", "x"),
        ("<div id='site-footer'>f</div><div class='comments-area'>c</div><p>x</p>", "x"), ("<head><title>t</title><body><p>x", "x"),
        ("<ul><li><p>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<article><table><tr><td>a<td>b<tr><th>c</table></article>", "a\nb\nc"), ("a < b <p>c <", "a < b\nc <"),
        ("<a title='x > y'>l</a> m", "l m"), ("<p class=\"a>b</p>c", "b\nc"),
    ):
        assert html_extraction.Page(source).text([]) == text, source


def test_hostile_pages_take_linear_time():
    n = 100_000
    for source in ("<a " * 3 * n, '<a "' * 2 * n + ">", "<b>" * n + "<li></li>" * n, "<div class='a'>" * n + "x", "</p>" * 2 * n, "<script></script " * n, "<!a" * 3 * n, "<p><b>" * n, "<table><b>" * 20 + "<b>" * n + "<hr>" * n):
        start = time.process_time()
        page = html_extraction.Page(source)
        page.text([]), page.votes()
        assert time.process_time() - start < 10
    assert html_extraction.Page("<div>" * n + "deep").text([]) == "deep"


def plain(pages):
    """All of the method in one place: every path's votes, and each page's text by its path with most votes."""
    votes = {}
    for _, url, source in pages:
        host = re.match(r"[a-z]+://([^/:?#]*)", (url or "").lower())
        for path, share in html_extraction.Page(source).votes().items():
            key = (host[1] if host else "", path)
            votes[key] = votes.get(key, 0) + share
    out = []
    for i, url, source in pages:
        host = re.match(r"[a-z]+://([^/:?#]*)", (url or "").lower())
        page = html_extraction.Page(source)
        ranked = sorted(page.filled(), key=lambda p: (-round(votes.get((host[1] if host else "", p), 0), 6), p))
        out.append((i, page.text(ranked[:1])))
    return sorted(out)


def test_matches_plain_voting(spark, tmp_path):
    """Also pages whose paths are none of the host's best ones, repeated rows, nulls, and names that clash."""
    r = random.Random(7)
    words = lambda n: " ".join(r.choices("some words of a text that goes on".split(), k=n))
    pages = []
    for i in range(150):
        kinds = r.sample("abcdefghijklm", 3)
        body = "".join(f"<div class='{k}'><p>{words(r.randrange(1, 40))}</p><div class='in{k}'><p>{words(9)}</p></div></div>" for k in kinds)
        pages.append((i, f"http://h{i % 3}.example/{i}", f"<body><nav>menu</nav>{body}</body>"))
    pages += [(900 + i, "http://h0.example/x", f"<section class='rare{'xyzw'[i]}'><p>{words(5)}</p></section>") for i in range(4)]
    pages += [(5, *pages[5][1:]), (None, None, None), (990, "odd", ""), (991, "http://h1.example", "<p>" + "long " * 100_000)]
    path = str(tmp_path / "p.parquet")
    rows = [(*x, "a", "b", "c") for x in pages]
    spark.createDataFrame(rows, "page_id long, url string, html string, _row string, host string, paths string").repartition(3).write.parquet(path)
    frame = spark.read.parquet(path)
    got = html_extraction.extract(frame)
    assert got.columns == [*frame.columns, "main_text"]
    rows = got.collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(x.page_id, x.main_text) for x in rows], key=key) == sorted(plain([p for p in pages if p[0] is not None]) + [(None, "")], key=key)
    assert {x._row for x in rows} == {"a"}
    assert html_extraction.extract(frame.filter("page_id < 0")).count() == 0


def test_consensus_overrules_one_page(spark, tmp_path):
    # on one page a long sidebar would win alone; the host's path finds the short article
    odd = "<body><div class='x1'><p>{}</p></div><div class='story'><p>short but real</p></div></body>"
    pages = [(i, f"http://h.example/{i}", odd.format("s").replace("short but real", f"a real story of number {i} " * 9)) for i in range(9)]
    pages += [(99, "http://h.example/99", odd.format("long list of things " * 30)), (100, None, None), (101, "http://other.example", "<p>x")]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(path)
    got = {r.page_id: r.main_text for r in html_extraction.extract(spark.read.parquet(path)).collect()}
    assert got[99] == "short but real" and got[100] == "" and got[101] == "x" and len(got) == 12
