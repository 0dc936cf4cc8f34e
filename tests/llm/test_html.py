import random
import re
from html import unescape

from loreforge.llm.html_main import blocks, main_text, op5_html_extraction, regions


def text(page):
    return regions(page)[0]


def test_article():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a}</style><script>var t="</p>"; a<b</script></head><body>
<header>top</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad 0 --><div class="ad">buy</div>
<article class="post header-image"><h1>Title &amp;amp; &eacute;&#233;&nbsp;!</h1><p><b>Bold<br><p>one  two
three</p><div class="related-posts"><p>other</p></div><p>a<i>b</i>c &lt;d&gt;<form><input value="q">name<button>go</button></form>
<aside>side</aside><table><tr><td>x<td>y</table><ul><li>l1<li>l2</ul><pre>p  q</pre><section id="comments"><p>reader says</p></section><p>last<p>  </p></article>
<div id="cookie-notice">cookies</div><footer>&copy; foot</footer></body></html>"""
    assert text(page) == "Title &amp; éé ! Bold one two three abc <d> x y l1 l2 p q last"


def test_broken():
    assert blocks(None) == blocks("") == ([], set())
    assert text("<article>a<p>b") == "a b"
    assert text("<article><p>a</div></p></span>b</article>c") == "a b"
    assert text("<article><nav>x<p>y</nav>z</article>") == "z"
    assert text("<main>m <script>no</script>n</main>") == "m n"
    assert text("<article>1 < 2 &amp 3 &bogus; &#x41;</article>") == "1 < 2 & 3 &bogus; A"
    assert text("<article><b>x<p>y</b>z</p></article>") == "x yz"


def test_marks_on_articles():
    assert text('<article>x</article><article class="comment">reader</article>') == "x"
    assert text('<article>x<article class="comment-body">reader</article>y</article>') == "x y"
    assert text('<article class="post header-image">x</article>') == "x"
    assert text("<div class='related'><article>x</article></div><article>own</article>") == "own"
    # inside what is left out: no article for sure
    assert regions("<form><article>x y</article></form>") == (None, None, [(1, "x y")])
    assert regions('<div class="page-header side">top<article>x y</article></div>') == (None, None, [(1, "x y")])
    assert regions('<div id="comments"><article>x y</article></div>') == (None, None, [])
    assert regions("a<nav>menu</nav><article>x</article><article>y</article>") == (None, None, [(0, "a"), (1, "x"), (2, "y")])


def brute_runs(pages, long_run=12, short_run=4, share=0.3):
    """(host, page): tokens of its only stream -> what no repeated run covers."""
    out = {}
    for (host, page), tokens in pages.items():
        others = [t for (h, p), t in pages.items() if h == host and p != page]
        gone = set()
        for n, least in ((long_run, 1), (short_run, max(1, share * (len(others) + 1) - 1))):
            for i in range(len(tokens) - n + 1):
                w = tokens[i : i + n]
                if sum(any(t[j : j + n] == w for j in range(len(t) - n + 1)) for t in others) >= least:
                    gone.update(range(i, i + n))
        out[host, page] = " ".join(x for i, x in enumerate(tokens) if i not in gone)
    return out


def test_hosts_against_a_plain_search(spark):
    rng = random.Random(7)
    pages = {}
    for host in ("a", "b", "c"):
        menu = [f"m{host}{i}" for i in range(rng.randint(4, 8))]
        quote = [f"q{host}{i}" for i in range(rng.randint(8, 16))]
        for p in range(rng.randint(3, 9)):
            body = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 60))]
            pages[host, p] = menu + body + (quote if p % 2 else []) + (menu if p % 3 == 0 else [])
    rows = [(f"{h}-{p}", f"http://{h}.example/{p}", "".join(f"<p>{x}</p>" for x in t)) for (h, p), t in pages.items()]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(5)).collect()}
    assert got == {f"{h}-{p}": x for (h, p), x in brute_runs(pages).items()}


def test_articles_that_the_host_decides(spark):
    own = " ".join(f"own{i}" for i in range(40))
    teaser = "read more about this and other news of today on our site every day"
    rows = [
        (1, "http://a.example/1", f"<div>{own}</div><article>{teaser}</article><article>short one</article>"),
        (2, "http://a.example/2", f"<article>{teaser}</article><article>second text that is the page's own</article>"),
        (3, "http://a.example/3", "<form>name<article>in a form</article></form>"),
        (4, "http://a.example/4", f"<nav>{teaser}</nav><article>{own}</article>"),
    ]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: own, 2: "second text that is the page's own", 3: "in a form", 4: own}


def test_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    got = main_text(spark.createDataFrame([(1, "http://a.example", f"<article>{words}</article>"), (2, "http://b.example", f"<p>{words}</p>")], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [words, words]


def test_pages_without_article(spark):
    shared = "<div>Home About us Contact and imprint</div>"
    rows = [
        (1, "http://a.example/1", shared + "<div>first page own words here</div><div>All rights reserved by someone</div>"),
        (2, "http://A.example/2", shared + "<div>second page has others</div><div>All rights reserved by someone</div>"),
        (3, "http://b.example/1", shared + "<div>lonely</div>"),
        (4, "http://a.example/3", None),
        (5, None, "<article>x</article>"),
        (6, "http://a.example/4", "<article>Home About us Contact and imprint</article>"),
        (7, "http://c.example/", "<p>same row twice is one page</p>"),
        (7, "http://c.example/", "<p>same row twice is one page</p>"),
        (None, "http://d.example/", "<p>no id at all</p>"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, tokens int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in main_text(df).collect())
    want = {"1": "first page own words here", "2": "second page has others", "3": "Home About us Contact and imprint lonely", "4": "", "5": "x", "6": "Home About us Contact and imprint", "7": "same row twice is one page", "None": "no id at all"}
    assert got == sorted([(k, v, len(v)) for k, v in want.items()] + [("7", want["7"], len(want["7"]))])
    assert main_text(df.limit(0)).count() == 0


def plain(page):
    """For the test tables' plain pages only: the one article, its tags cut out."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"[\s]+", " ", unescape(x)).strip() for x in re.sub(r"</?(?:p|h1|br)>", "\x01", re.sub(r"</?b>", "", body)).split("\x01")]
    return " ".join(x for x in parts if x)


def test_query(spark, small):
    want = {(r.page_id, r.url, plain(r.html)) for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {(r.page_id, r.url, r.text) for r in op5_html_extraction(spark, small).collect()} == want


def test_parts_of_an_article_go_only_for_what_they_are():
    from loreforge.llm.html_main import blocks

    kept = ["social-history", "comments-and-notes-on-law", "header-files-in-c", "menu_of_the_day", "search-algorithms related-work"]
    gone = ["share-buttons", "comment-list", "ad", "sidebar", "related-posts wide", "social_links", "comments", "ad-slot-3"]
    page = "<article><p>own</p>" + "".join(f'<div class="{c}">text of {c}</div>' for c in kept + gone) + '<section id="comments-and-notes-on-law">law</section></article>'
    got = [t for region, t in blocks(page)[0] if region > 0]
    assert got == ["own", *(f"text of {c}" for c in kept), "law"]


def test_one_article_that_is_a_teaser(spark):
    own = {p: " ".join(f"own{p}x{i}" for i in range(40)) for p in range(4)}
    teaser = "<h2>News of today</h2><p>read more about this and other news of today on our site every day</p>"
    copy = " ".join(f"copy{i}" for i in range(30))
    rows = [(p, f"http://a.example/{p}", f"<div>{own[p]}</div><article>{teaser}</article>") for p in range(4)]
    rows += [
        (4, "http://b.example/", rows[0][2]),  # nothing repeats on this host
        (5, "http://c.example/1", f"<article><p>{copy}</p></article><div>{own[0]}</div>"),  # copies, but not short against what stands around them
        (6, "http://c.example/2", f"<article><p>{copy}</p></article><div>{own[1]}</div>"),
        (7, "http://d.example/", rows[0][2]),  # one page twice
        (7, "http://d.example/", rows[0][2]),
    ]
    got = sorted((r.page_id, r.text) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    short = "News of today read more about this and other news of today on our site every day"
    assert got == sorted([*own.items(), (4, short), (5, copy), (6, copy), (7, short), (7, short)])


def brute_judged(pages, long_run=12, short_run=4, share=0.3):
    """(host, page): tokens and unique tokens of the article, unique tokens outside,
    of (region, text) blocks, by comparing all pages of a host with each other."""

    def prefix(found, i, n):
        for j in range(i + 1, len(found) + 1):
            if sum(len(t.split(" ")) for _, t in found[i:j]) >= n:
                return tuple(t for _, t in found[i:j])

    out = {}
    for (host, page), found in pages.items():
        others = [f for (h, p), f in pages.items() if h == host and p != page]
        gone = set()
        for n, least in ((long_run, 1), (short_run, max(1, share * (len(others) + 1) - 1))):
            for i in range(len(found)):
                w = prefix(found, i, n)
                if w and sum(any(prefix(f, j, n) == w for j in range(len(f))) for f in others) >= least:
                    gone.update(range(i, i + len(w)))
        sums = [sum(len(t.split(" ")) for i, (r, t) in enumerate(found) if r == region and (i not in gone or all_)) for region, all_ in ((1, True), (1, False), (0, False))]
        out[host, page] = tuple(sums)
    return out


def test_every_page_is_judged_by_the_array(spark, monkeypatch):
    from loreforge.llm import html_main

    rng, pages = random.Random(11), {}
    for host, n in (("a", 2), ("b", 5), ("c", 14)):
        stock = [" ".join(f"w{rng.randint(0, 5)}" for _ in range(rng.randint(1, 15))) for _ in range(14)]
        for p in range(n):
            parts = lambda: "".join(f"<p>{rng.choice(stock) if rng.random() < 0.6 else f'u{p} ' * rng.randint(1, 6) + str(rng.random())}</p>" for _ in range(rng.randint(1, 6)))  # noqa: B023, E731
            pages[host, p] = f"<nav><p>{stock[0]}</p><p>{stock[1]}</p></nav>{parts()}<article>{parts()}</article>{parts()}"
    rows = [(f"{h}-{p}", f"http://{h}.example/{p}", x) for (h, p), x in pages.items()]
    seen, judge = {}, html_main.judged_articles

    def judged(streams, share):
        out = judge(streams, share)
        seen.update({r.id: (r.tokens, r.unique, r.outside) for r in streams.join(out, "row").collect()})
        return out

    monkeypatch.setattr(html_main, "judged_articles", judged)
    main_text(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(4))
    assert seen == {f"{h}-{p}": x for (h, p), x in brute_judged({k: blocks(x)[0] for k, x in pages.items()}).items()}
    assert any(a[1] < a[0] for a in seen.values()) and any(a[2] for a in seen.values())
