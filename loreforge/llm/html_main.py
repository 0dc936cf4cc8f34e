"""Main text of HTML pages, with a suffix array per host for boilerplate.

The pages of a host are streams in one suffix array: what repeats there, across
distinct pages, in a long run is boilerplate, and so is a short run that stands
on a good share of the host's pages; the runs left are unique to a page.

The array is made twice. First every block of every page is one symbol, and the
array says how much of what a page marks as its article, and of what it shows
outside, is unique. Where one article is marked and stands this test, it is the
page's text: navigation, headers, footers, asides, forms, adverts, notices,
reader comments, scripts and styles are taken out of it, and nothing else, for
an article may quote another or be a copy of it and is text all the same. It
fails where most of it repeats and the unique text outside is over twice as long
as all of it: then it is a teaser.

On the pages left (no article, several, or one that failed) tokens are the
symbols. This array is made for the hosts that have such a page, and holds these
pages and what stands around the articles of the others: of the text outside
articles, the unique runs are kept; of several articles those stay that are not
short against the one with most unique tokens, unless the unique text outside is
over twice as long, when the articles are teasers.

The suffix array is dealt out: two suffixes of a host that share the first n
tokens stand next to each other in it, among those of one prefix. So suffixes
are grouped by host and the hash of their first n tokens (of as many blocks as
hold n tokens), which sorts them to that depth, and the union of such prefixes
is what longer repeats cover. Only counts of distinct pages leave a group, so no
host is gathered anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Tokens of a run that is boilerplate if another page of the host has it, and of
#: one that is if at least SHARE of the host's pages (and two) have it.
LONG_RUN, SHORT_RUN, SHARE = 12, 4, 0.3
#: Pages that are parsed before their texts are handed on.
PAGES = 256

#: Elements whose text is never shown or never the page's own.
_SILENT = {"script", "style", "template", "noscript", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset", "label", "input"}
_MAIN = {"article", "main"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another one of theirs closes, as browsers do.
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark what is not the page's own text.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|popup|modal|overlay|"
    r"nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|side|footer|header|masthead|toolbar|share|sharing|social|related|recommend(?:ed|ations?)?|widgets?|"
    r"comments?|disqus|replies|respond|pagination|pager|skip|search|login|copyright|complementary|contentinfo|alert|dialog)(?:$|[\s_-])",
    re.I,
)
#: The same for reader comments.
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])", re.I)
#: Words that a class adds to such a word for a box of it, as in share-buttons.
_BOX = set(
    "area bar block body bottom box btn button buttons card cell col column container content count entry footer form group head header holder icon icons inner item items label left link links list main meta outer panel post posts right row section slot stories text thread title top unit wrap wrapper zone".split()
)
#: Whole classes of an article element that is not the page's own.
_NOT_OWN = {"ad", "advert", "sponsored", "promo", "related", "teaser"}
_WHITE = re.compile(r"[\s\x00]+")
#: Why text is left out: KEPT, SIDE (an article inside may still be the page's own), NEVER.
_KEPT, _SIDE, _NEVER = 0, 1, 2


def _is_box(value: str, words: re.Pattern) -> bool:
    """Whether a class names nothing but a box of what `words` match: share,
    comment-list, but not social-history or comments-on-law."""
    for name in value.split():
        parts = [x for x in re.split(r"[-_]+", name.lower()) if x and not x.isdigit()]
        marked = [bool(words.search(x)) for x in parts]
        if any(marked) and all(m or x in _BOX for m, x in zip(marked, parts, strict=True)):
            return True
    return False


class _Blocks(HTMLParser):
    """Collects (region, text) of each block: the number of the outermost article
    it is in, 0 outside articles, -1 where it is left out but shown. side has the
    articles that stand in what is left out. Unclosed elements end with their
    parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, left out, article, silent
        self.dropped, self.main, self.silent = _KEPT, 0, False
        self.n, self.side = 0, set()
        self.out: list[tuple[int, str]] = []
        self.buf: list[str] = []

    def flush(self) -> None:
        if self.buf:
            text = _WHITE.sub(" ", "".join(self.buf)).strip()
            self.buf = []
            if text:
                self.out.append((-1 if self.dropped else self.main, text))

    def _pop(self, n: int) -> None:
        del self.stack[n:]
        self.dropped, self.main, self.silent = self.stack[-1][1:] if self.stack else (_KEPT, 0, False)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.flush()
        closes = _IMPLIED.get(tag)
        if tag in _BLOCK and tag not in ("br",) and closes is None:
            closes = {"p"}
        if closes:
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name in closes:
                    self.flush()
                    self._pop(i)
                    break
                if name in _BLOCK or name in ("table", "ul", "ol"):
                    break
        if tag in _VOID:
            return
        drop = _NEVER if tag in _SILENT or tag in _ASIDE - {"form", "fieldset"} else _SIDE if tag in _ASIDE else _KEPT
        silent, main = tag in _SILENT, tag in _MAIN
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                drop, silent = _NEVER, True
            elif v and k in ("class", "id", "role") and tag not in ("html", "body"):
                if k == "role" and v.strip().lower() in ("main", "article"):
                    main = True
                elif main and not self.main:
                    # an article's own classes often name its parts, so only whole ones count
                    if _is_box(v, _READERS) or _NOT_OWN & set(v.lower().split()):
                        drop = _NEVER
                elif self.main:
                    # what an article is about may be in the classes of its parts
                    drop = _NEVER if _is_box(v, _READERS) else max(drop, _SIDE) if _is_box(v, _MARKED) else drop
                elif _READERS.search(v):
                    drop = _NEVER
                elif _MARKED.search(v):
                    drop = max(drop, _SIDE)
        was = self.dropped, self.main, self.silent
        if main and not self.main and drop != _NEVER and self.dropped != _NEVER:
            self.n += 1
            if self.dropped == _SIDE:
                self.side.add(self.n)
            now = _KEPT, self.n, self.silent
        else:
            now = max(self.dropped, drop), self.main, self.silent or silent
        self.stack.append((tag, *now))
        if was != now:
            self.flush()
        self.dropped, self.main, self.silent = now

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                left = self.stack[i - 1][1:] if i else (_KEPT, 0, False)
                if left != (self.dropped, self.main, self.silent):
                    self.flush()
                self._pop(i)
                return
            # the end of an inline element does not close what holds it
            if tag not in _BLOCK and self.stack[i][0] in _BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buf.append(data)


def blocks(page: str | None) -> tuple[list[tuple[int, str]], set[int]]:
    """The text blocks of a page in order with their regions, and the regions of
    articles inside what tags and marks leave out."""
    if not page:
        return [], set()
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.out, parser.side


def regions(page: str | None) -> tuple[str | None, str | None, list[tuple[int, str]]]:
    """A page's article and all other text around it, if it marks one article;
    else None twice, and its regions (0 outside articles) with their texts. What
    is left out is no region of its own."""
    found, side = blocks(page)
    own = _articles(found, side)
    if len(own) == 1 and own[0] not in side:
        return " ".join(t for r, t in found if r == own[0]), " ".join(t for r, t in found if r != own[0]), []
    return None, None, _texts(found, own)


def _articles(found: list[tuple[int, str]], side: set[int]) -> list[int]:
    """The regions of the page's own articles; of those inside what is left out
    only where there are no others."""
    return sorted({r for r, _ in found if r > 0} - side) or sorted(side)


def _texts(found: list[tuple[int, str]], own: list[int]) -> list[tuple[int, str]]:
    """The regions, 0 and those of `own`, that have text."""
    return [(r, " ".join(t for q, t in found if q == r)) for r in [0, *own] if any(q == r for q, _ in found)]


def _reach(sizes: np.ndarray, n: int) -> np.ndarray:
    """Per block the number of blocks, from it on, that hold n tokens; 0 where the
    page ends before."""
    ends = np.cumsum(sizes)
    to = np.searchsorted(ends, ends - sizes + n)
    return np.where(to < len(sizes), to - np.arange(len(sizes)) + 1, 0)


#: What the array of blocks needs of a page: its one article (else null), and of
#: each block the region, the number of tokens, a hash, and how many blocks its
#: long and its short prefix have. Pages that do not mark one article also bring
#: the texts of their regions.
_STREAM = "article int, region array<int>, size array<int>, symbol array<bigint>, long array<int>, short array<int>, regions array<struct<region:int,text:string>>"
_REGIONS = pa.list_(pa.struct([("region", pa.int32()), ("text", pa.string())]))


def _stream(long_run: int, short_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            html = batch.column("html")
            rest = batch.select([c for c in batch.schema.names if c != "html"])
            for lo in range(0, batch.num_rows, PAGES):
                rows = []
                for x in html.slice(lo, PAGES):
                    found, side = blocks(x.as_py())
                    own = _articles(found, side)
                    one = len(own) == 1 and own[0] not in side
                    size = np.array([t.count(" ") + 1 for _, t in found], np.int64)
                    symbol = np.frombuffer(b"".join(blake2b(t.encode(), digest_size=8).digest() for _, t in found), "<i8")
                    long, short = _reach(size, long_run), _reach(size, short_run)
                    # what repeats on a share of the pages does so on two, so of equal prefixes one is enough
                    short[short == long] = 0
                    rows.append((own[0] if one else None, np.array([r for r, _ in found], np.int64), size, symbol, long, short, None if one else [{"region": r, "text": t} for r, t in _texts(found, own)]))
                cols = list(zip(*rows, strict=True))
                new = [pa.array(cols[0], pa.int32()), pa.array(cols[1], ints), pa.array(cols[2], ints), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], ints), pa.array(cols[5], ints), pa.array(cols[6], _REGIONS)]
                yield pa.RecordBatch.from_arrays([*rest.slice(lo, PAGES).columns, *new], [*rest.schema.names, "article", "region", "size", "symbol", "long", "short", "regions"])

    return run


def _parse(what: str):
    """Adds to rows with html: main, the text of the one article, or around, the
    text around it, and leaves out the pages that do not mark one; or regions, the
    regions of any page with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            rest = batch.select([c for c in batch.schema.names if c != "html"])
            for lo in range(0, batch.num_rows, PAGES):
                if what == "regions":
                    parsed = [blocks(x.as_py()) for x in html.slice(lo, PAGES)]
                    new = pa.array([[{"region": r, "text": t} for r, t in _texts(found, _articles(found, side))] for found, side in parsed], _REGIONS)
                    keep = list(range(len(parsed)))
                else:
                    found = [regions(x.as_py()) for x in html.slice(lo, PAGES)]
                    keep = [i for i, f in enumerate(found) if f[0] is not None]
                    new = pa.array([found[i][what == "around"] for i in keep], pa.string())
                some = rest.slice(lo, PAGES).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, new], [*some.schema.names, what])

    return run


def _prefixes(tokens, n: int):
    """Per suffix of at least n tokens: its place and two hashes of the host and its first n."""
    first = lambda i: F.slice(tokens, i + 1, F.lit(n))
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64("host", first(i)).alias("p1"), F.hash("host", first(i)).alias("p2")))


def _standing(suffixes: DataFrame, streams: DataFrame, share: float) -> DataFrame:
    """The suffixes (host, page, p1, p2 and more) whose prefix stands on two
    distinct pages of the host and on at least `share` of its pages."""
    # both hashes have the host in them
    again = suffixes.groupBy(*["host"] * (share > 0), "p1", "p2").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.count_distinct("page").alias("n_pages") if share else F.lit(0).alias("n_pages")).filter("lo <> hi")
    if share:
        again = again.join(streams.groupBy("host").agg(F.count_distinct("page").alias("all_pages")), "host").filter(F.col("n_pages") >= share * F.col("all_pages"))
    # read from a table, so that Spark can split the suffixes of a large host in the join
    again = written(again.select("p1", "p2"), "op5-repeated")
    return suffixes.drop("host", "page").join(again, ["p1", "p2"])


def repeated(streams: DataFrame, n: int, share: float = 0.0) -> DataFrame:
    """row, region and at of the suffixes of a page (host, row, page, region,
    tokens) whose first n tokens stand on two distinct pages of the host and on
    at least `share` of its pages."""
    suffixes = streams.select("host", "row", "page", "region", F.explode(_prefixes(F.col("tokens"), n)).alias("s")).select("host", "row", "page", "region", "s.*")
    return _standing(suffixes, streams, share).select("row", "region", "at")


def judged_articles(streams: DataFrame, share: float = SHARE) -> DataFrame:
    """Per row with an article, of pages as streams of blocks (host, row, page and
    the columns of _STREAM): tokens and unique, of the article, and outside, the
    unique tokens of region 0. Unique are the blocks that no repeated run covers:
    a long one that another page of the host has, or a short one that a `share` of
    its pages has."""

    def suffixes(reach: str) -> DataFrame:
        part = lambda i: F.slice("symbol", i + 1, F.get(reach, i))
        starts = F.filter(F.transform(reach, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull())
        each = F.transform(starts, lambda i: F.struct(i.alias("from"), F.get(reach, i).alias("n"), F.xxhash64("host", part(i)).alias("p1"), F.hash("host", part(i)).alias("p2")))
        return streams.select("host", "row", "page", F.explode(each).alias("s")).select("host", "row", "page", "s.*")

    spans = _standing(suffixes("long"), streams, 0.0).unionByName(_standing(suffixes("short"), streams, share))
    gone = spans.groupBy("row").agg(F.collect_set(F.struct("from", "n")).alias("s")).select("row", F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["from"], x["from"] + x["n"] - 1)))).alias("gone"))
    places = F.when(F.size("region") > 0, F.sequence(F.lit(0), F.size("region") - 1)).otherwise(F.array().cast("array<int>"))
    left = F.when(F.col("gone").isNull(), places).otherwise(F.array_except(places, F.col("gone")))
    total = lambda where, which: F.aggregate(where, F.lit(0).cast("long"), lambda x, i: x + F.when(F.get("region", i) == which, F.get("size", i)).otherwise(0))
    rows = streams.filter("article is not null").select("row", "article", "region", "size").join(gone, "row", "left").withColumn("places", places).withColumn("left", left)
    return rows.select("row", total("places", F.col("article")).alias("tokens"), total("left", F.col("article")).alias("unique"), total("left", F.lit(0)).alias("outside"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", long_run: int = LONG_RUN, short_run: int = SHORT_RUN, share: float = SHARE) -> DataFrame:
    """Per page: the id, the url, text and n_chars. Text is the blocks of the
    page's article (or main) joined by spaces. Where a page marks none or several,
    or one that the array of blocks finds a teaser, runs of `long_run` tokens that
    another page of the host has, and of `short_run` that a `share` of the host's
    pages has, are boilerplate, and the text is made of what they leave.

    Character references are decoded; white space in a block becomes one space.
    A null or empty html has the empty text. A null url is a host of its own for
    all such pages. Rows that repeat the same id are one page: they do not make
    each other boilerplate. Other columns are ignored. An empty table gives an
    empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    kind = dict(pages.select(id_col).dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    whole = ["id", "url", "html", F.col("id").isNull(), F.col("url").isNull()]
    rows = rows.withColumns({"k1": F.xxhash64(*whole), "k2": F.hash(*whole)})  # rows that are equal in all are judged alike
    own = f"id {kind}, url string, host string, k1 bigint, k2 int"

    # every page as a stream of blocks; the array says which of the pages' only articles are teasers
    streams = rows.mapInArrow(_stream(long_run, short_run), f"{own}, {_STREAM}").withColumn("row", F.monotonically_increasing_id())
    streams = written(streams.withColumn("page", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")))), "op5-blocks")
    teasers = judged_articles(streams, share).filter("2 * unique < tokens and outside > 2 * tokens")
    teasers = written(streams.join(teasers.select("row"), "row").select("k1", "k2").distinct(), "op5-teasers")

    # the other pages with one article are done; those left are written with the texts of their regions
    done = rows.mapInArrow(_parse("main"), f"{own}, main string").join(teasers, ["k1", "k2"], "left_anti").select("id", "url", F.col("main").alias("text"))
    failed = rows.join(teasers, ["k1", "k2"], "left_semi").select("id", "url", "host", "k1", "k2", "html").mapInArrow(_parse("regions"), f"{own}, regions array<struct<region:int,text:string>>")
    some = ["id", "url", "host", "regions"]
    open_pages = streams.filter("article is null").select(*some, F.lit(False).alias("lone")).unionByName(failed.select(*some, F.lit(True).alias("lone")))
    open_pages = written(open_pages.withColumn("row", F.monotonically_increasing_id()), "op5-open")

    # the streams of their hosts: these pages, and what stands around the articles of the others
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    page = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("page")
    open_ = open_pages.select("host", "row", page, "lone", F.explode("regions").alias("r")).select("host", "row", "page", "lone", "r.region", "r.text", split(F.col("r.text")).alias("tokens"))
    others = rows.join(open_pages.select("host").distinct(), "host", "left_semi").select("id", "url", "host", "k1", "k2", "html").mapInArrow(_parse("around"), f"{own}, around string")
    around = others.select("host", F.lit(-1).cast("long").alias("row"), page, F.lit(-1).alias("region"), split(F.col("around")).alias("tokens"))
    streams = written(open_.drop("text", "lone").unionByName(around), "op5-streams")
    spans = repeated(streams, long_run).withColumn("n", F.lit(long_run)).unionByName(repeated(streams, short_run, share).withColumn("n", F.lit(short_run)))
    cover = spans.filter("region >= 0").groupBy("row", "region", "n").agg(F.collect_set("at").alias("ats"))
    cover = cover.withColumn("gone", F.flatten(F.transform("ats", lambda i: F.sequence(i, i + F.col("n") - 1)))).groupBy("row", "region").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1)).otherwise(F.array().cast("array<int>"))
    left = F.when(F.col("gone").isNull(), places).otherwise(F.array_except(places, F.col("gone")))
    judged = open_.join(cover, ["row", "region"], "left").withColumn("left", left).withColumn("unique", F.size("left"))
    runs = F.when(F.col("gone").isNull(), F.array_join("tokens", " ")).otherwise(F.array_join(F.transform("left", lambda i: F.get("tokens", i)), " "))
    shown = judged.groupBy("row").agg(
        F.coalesce(F.max(F.when(F.col("region") == 0, F.col("unique"))), F.lit(0)).alias("outside"),
        # one that is marked alone may be a copy, so all of it counts
        F.coalesce(F.max(F.when(F.col("region") > 0, F.when(F.col("lone"), F.size("tokens")).otherwise(F.col("unique")))), F.lit(0)).alias("best"),
        F.first("lone").alias("lone"),
        F.max(F.when(F.col("region") == 0, runs)).alias("runs"),
        F.array_sort(F.collect_list(F.when(F.col("region") > 0, F.struct("region", "text", "unique")))).alias("articles"),
    )
    own = F.filter("articles", lambda a: F.col("lone") | (4 * a["unique"] >= F.col("best")))
    text = F.when((F.size("articles") == 0) | (F.col("outside") > 2 * F.col("best")), F.col("runs")).otherwise(F.array_join(F.transform(own, lambda a: a["text"]), " "))
    rest = open_pages.select("id", "url", "row").join(shown.select("row", text.alias("text")), "row", "left").select("id", "url", F.coalesce("text", F.lit("")).alias("text"))
    return done.unionByName(rest).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
