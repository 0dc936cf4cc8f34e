"""Benchmark decontamination with a broadcast hash set of test n-grams.

A window is `n` consecutive words of a benchmark item; an item with fewer words
is one window. Any window of L words contains a gram of g = (L + 1) // 2 words
whose place in the document is a multiple of g. So a document is looked up once
per g words, not once per word: each aligned gram is hashed and probed in the
broadcast set of all grams of all windows, and where it hits, the window's words
are compared with the words around the gram. Everything is a DataFrame or SQL
function; the corpus is scanned, exploded and probed in one stage without a
shuffle, and only hits are grouped by document.

The broadcast is made only if the benchmark's words are within `broadcast_words`
(a gram's entry holds one window, some 300 bytes); beyond it the same join is
left to Spark, which shuffles the grams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, own_names, row_key

N = 13
BROADCAST_WORDS = 100_000
#: Windows in one row of the set, about.
ENTRIES = 64
# all but the ASCII characters that are neither digits nor letters; said as what is
# in it, commonest first, a class is tested in far fewer steps than as what is not
_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_WORD_ANY_CASE = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"
_SPANS = "array<struct<start:int,length:int>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, a-z and all beyond ASCII. The
    fast lower() is the same for texts without other letters."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _between(lo: Column, hi: Column, step: int = 1) -> Column:
    return F.when(hi >= lo, F.sequence(lo, hi, F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """One row per distinct window: window (its words) and items (their ids as
    strings; a null id has none)."""
    words = normal_words(F.col(text_col))
    windows = let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.slice(w, i + 1, F.lit(n)))).when(F.size(w) > 0, F.array(w)))
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.explode(windows).alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def _grams(windows: DataFrame, g: int, n: int) -> DataFrame:
    """The windows by the hash of each of their g-grams, with its place; a gram
    that many windows share has a row for about each ENTRIES of them."""
    size = F.size("window")
    rows = windows.filter((size > 2 * g - 2) & (size <= min(2 * g, n))).select("window", "items", F.explode(_between(F.lit(0), size - g)).alias("at"))
    rows = rows.withColumn("gram", F.xxhash64(F.lit(g), F.slice("window", F.col("at") + 1, F.lit(g))))
    parts = rows.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).alias("parts"))
    part = F.pmod(F.xxhash64("window", "at"), "parts")
    return rows.join(parts, "gram").groupBy("gram", part.alias("part")).agg(F.collect_list(F.struct("at", "window", "items")).alias("entries")).drop("part")


def _aligned(gs: list[int], n: int) -> Column:
    """For each aligned gram of a text, for each g: its place, its hash, the words
    that any window around it can hold, and where those begin."""

    def one(w: Column, p: Column, g: int) -> Column:
        reach = min(2 * g, n) - g
        lo = F.greatest(p - reach, F.lit(0))
        return F.struct(p.alias("p"), F.xxhash64(F.lit(g), F.slice(w, p + 1, F.lit(g))).alias("gram"), lo.alias("lo"), F.slice(w, lo + 1, F.lit(g + 2 * reach)).alias("around"))

    def grams(w: Column, g: int) -> Column:
        return F.transform(_between(F.lit(0), F.size(w) - g, g), lambda p: one(w, p, g))

    return let(normal_words(F.col("text")), lambda w: F.concat(*(grams(w, g) for g in gs)))


def window_hits(docs: DataFrame, windows: DataFrame, n: int, broadcast: bool, lengths: list[int]) -> DataFrame:
    """(k1, k2, hits) of the verified windows in a document around one of its
    grams; hits have start (in words), length and items. A window may come twice.
    The corpus is read once, whatever the lengths."""
    gs = sorted({(x + 1) // 2 for x in lengths})
    probe = docs.select("k1", "k2", F.explode(_aligned(gs, n)).alias("a")).select("k1", "k2", "a.*")
    grams = reduce(DataFrame.unionByName, (_grams(windows, g, n) for g in gs))
    hit = probe.join(F.broadcast(grams) if broadcast else grams, "gram")
    start = lambda e: F.col("p") - e["at"]
    same = lambda e: F.when(start(e) >= F.col("lo"), F.slice("around", start(e) - F.col("lo") + 1, F.size(e["window"])) == e["window"]).otherwise(False)
    found = F.transform(F.filter("entries", same), lambda e: F.struct(start(e).alias("start"), F.size(e["window"]).alias("length"), e["items"].alias("items")))
    return hit.select("k1", "k2", found.alias("hits")).filter(F.size("hits") > 0)


def _covered(hits: Column) -> Column:
    """Words under the union of the windows."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["length"]
        return F.struct(F.greatest(acc["reach"], end).alias("reach"), (acc["n"] + F.greatest(end - F.greatest(acc["reach"], h["start"]), F.lit(0))).alias("n"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


@own_names("n_words", "n_hit", "items", "spans", "contaminated")
def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Adds to the columns of docs: n_words, n_hit (words inside any
    window occurrence), items (sorted ids, as strings, of items with occurring
    windows), spans (start and length in words of the occurrences, sorted) and
    contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts, and items without words, have no words and no windows.
    Items with one id count once; an item whose id is null marks words but is
    not listed. Rows that repeat id and text each get the same result. Columns
    of docs that have the names of the added ones are replaced. With an empty benchmark nothing is
    hit; an empty docs table gives an empty result.
    """
    windows = benchmark_windows(benchmark, n, item_col, item_text_col)
    stats = benchmark.select(F.size(normal_words(F.col(item_text_col))).alias("n")).filter("n > 0").agg(F.sum("n"), F.collect_set(F.least("n", F.lit(n)))).first()
    k1, k2 = row_key(docs, id_col, text_col)
    keyed = docs.select(F.col(text_col).alias("text"), k1, k2)
    added = {"n_words": F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD_ANY_CASE)), F.lit(0)).cast("long"), "__k1": k1, "__k2": k2}
    out = docs.drop("n_words", "n_hit", "items", "spans", "contaminated").withColumns(added)
    if stats[0]:
        hits = window_hits(keyed, windows, n, stats[0] <= broadcast_words, stats[1])
        per = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        spans = F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"))))
        items = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))
        per = per.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.array_sort(spans).alias("spans"), F.array_sort(items).alias("items"))
        out = out.join(per, ["__k1", "__k2"], "left")
    else:
        out = out.withColumns({"spans": F.lit(None).cast(_SPANS), "items": F.lit(None).cast("array<string>")})
    out = out.withColumns({"spans": F.coalesce("spans", F.array().cast(_SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    out = out.withColumn("n_hit", _covered(F.col("spans"))).drop("__k1", "__k2")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_spans(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """From `contamination`: the texts without the words that were hit and what
    separates them from the next word; all other characters stay."""
    piece = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))

    def cut(pieces: Column) -> Column:
        first = F.when(pieces[0].rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
        gone = lambda w: F.transform(w, lambda i: 2 * i + first)
        drop = F.array_union(gone(hit), F.transform(gone(hit), lambda i: i + 1))
        keep = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), drop)
        return F.array_join(F.transform(keep, lambda i: F.get(pieces, i)), "")

    text = F.when(F.size("spans") > 0, let(F.regexp_extract_all(F.col(text_col), F.lit(piece), F.lit(0)), cut)).otherwise(F.col(text_col))
    return found.select(id_col, text.alias(text_col), F.col("n_hit").alias("n_removed"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bn AS (SELECT item_id, w, least(13, len(w)) AS l FROM bw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS g FROM bn, range(1, 100000) r(i) WHERE i + l - 1 <= len(w)
), ls AS (SELECT DISTINCT l FROM win),
dg AS (
  SELECT doc_id, l, s, array_to_string(w[s : s + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dw, ls WHERE len(w) >= l)
), hit AS (SELECT doc_id, dg.l, s, item_id FROM dg JOIN win ON dg.l = win.l AND dg.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
