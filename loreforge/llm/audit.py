"""Filter interaction audit: what each of several filters removes, alone and in
every order.

The texts are looked at once, as the bytes that Arrow holds them in: a table of
byte classes and prefix sums count words, capitals, symbols and code points of
all texts of a chunk at a time, and the sorted hashes of a text's words, each
compared byte by byte with the one before it where they are equal, count its
distinct words. What is left of a text is a few counts and a digest, so that no
text is shuffled.

Which filters a document fails is a short string of letters. Documents with the
same letters behave alike in every order, so the orders are worked out on the
counts per part and letters, at most 32 rows for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import written

_U = np.uint64
#: Fixed by the contract: the characters of filter D.
SYMBOLS = b"#$%&*|"
LETTERS = "ABCDE"
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")

_SYMBOL, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CAPITAL[65:91] = True


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of `size` bytes from a and from b are equal."""
    out, i = np.ones(len(a), bool), 0
    ends = np.cumsum(size)
    while i < len(a):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + W.CHUNK_BYTES, side="right")))
        lead = ends[i:j] - size[i:j] - done
        at = np.arange(int(ends[j - 1]) - done) - np.repeat(lead, size[i:j])
        differ = buf[np.repeat(a[i:j], size[i:j]) + at] != buf[np.repeat(b[i:j], size[i:j]) + at]
        out[i:j] = np.add.reduceat(differ, lead) == 0 if len(differ) else True
        i = j
    return out


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Distinct words of each text. The words of a text are sorted by hash; a word
    counts unless it has the hash and the bytes of the one before it. Where bytes
    differ under one hash, that text's words are counted as bytes instead."""
    n = np.diff(at)
    if not len(h):
        return np.zeros(len(n), np.int64)
    filled = np.flatnonzero(n)
    bits = max(1, int(len(filled) - 1).bit_length())
    key = (np.repeat(np.arange(len(filled), dtype=np.uint64), n[filled]) << _U(64 - bits)) | (h >> _U(bits))
    order = np.argsort(key)
    key, size = key[order], (ends - starts)[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[twin], order[twin + 1]
    equal = size[twin] == size[twin + 1]
    equal[equal] = _same(buf, starts[a[equal]], starts[b[equal]], size[twin[equal]])
    again = np.zeros(len(key), bool)
    again[twin + 1] = equal
    total = np.zeros(len(key) + 1, np.int64)
    np.cumsum(again, out=total[1:])
    out = n - np.diff(total[at])
    for row in np.unique(np.searchsorted(at, a[~equal], side="right") - 1):
        out[row] = len({buf[s:e].tobytes() for s, e in zip(starts[at[row] : at[row + 1]], ends[at[row] : at[row + 1]], strict=True)})
    return out


def scan(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of a run of texts, given as bytes and offsets."""
    starts, ends, at = W.spans(buf, offs)

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int32)  # a text has under 2 GB
        np.cumsum(flags, dtype=np.int32, out=total[1:])
        return np.diff(total[offs]).astype(np.int64)

    return {
        "n_words": np.diff(at),
        "n_distinct": distinct_words(buf, starts, ends, at, W.hashes(buf, starts, ends)),
        "n_capitals": within(_CAPITAL[buf]),
        "n_symbols": within(_SYMBOL[buf]),
        "n_chars": within((buf & 0xC0) != 0x80),
    }


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "text"]
        for lo, hi, buf, offs in W.chunks(W.texts_of(batch)):
            found = scan(buf, offs)
            columns = [batch.column(batch.schema.get_field_index(n)).slice(lo, hi - lo) for n in rest]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], [*rest, *COUNTS])


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> DataFrame:
    """One row per row of docs: id, part (null: empty string), digest (SHA-256 of
    the text), COUNTS and fails, the letters among ABCD of the filters that the
    text fails: A under min_words words, B fewer than distinct_percent distinct
    words in 100, C over capital_percent letters A-Z in 100 code points, D any
    of SYMBOLS. A null text is an empty one: it fails A alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "text")
    counted = given.mapInArrow(_scanned, f"{kinds}, {', '.join(f'{c} long' for c in COUNTS)}")
    rules = {
        "A": F.col("n_words") < min_words,
        "B": 100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > capital_percent * F.col("n_chars"),
        "D": F.col("n_symbols") > 0,
    }
    return counted.withColumn("fails", F.concat(*(F.when(bad, letter).otherwise("") for letter, bad in rules.items())))


def _label_flags(labels: DataFrame, id_col: str) -> DataFrame:
    hit = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(F.coalesce(x, F.lit(False))).alias(f"is_{n}") for n, x in hit.items()))


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits: int) -> DataFrame:
    """part, fails (letters among ABCDE), n, good and toxic: how many documents
    of a part fail exactly those filters. E is failed by a row whose text some
    lesser id of the table has.

    Rows are joined with their labels by id and summed up per text before texts
    are compared, so a text with millions of copies is a few rows by then.
    """
    scanned = written(text_failures(docs, id_col, text_col, part_col, **limits).select("id", "part", "digest", "fails"), "op13-scanned")
    # null ids have no labels; joined apart, they do not meet in one task
    named = scanned.filter("id is not null").join(_label_flags(labels, id_col), "id", "left")
    nameless = scanned.filter("id is null").withColumns({"is_good": F.lit(None).cast("boolean"), "is_toxic": F.lit(None).cast("boolean")})
    like = ["digest", "part", "fails", "is_good", "is_toxic"]
    per_id = named.groupBy("id", *like).agg(F.count(F.lit(1)).alias("n")).unionByName(nameless.groupBy("id", *like).agg(F.count(F.lit(1)).alias("n")))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    texts = per_id.groupBy(*like).agg(F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless"), least)
    first = texts.groupBy(F.col("digest").alias("of")).agg(F.min("least.id").alias("first"))
    known = texts.join(first, texts["digest"].eqNullSafe(first["of"]))
    kept = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    two = F.array(F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - kept).alias("n")), F.struct(F.col("fails"), (kept + F.col("n_nameless")).alias("n")))
    both = known.select("part", "is_good", "is_toxic", F.explode(two).alias("x")).select("part", "is_good", "is_toxic", "x.*")

    def of(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))

    return both.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """From part, fails, n, good, toxic: a row per part, order of the filters and
    step, as filter_audit says."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    at = steps.withColumns({"letter": letter, "failing": F.contains("fails", letter), "gone": F.call_function("translate", earlier, F.col("fails"), F.lit("")) != earlier})

    def total(when: Column, what: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    here = F.col("failing") & ~F.col("gone")
    out = at.groupBy("part", "filter_order", "step", "letter").agg(
        total(~F.col("gone") & ~F.col("failing"), "n").alias("kept"),
        total(here, "n").alias("removed"),
        total(F.col("failing") & F.col("gone"), "n").alias("redundant"),
        total(F.col("fails") == F.col("letter"), "n").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    share = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "letter"]).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits: int) -> DataFrame:
    """Per part, filter_order (each permutation of ABCDE) and step (1 to 5):
    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley,
    the removals of the step's filter summed over all orders.

    A null text is empty, a null part is the empty string and joins with it, a
    null id fails E never and makes no other row fail it. Rows that repeat an id
    and text fail E only by a lesser id. Repeated label rows count as one that is
    good or toxic if any is; null labels are neither. Other columns are ignored.
    An empty table gives an empty result.
    """
    counts = written(failure_counts(docs, labels, id_col, text_col, part_col, **limits), "op13-counts")
    return interactions(counts)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return filter_audit(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT doc_id, part,
    concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM w
),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
o AS (
  SELECT concat(x1.a, x2.a, x3.a, x4.a, x5.a) AS filter_order FROM x x1, x x2, x x3, x x4, x x5
  WHERE len(list_distinct([x1.a, x2.a, x3.a, x4.a, x5.a])) = 5
),
s AS (
  SELECT part, fails, n, good, toxic, filter_order, step, substr(filter_order, step, 1) AS letter,
    contains(fails, substr(filter_order, step, 1)) AS failing,
    len(list_intersect(string_split(fails, ''), string_split(substr(filter_order, 1, step - 1), ''))) > 0 AND step > 1 AND fails <> '' AS gone
  FROM c, o, range(1, 6) r(step)
),
g AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""
