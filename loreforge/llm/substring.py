"""Substring dedup by relative Lempel-Ziv parsing.

Every text is cut into *blocks*. A block holds the windows of `WINDOW` words
that share an anchor: the leftmost least k-gram hash among the k-grams of the
window. The choice depends on the window's words alone, so equal windows have
equal anchors wherever they stand, and the blocks that share an anchor are the
only places where a window can occur again. The distinct blocks of the corpus
are the reference; its index maps an anchor to its reference blocks.

A text is parsed left to right against that index:

* a block that stands in the index twice or more is copied whole: one long
  factor, and all its windows repeat;
* at factor boundaries, where a block shares its anchor with different blocks,
  each window is looked up by itself among the windows of those blocks;
* the parse is greedy: from the first repeated window on, the factor copies from
  that reference text which goes along with it longest, and the next factor
  begins where it ends. An index entry names two texts at most that hold it, so
  the factor is the longest with respect to those; the union of all factors is
  the duplicate text, whichever texts they copy from.

Per occurrence of an anchor one small row is shuffled, not one per word; equal
blocks are counted before the shuffle; the lookups are joins whose large side
Spark can split. A group of any size is thus never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import written

WINDOW = 35
GRAM = 8
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_U = np.uint64


class Blocks:
    """The blocks of a run of texts: row of the text, first window, number of
    windows, anchor hash and content hash, all in the order of the texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int, windows: bool = False):
        starts, ends, self.word_offs = W.spans(buf, offs)
        self.starts, self.ends = starts, ends
        h = W.hashes(buf, starts, ends)
        n_words = np.diff(self.word_offs)
        gram = min(GRAM, window)
        none = np.empty(0, np.int64)
        self.row = self.first = self.count = none
        self.anchor = self.content = none.view(np.uint64)
        self.win = self.anchor
        if len(h) < window:
            return
        g = W.window_hash(h, gram, _M[0])
        at = W.window_argmin(g, window - gram + 1)
        win = W.window_hash(h, window, _M[1])
        end = np.repeat(self.word_offs[1:], n_words)[: len(win)]
        ok = np.flatnonzero(np.arange(len(win)) + window <= end)
        if not len(ok):
            return
        a = at[ok]
        lead = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)])
        tail = np.r_[lead[1:], len(ok)] - 1
        lo, hi, a = ok[lead], ok[tail], a[lead]
        self.row = np.searchsorted(self.word_offs, lo, side="right") - 1
        self.first, self.count = lo, hi - lo + 1
        self.anchor = g[a]
        # the first and the last window cover the block, since it has fewer windows than a window has words
        self.content = W.mix(win[lo] * _U(_M[2]) + W.mix(win[hi] + (self.count.astype(np.uint64) << _U(32)) + (a - lo).astype(np.uint64)))
        if windows:
            self.win = win

    def ordinals(self) -> np.ndarray:
        """The number of each block within its text."""
        lead = np.searchsorted(self.row, self.row)
        return np.arange(len(self.row)) - lead


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two values that tell texts apart, whatever their ids: rows that agree in id and text share them."""
    i = F.col(id_col)
    return F.xxhash64(i.isNull(), i.cast("string"), F.col(text_col)).alias("k1"), F.hash(i.isNull(), F.col(text_col)).alias("k2")


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for lo, hi, buf, offs in W.chunks(W.texts_of(batch, "text")):
                b = Blocks(buf, offs, window)
                packed = (k2[lo:hi][b.row].astype(np.int64) << 32) | b.ordinals()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(b.anchor)), pa.array(W.signed(b.content)), pa.array(k1[lo:hi][b.row]), pa.array(packed)], ["a", "b", "k1", "k2i"]
                )

    return run


def _windows(window: int):
    """The windows of the blocks that a text stands for in the index. Those of a
    block that occurs twice come a second time under another content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("asked").is_valid())
            asked, k1 = batch.column("asked"), batch.column("k1").to_numpy()
            for lo, hi, buf, offs in W.chunks(W.texts_of(batch, "text")):
                blocks = Blocks(buf, offs, window, windows=True)
                want = asked.slice(lo, hi - lo)
                flat = want.flatten()
                row = np.repeat(np.arange(hi - lo), np.diff(want.offsets.to_numpy()))
                own = k1[lo:hi]
                wa, wb, wn = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
                tag = lambda r, a, b: W.mix(r.astype(np.uint64) * _U(_M[0]) + W.mix(a) * _U(_M[1]) + b)
                have = tag(blocks.row, blocks.anchor, blocks.content)
                need, at = np.unique(tag(row, wa.view(np.uint64), wb.view(np.uint64)), return_index=True)
                _, pick = np.unique(have, return_index=True)
                pick = pick[np.isin(have[pick], need, assume_unique=True)]
                twice = wn[at[np.searchsorted(need, have[pick])]] >= 2
                pick, other = np.r_[pick, pick[twice]], np.r_[np.zeros(len(pick), np.uint64), np.ones(twice.sum(), np.uint64)]
                if not len(pick):
                    continue
                rep = np.repeat(np.arange(len(pick)), blocks.count[pick])
                x = np.arange(len(rep)) - np.repeat(np.r_[0, np.cumsum(blocks.count[pick])[:-1]], blocks.count[pick])
                p = pick[rep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(blocks.anchor[p])), pa.array(W.signed(blocks.content[p] ^ other[rep])), pa.array(x.astype(np.int32)), pa.array(W.signed(blocks.win[blocks.first[p] + x])), pa.array(own[blocks.row[p]])],
                    ["a", "b", "x", "w", "k"],
                )

    return run


_OUT = "n_words long, n_removed long, factors array<struct<start:long,length:long,ref_row:long>>, kept_text string"


def _apply(window: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_row", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids, k1, k2 = batch.column("found"), batch.column("id"), batch.column("k1"), batch.column("k2").to_numpy()
            for lo, hi, buf, offs in W.chunks(W.texts_of(batch, "text")):
                hits = found.slice(lo, hi - lo)
                size = np.where(hits.is_valid().to_numpy(zero_copy_only=False), np.diff(hits.offsets.to_numpy()), 0)
                blocks = Blocks(buf, offs, window) if size.any() else None
                words = W.spans(buf, offs)[2] if blocks is None else blocks.word_offs
                n_words, removed, factors, kept = np.diff(words), np.zeros(hi - lo, np.int64), [[]] * (hi - lo), []
                for r in range(hi - lo):
                    parts = buf[offs[r] : offs[r + 1]].tobytes().split()
                    if size[r]:
                        parts, factors[r], removed[r] = _parse(parts, hits[r].values, k1[lo + r].as_py(), int(k2[lo + r]), blocks, r, window)
                    kept.append(b" ".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), k1.slice(lo, hi - lo), pa.array(n_words), pa.array(removed), pa.array(factors, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "row", "n_words", "n_removed", "factors", "kept_text"],
                )

    return run


def _greedy(start: np.ndarray, end: np.ndarray, refs: list[tuple[int, int]], own: int) -> Iterator[tuple[int, int, int]]:
    """Factors (first window, last window, text that it copies from) of runs of
    repeated windows, each run with two texts that hold it: always the longest
    that goes on from where the one before ended."""
    i = 0
    while i < len(start):
        best, ref = i, None
        for r in sorted(set(refs[i]), key=lambda r: r == own):
            j = i
            while j + 1 < len(start) and start[j + 1] == end[j] + 1 and r in refs[j + 1]:
                j += 1
            if ref is None or j > best:
                best, ref = j, r
        yield int(start[i]), int(end[best]), ref
        i = best + 1


def _parse(parts: list[bytes], hits: pa.Array, own: int, key: int, blocks: Blocks, r: int, window: int) -> tuple[list[bytes], list[dict], int]:
    """Factors of one text, from the verdicts on its blocks, and what is left."""
    base, lead = blocks.word_offs[r], int(np.searchsorted(blocks.row, r))
    k2, i, mask, lo, hi = (hits.field(c).to_numpy(zero_copy_only=False) for c in ("k2", "i", "mask", "lo", "hi"))
    mine = np.flatnonzero(k2 == key)
    order = mine[np.unique(i[mine], return_index=True)[1]]
    if not len(order):
        return parts, [], 0
    i, mask, lo, hi = i[order] + lead, mask[order], lo[order], hi[order]
    rep = np.repeat(np.arange(len(i)), blocks.count[i])
    x = np.arange(len(rep)) - np.repeat(np.r_[0, np.cumsum(blocks.count[i])[:-1]], blocks.count[i])
    hit = (mask[rep] >> x) & 1 == 1
    block, at = rep[hit], blocks.first[i[rep]][hit] + x[hit] - base
    cut = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + 1) | (block[1:] != block[:-1])])
    stop = np.r_[cut[1:], len(at)] - 1
    refs = list(zip(lo[block[cut]].tolist(), hi[block[cut]].tolist(), strict=True))
    factors = [{"start": s, "length": e - s + window, "ref_row": ref} for s, e, ref in _greedy(at[cut], at[stop], refs, own)]
    # the words of the factors go
    edge = np.zeros(len(parts) + 1, np.int64)
    np.add.at(edge, [f["start"] for f in factors], 1)
    np.add.at(edge, [f["start"] + f["length"] for f in factors], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(parts, gone.tolist(), strict=True) if not g], factors, int(gone.sum())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Removes every word covered by a window of `window` words that starts
    anywhere else in the corpus too, the same text included.

    Returns the id, row (a number of the text), n_words, n_removed, factors
    (start and length in words, and the row of a text that holds it, another one
    if there is another) and kept_text, the words left joined by single spaces.

    Windows are judged on the input. A null or empty text has no words and
    keeps an empty kept_text. Texts below `window` words are never cut. Repeated
    rows, also those with one id, count as texts of their own, so all their
    windows repeat. Ids are of any type and may be null. Other columns are ignored
    whatever their names. An empty table gives an empty result. `window` is 2
    to 64, so that a block's verdict fits one bit mask.
    """
    if not 2 <= window <= 64:
        raise ValueError("window must be 2 to 64")
    kind = dict(docs.select(id_col).dtypes)[id_col]
    k1, k2 = _key(id_col, text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), k1, k2)
    occ = texts.select("text", "k1", "k2").mapInArrow(_occurrences(window), "a long, b long, k1 long, k2i long")

    index = written(occ.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi")), "op4-index")
    many = index.groupBy("a").agg(F.count(F.lit(1)).alias("d")).filter("d >= 2").select("a")
    edge = written(index.join(many.hint("merge"), "a"), "op4-edges")
    asked = edge.groupBy(F.col("lo").alias("k1")).agg(F.collect_list(F.struct("a", "b", "n")).alias("asked"))
    # both joins take the texts dealt by k1, with the same columns: one exchange serves both
    win = texts.join(asked, "k1", "left").select("id", "text", "k1", "k2", "asked").mapInArrow(_windows(window), "a long, b long, x int, w long, k long")
    # read from a table, so that Spark can split the windows of a hot passage in the join
    again = win.groupBy("a", "w").agg(F.min("b").alias("b0"), F.max("b").alias("b1"), F.min("k").alias("k0"), F.max("k").alias("k1")).filter("b0 <> b1").select("a", "w", "k0", "k1")
    again = written(again, "op4-windows")
    part = win.join(again, ["a", "w"]).groupBy("a", "b").agg(F.expr("bit_or(shiftleft(1L, x))").alias("mask"), F.min("k0").alias("lo"), F.max("k1").alias("hi"))
    whole = index.filter("n >= 2").select("a", "b", F.lit(-1).cast("long").alias("mask"), "lo", "hi")
    verdict = whole.unionByName(edge.filter("n = 1").select("a", "b").join(part, ["a", "b"]).select("a", "b", "mask", "lo", "hi"))
    hit = F.struct(F.expr("cast(shiftright(k2i, 32) as int)").alias("k2"), F.expr("cast(k2i & 4294967295L as int)").alias("i"), "mask", "lo", "hi")
    # a set: rows that repeat id and text have the same hits, however many they are
    found = occ.join(verdict, ["a", "b"]).select("k1", hit.alias("hit")).groupBy("k1").agg(F.collect_set("hit").alias("found"))
    out = texts.join(found, "k1", "left").select("id", "text", "k1", "k2", "found").mapInArrow(_apply(window), f"id {kind}, row long, {_OUT}")
    return out.withColumnRenamed("id", id_col)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM s),
c AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM g WHERE h IN (SELECT h FROM c)),
r AS (SELECT doc_id, list(pos) AS gone FROM p GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS kept FROM u LEFT JOIN p ON p.doc_id = u.doc_id AND p.pos = u.pos WHERE p.pos IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
