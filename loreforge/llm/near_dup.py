"""Near-duplicate detection by order MinHash.

A text's shingles are its runs of `K` words, each labelled with the number of
its occurrence in the text. Each of `M` sketches takes the `L` labelled shingles
with the least values under its own hash and joins them *in text order*, so two
texts agree in a sketch if they share shingles in the same order. Texts that
agree in a sketch are candidates. They are verified: the Jaccard similarity of
their labelled shingles must be `threshold` or more, and so must the similarity
of the texts under a banded alignment of their words. Verified pairs are links;
connected components of links are the classes.

Equal texts are one node, so copies cost one row each. Buckets (texts with one
sketch) of up to `PAIR_UP` nodes are compared in all pairs. In larger ones each
node is compared with the bucket's hubs, the few nodes that meet most others over
all their sketches (the original of many copies and the copies nearest to it);
their members are dealt further into buckets of two and then of four
neighbouring sketches, treated in the same way. So the pairs grow with the
nodes, not with their square: a group of near copies of one text is joined
through that text. The links that lead past the hubs are found by a last pass:
where the members of a large bucket are still in several components, those
outside the bucket's main component are compared with all its members, in
blocks that are tasks of their own, by exact counts of common shingles. So every
two texts with a common sketch that are a link end in one class, and what can be
missed is the chance of the sketches alone. Only links, one or a few for two
components, leave a block; its pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .columns import own_names
from .components import components
from .storage import written

K, L, M, THRESHOLD = 5, 3, 16, 0.8
PAIR_UP = 32
#: Nodes of a larger bucket that all its others are compared with.
HUBS = 6
#: Parts of a large bucket that are ranked apart.
PARTS = 64
#: Most characters and texts (about) of a block in which the rest of a large bucket is compared.
BLOCK_CHARS, BLOCK_TEXTS = 1 << 18, 256
#: Pairs whose words a task holds at once.
VERIFY_ROWS = 512
#: Sketches in a bucket's key; members of large buckets go on to the next.
WIDTHS = (1, 2, 4)
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_SEEDS = W.mix(np.arange(1, 1025, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def labelled(h: np.ndarray, word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of a run of texts, and each text's offsets."""
    n = np.diff(word_offs)
    g = W.window_hash(h, k, 0x9E3779B97F4A7C15)
    ok = np.arange(len(g)) + k <= np.repeat(word_offs[1:], n)[: len(g)]
    g = g[ok]
    offs = np.r_[0, np.cumsum(np.maximum(n - k + 1, 0))]
    row = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0)).astype(np.uint64)
    key = W.mix(g + row * _U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.empty(0, bool)
    lead = np.flatnonzero(fresh)
    nth = np.empty(len(key), np.uint64)
    nth[order] = np.arange(len(key)) - np.repeat(lead, np.diff(np.r_[lead, len(key)]))
    return W.mix(g + nth * _U(0x165667B19E3779F9)), offs


def sketches(x: np.ndarray, offs: np.ndarray, m: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the texts that have `least` shingles, and their m sketches."""
    n = np.diff(offs)
    rows = np.flatnonzero(n >= least)
    if not len(rows):
        return rows, np.empty((0, m), np.uint64)
    use = np.repeat(n >= least, n)
    x, n = x[use], n[rows]
    lead = np.r_[0, np.cumsum(n)[:-1]]
    out = np.empty((len(rows), m), np.uint64)
    for i in range(m):
        v, at = x * _SEEDS[i], np.empty((least, len(rows)), np.int64)
        for j in range(least):
            low = np.minimum.reduceat(v, lead)
            hit = np.flatnonzero(v == np.repeat(low, n))
            first = np.searchsorted(hit, lead)
            at[j] = hit[first]
            v[at[j]] = _MAX
        at.sort(axis=0)
        s = np.full(len(rows), i, np.uint64)
        for j in range(least):
            s = W.mix(s * _U(0xD6E8FEB86659FD93) + x[at[j]])
        out[:, i] = s
    return rows, out


def _sketch(k: int, least: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, ids = batch.column("t1"), batch.column("t2"), batch.column("id")
            for lo, hi, buf, offs in W.chunks(W.texts_of(batch, "text"), 1 << 19):
                starts, ends, words = W.spans(buf, offs)
                x, shingles = labelled(W.hashes(buf, starts, ends), words, k)
                rows, s = sketches(x, shingles, m, least)
                size = np.zeros(hi - lo + 1, np.int32)
                size[rows + 1] = m
                arr = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(W.signed(s.reshape(-1))))
                yield pa.RecordBatch.from_arrays([t1.slice(lo, hi - lo), t2.slice(lo, hi - lo), ids.slice(lo, hi - lo), arr], ["t1", "t2", "id", "sk"])

    return run


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def banded_distance(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Edit distances (words put in, left out or changed) of all pairs at once,
    -1 where over `most`. The band starts narrow and doubles for the pairs whose
    distance it does not prove."""
    out, left, band = np.full(len(pairs), -1, np.int64), np.arange(len(pairs)), 8
    apart = np.array([abs(len(a) - len(b)) for a, b in pairs])
    left = left[apart <= most]
    while len(left):
        d = _band([pairs[i] for i in left], band)
        done = d <= band
        out[left[done & (d <= most[left])]] = d[done & (d <= most[left])]
        left = left[~done & (most[left] > band)]
        band *= 2
    return out


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], b: int) -> np.ndarray:
    """Distances within diagonals -b..b, larger than b where there is no path."""
    w, far = 2 * b + 1, np.int32(1 << 28)
    na, nb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    rows = int(na.max(initial=0))
    x = np.full((len(pairs), rows), -1, np.int64)
    y = np.full((len(pairs), rows + w + 1), -2, np.int64)
    for i, (p, q) in enumerate(pairs):
        x[i, : len(p)] = p
        y[i, b : b + len(q)][: y.shape[1] - b] = q[: y.shape[1] - b]
    j = np.arange(w, dtype=np.int32) - b
    d = np.broadcast_to(np.where(j >= 0, j, far).astype(np.int32), (len(pairs), w)).copy()
    step = np.arange(w, dtype=np.int32)
    out = np.full(len(pairs), far, np.int64)
    end = nb - na + b
    fits = (end >= 0) & (end < w)
    at = np.where(fits, end, 0)
    stop = np.flatnonzero(fits & (na == 0))
    out[stop] = d[stop, at[stop]]
    finish = np.argsort(na, kind="stable")
    ptr = int(np.searchsorted(na[finish], 1))
    for i in range(1, rows + 1):
        new = d + (x[:, i - 1 : i] != y[:, i - 1 : i - 1 + w])
        np.minimum(new[:, :-1], d[:, 1:] + 1, out=new[:, :-1])
        if i <= b:
            new[:, : b - i] = far
            new[:, b - i] = i
        d = np.minimum(np.minimum.accumulate(new - step, axis=1) + step, far)
        while ptr < len(finish) and na[finish[ptr]] == i:
            if fits[finish[ptr]]:
                out[finish[ptr]] = d[finish[ptr], at[finish[ptr]]]
            ptr += 1
    return out


def _alignment(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Similarity of all pairs under the banded alignment, -1 where it is too far below `threshold`."""
    edit = np.full(len(pairs), -1.0)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]))
    lo = 0
    while lo < len(order):  # pairs of like length together, within some MB
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(pairs[order[hi]][0]) <= 1 << 19:
            hi += 1
        some = order[lo:hi]
        longest = np.array([max(len(pairs[i][0]), len(pairs[i][1]), 1) for i in some])
        d = banded_distance([pairs[i] for i in some], np.floor((1 - threshold) * longest + 1e-9).astype(np.int64))
        edit[some] = np.where(d < 0, -1.0, 1 - d / longest)
        lo = hi
    return edit


def _verify(k: int, threshold: float):
    def words(text: str) -> np.ndarray:
        return np.fromiter(map(hash, text.encode("utf-8", "surrogatepass").split()), np.int64)

    def shingles(h: np.ndarray) -> np.ndarray:
        return labelled(W.mix(h.view(np.uint64)), np.array([0, len(h)]), k)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, VERIFY_ROWS) for b in batches for lo in range(0, b.num_rows, VERIFY_ROWS)):
            keep, pairs, sims = [], [], []
            last, old = None, None
            for i, (p, q) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                q = q.as_py()
                if q != last:
                    last, old = q, (h := words(q), shingles(h))
                h = words(p.as_py())
                if min(len(h), len(old[0])) < threshold * max(len(h), len(old[0])):
                    continue
                sim = _jaccard(shingles(h), old[1])
                if sim >= threshold:
                    keep.append(i)
                    pairs.append((h, old[0]))
                    sims.append(sim)
            edit = _alignment(pairs, threshold)
            ok = edit >= threshold - 1e-9
            keep = np.array(keep, np.int64)[ok]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(np.array(sims)[ok], pa.float64()), pa.array(edit[ok])], ["a", "b", "jaccard", "alignment"])

    return run


def _candidates(rows: DataFrame, key: list[str], what: str) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of the nodes that share a key, and the rows of large buckets.
    rows: node and the key's columns."""
    # counts and hubs are read from tables, so that Spark can split the rows of a hot bucket in the joins;
    # they grow with the corpus, so the plan for large inputs is asked for at every size
    sizes = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), f"op6-{what}-sizes")
    shared = written(rows.join(sizes.hint("merge"), key), f"op6-{what}")
    small, large = shared.filter(F.col("size") <= PAIR_UP), shared.filter(F.col("size") > PAIR_UP)
    other = small.select(*key, F.col("node").alias("b"))
    pairs = small.join(other, key).filter("node < b").select(F.col("node").alias("a"), "b")
    meets = large.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = large.join(meets, "node")
    # the first in each part of a bucket, then the first of those: no task ranks a whole hot bucket
    best = ranked.select(*key, "node", "meets", F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part"))
    for by in ([*key, "part"], key):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("meets"), "node"))
        best = best.withColumn("nth", nth).filter(F.col("nth") <= HUBS)
    best = best.groupBy(*key).agg(F.collect_list("node").alias("hubs"))
    hubs = written(best, f"op6-{what}-hubs")
    # a node meets the same hubs in many of its buckets: they are joined as lists and made one before they become pairs
    met = large.join(hubs.hint("merge"), key).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"))
    star = met.select("node", F.explode("hubs").alias("hub")).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return pairs.unionByName(star), large


class _Block:
    """Members of a bucket with their words and labelled shingles."""

    def __init__(self, table: pa.Table, k: int):
        batch = table.combine_chunks().to_batches()[0]
        self.node, self.root = (batch.column(c).to_numpy() for c in ("node", "root"))
        self.main = batch.column("main").to_numpy(zero_copy_only=False)
        self.sk = batch.column("sk").flatten().to_numpy().reshape(len(self.node), -1)
        self.words, self.shingles = [], []
        for lo, hi, buf, offs in W.chunks(W.texts_of(batch, "text"), 1 << 19):
            starts, ends, words = W.spans(buf, offs)
            h = W.hashes(buf, starts, ends)
            x, at = labelled(h, words, k)
            self.words += [h[words[i] : words[i + 1]].view(np.int64) for i in range(hi - lo)]
            self.shingles += [x[at[i] : at[i + 1]] for i in range(hi - lo)]
        self.n = np.array([len(x) for x in self.shingles])


def _across(k: int, threshold: float):
    """Links of the members in the left block to those in the right one that are in other components."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        links = {c: [] for c in ("a", "b", "ra", "rb", "jaccard", "alignment")}
        if left.num_rows and right.num_rows:
            x, y = _Block(left, k), _Block(right, k)
            # two members outside the main component meet once, and in the first of their common buckets
            may = (x.root[:, None] != y.root) & (y.main | (x.node[:, None] < y.node))
            for j in range(key[0].as_py()):
                may &= x.sk[:, j, None] != y.sk[:, j]
            every = np.concatenate(y.shingles)
            order = np.argsort(every)
            every, row = every[order], np.repeat(np.arange(len(y.n)), y.n)[order]
            sims = np.zeros(may.shape)
            for i in np.flatnonzero(may.any(axis=1)):
                lo, hi = np.searchsorted(every, x.shingles[i]), np.searchsorted(every, x.shingles[i], side="right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                same = np.bincount(row[at], minlength=len(y.n))
                sims[i] = same / np.maximum(x.n[i] + y.n - same, 1)
            a, b = np.nonzero(may & (sims >= threshold))
            # some of the pairs of two components, then more if none of them is a link
            both = np.unique(np.c_[x.root[a], y.root[b]], axis=0, return_inverse=True)[1].reshape(-1)
            left_over, some = np.argsort(both, kind="stable"), 1
            while len(left_over):
                p = both[left_over]
                lead = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                taken = np.arange(len(p)) - np.repeat(lead, np.diff(np.r_[lead, len(p)])) < some
                now = left_over[taken]
                edit = _alignment([(x.words[a[i]], y.words[b[i]]) for i in now], threshold)
                ok = edit >= threshold - 1e-9
                hit = now[ok]
                for c, v in zip(links, (x.node[a[hit]], y.node[b[hit]], x.root[a[hit]], y.root[b[hit]], sims[a[hit], b[hit]], edit[ok]), strict=True):
                    links[c].append(v)
                left_over = left_over[~taken]
                left_over = left_over[~np.isin(both[left_over], both[hit])]
                some *= 2
        return pa.table({c: np.concatenate(v) if v else np.empty(0, np.float64 if c in ("jaccard", "alignment") else np.int64) for c, v in links.items()})

    return run


def _rest(large: DataFrame, roots: DataFrame, body: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links a, b, with their components ra, rb, between members of a large bucket
    that are in different components: at least one for each two components that
    have a link in some bucket."""
    key = ["i", "s"]
    member = large.select(*key, "node", "sk").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = written(member.join(body.select("node", F.octet_length("text").alias("chars")), "node"), "op6-members")
    by_root = member.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    split = by_root.groupBy(*key).agg(F.max(F.struct("n", "root", "chars")).alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")

    def blocks(n, chars):
        return F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(chars / BLOCK_CHARS)).cast("int")

    split = split.select(*key, F.col("top.root").alias("top"), blocks(F.col("n"), F.col("chars")).alias("ny"), blocks(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars")).alias("nx"))
    split = written(split, "op6-split")
    member = member.join(split.hint("merge"), key).withColumn("main", F.expr("root = top")).select(*key, "node", "root", "sk", "main", "nx", "ny")
    member = member.join(body, "node")
    x = member.filter("not main").withColumn("x", F.pmod(F.xxhash64("node"), "nx")).withColumn("y", F.explode(F.expr("sequence(0L, ny - 1L)")))
    y = member.withColumn("y", F.pmod(F.xxhash64(F.lit(17), "node"), "ny")).withColumn("x", F.explode(F.expr("sequence(0L, nx - 1L)")))
    part, cols = [*key, "x", "y"], [*key, "x", "y", "node", "root", "main", "sk", "text"]
    return x.select(cols).groupBy(*part).cogroup(y.select([F.col(c).alias(c) for c in cols]).groupBy(*part)).applyInArrow(_across(k, threshold), "a long, b long, ra long, rb long, jaccard double, alignment double")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, least: int = L, m: int = M, threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct text, by its hashes t1 and t2: class_no, class_id,
    class_texts, n_verified and n_copies as in near_duplicates."""
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), text).alias("t2")).filter(text.isNotNull())
    kind = dict(docs.select(id_col).dtypes)[id_col]
    drawn = texts.mapInArrow(_sketch(k, least, m), f"t1 long, t2 long, id {kind}, sk array<long>")
    nodes = drawn.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"), F.first("sk").alias("sk"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "op6-nodes")

    level = nodes.select("node", "sk", F.posexplode("sk").alias("i", "s"))
    pairs, widest = None, None
    for width in WIDTHS:
        rows = level.select("node", "sk", "i", F.xxhash64(*[F.get("sk", (F.col("i") + j) % m) for j in range(width)]).alias("s"))
        found, large = _candidates(rows, ["i", "s"], f"sketches-{width}")
        pairs = found if pairs is None else pairs.unionByName(found)
        widest = large if widest is None else widest
        level = large
    pairs = written(pairs.distinct(), "op6-pairs")

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = nodes.select("node", "t1", "t2", "id").join(asked, "node")
    body = texts.select("t1", "t2", "text").join(keys.select("t1", "t2", "node"), ["t1", "t2"])
    body = body.dropDuplicates(["node"]).select("node", "text")
    body = written(body, "op6-texts")
    both = pairs.join(body.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(body.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    links = written(both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, threshold), "a long, b long, jaccard double, alignment double"), "op6-links")

    roots = components(links.select("a", "b"))
    if widest.limit(1).count():
        rest = written(_rest(widest, roots, body, k, threshold), "op6-rest")
        over = components(rest.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("up"))
        all_roots = nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = written(all_roots.join(over, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "op6-roots")
        links = links.unionByName(rest.drop("ra", "rb"))
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    known = nodes.select("t1", "t2", "node", "id", "n_copies").join(roots, "node", "left").join(degree, "node", "left")
    known = written(known.select("t1", "t2", "id", "n_copies", F.coalesce("root", "node").alias("class_no"), F.coalesce("n_verified", F.lit(0)).alias("n_verified")), "op6-known")
    heads = known.groupBy("class_no").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_texts"))
    return written(known.join(heads, "class_no").drop("id"), "op6-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per row of `docs`: the id, class_id (the least id of its class),
    class_no (an internal number, equal within a class), class_texts (different
    texts of the class), n_verified (links of its text that had to be verified to
    find the class; in large buckets not all of them, so no count of its near
    copies) and n_copies (rows with exactly its text).

    Texts that are equal are one class. A text with fewer than `least` + k - 1
    words has too few shingles to be sketched and joins only its exact copies
    (at k = 5 and 0.8 it could not have another near copy). A null text is in
    no class but its own: class_id is its id, class_no null, class_texts and
    n_copies 1. If ids
    repeat, different classes can have one class_id; class_no tells them apart.
    Null ids take part; a class of null ids only has a null class_id. Other
    columns are ignored. An empty table gives an empty result.
    """
    known, text = classes(docs, id_col, text_col, **more), F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), text).alias("t2"), text.isNull().alias("none"))
    mine = rows.filter("not none").join(known, ["t1", "t2"]).select("id", "class_id", "class_no", "class_texts", "n_verified", "n_copies")
    none = rows.filter("none").select("id", F.col("id").alias("class_id"), F.lit(None).cast("long").alias("class_no"), F.lit(1).cast("long").alias("class_texts"), F.lit(0).cast("long").alias("n_verified"), F.lit(1).cast("long").alias("n_copies"))
    return mine.unionByName(none).withColumnRenamed("id", id_col)


@own_names()
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs that stay when of each class the text with the least id
    does, once; all columns as they are, whatever their names. Null texts stay."""
    text = F.col(text_col)
    known = classes(docs, id_col, text_col, **more)
    keys = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(17), text).alias("__t2"), text.isNull().alias("__none"))
    heads = known.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "class_no", "class_id")
    # where ids repeat, one text of those with the least id
    best = written(keys.filter("not __none").groupBy("__id", "__t1", "__t2").agg(F.count(F.lit(1)).alias("n")).join(heads, ["__t1", "__t2"]).filter("__id <=> class_id"), "op6-heads")
    best_of = best.groupBy("class_no").agg(F.min(F.struct("__t1", "__t2")).alias("k"), F.max("n").alias("n"))
    best_of = best_of.select(F.col("k.__t1").alias("__t1"), F.col("k.__t2").alias("__t2"), F.col("n").alias("__n"), F.col("class_no").alias("__class"))
    best_id = best.select("__id", "__t1", "__t2").join(best_of, ["__t1", "__t2"])
    own = docs.withColumns({"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(17), text), "__i": F.col(id_col)})
    match = (own["__t1"] == best_id["__t1"]) & (own["__t2"] == best_id["__t2"]) & own["__i"].eqNullSafe(best_id["__id"])
    kept = own.filter(text.isNotNull()).join(best_id, match)
    if best.filter("n > 1").limit(1).count():  # rows that repeat id and text
        kept = kept.dropDuplicates(["__class"])
    return kept.select(*(F.col(c) for c in docs.columns)).unionByName(docs.filter(text.isNull()))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_texts", "n_copies")
