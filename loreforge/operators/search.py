"""Full-text, vector and hybrid search over many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.text import fts_tokens
from loreforge.sources.scratch import spread, written

K1, B = 1.2, 0.75
RRF_K = 60
CANDIDATES, FUSED = 50, 20
#: Queries whose scores against a block of vectors are held at a time.
AT_ONCE = 64
#: Tokens that are counted at a time.
STEP = 1 << 17
#: Query terms up to this number are sent to all executors.
BROADCAST_TERMS = 500_000


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most STEP tokens, or of one text."""
    ends, lo = batch.column(batch.schema.get_field_index("t")).offsets.to_numpy(), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + STEP, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each text with how often it has them. What is held
    besides the batch that came is of a few texts, however large that batch is."""
    for part in (s for batch in batches for s in _steps(batch)):
        t = part.column(part.schema.get_field_index("t"))
        row = pc.list_parent_indices(t)
        if not len(row):
            continue
        got = pa.table({"row": row, "term": t.flatten()}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
        at = got["row"].combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(at), part.column(1).take(at), got["term"].combine_chunks().cast(pa.string()), got["count_all"].combine_chunks().cast(pa.int32())], ["id", "doc_len", "term", "tf"]
        )


@dataclass(frozen=True)
class TextIndex:
    """The tokens of every chunk: id, doc_len and t. Where it is used more than
    once it is stored, so that each text is taken apart once; statistics then
    read one small column."""

    tokens: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, id_col: str = "id", text_col: str = "text", store: bool = True) -> TextIndex:
        t = fts_tokens(F.coalesce(F.col(text_col), F.lit("")))
        rows = spread(chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col))).select("id", t.alias("t"))
        # written before its length is taken, or the tokens would be made again for it
        rows = rows.select("id", F.explode(F.array("t")).alias("t")).select("id", F.size("t").alias("doc_len"), "t")
        return cls(written(rows, "text-index") if store else rows)

    def postings(self, words: DataFrame | None = None) -> DataFrame:
        """id, doc_len and, per term (of words, column term, if given), term and
        tf. Texts without tokens have no row. A text is one row of tokens, so it is
        counted where it lies and nothing is shuffled."""
        rows = self.tokens.select("id", "doc_len", "t").mapInArrow(_term_counts, f"id {dict(self.tokens.dtypes)['id']}, doc_len int, term string, tf int")
        return rows if words is None else rows.join(words, "term", "left_semi")

    def containing(self, words: DataFrame) -> DataFrame:
        """term and df, in how many texts it is, of the words (column term) that any has."""
        return self.tokens.select(F.explode(F.array_distinct("t")).alias("term")).join(words, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def stats(self) -> DataFrame:
        """n_docs (all rows), n_tokens and avgdl (mean tokens), over the whole index."""
        return self.tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("n_tokens"), F.avg("doc_len").alias("avgdl"))


def bm25(index: TextIndex, queries: DataFrame, allowed: DataFrame | None = None, limit: int = CANDIDATES) -> DataFrame:
    """query_id, id, score, pos (from 1): the best `limit` chunks per query that
    share a token with it; a repeated query token counts each time. Statistics
    are over all chunks; only those in `allowed` (column id), if given, appear.
    A term in over half of the chunks has the idf 1e-6. Ties by id. A stored index
    finds the same rows by its own way."""
    if not isinstance(index, TextIndex):
        return index.search(queries, allowed, limit)
    terms = queries.select("query_id", F.explode(fts_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    words = terms.select("term").distinct()
    near = F.broadcast if words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda x: x)
    post = index.postings(near(words))
    # written, as few rows that a whole pass over the texts makes
    idf = written(index.containing(near(words)), "text-df")
    weight = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(idf, "term").crossJoin(F.broadcast(index.stats())).select("query_id", "term", "qf", "avgdl", F.when(weight > 0, weight).otherwise(F.lit(1e-6)).alias("idf"))
    if allowed is not None:
        post = post.join(allowed.select("id"), "id", "left_semi")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    scored = post.join(near(weighed), "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return top(scored, limit)


def top(scored: DataFrame, limit: int, *order) -> DataFrame:
    """The best `limit` rows per query with pos from 1; ties by id."""
    keys = order or (F.round("score", 9).desc(), F.col("id"))
    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys))).filter(F.col("pos") <= limit)


def _matrix(rows: pa.StructArray) -> np.ndarray:
    return rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _block_topk(limit: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, v = batch.column("q")[row].values, batch.column("v")[row].values
                vm, vi = _matrix(v), v.field("id").to_numpy()
                vn, keep = np.linalg.norm(vm, axis=1)[None], min(limit, len(vi))
                for lo in range(0, len(q), AT_ONCE):
                    some = q.slice(lo, AT_ONCE)
                    qm, qi = _matrix(some), some.field("id").to_numpy()
                    norm = np.linalg.norm(qm, axis=1)[:, None] * vn
                    sim = np.divide(qm @ vm.T, norm, out=np.zeros_like(norm), where=norm > 0)
                    if exclude_self:
                        sim[qi[:, None] == vi[None]] = -np.inf
                    order = np.lexsort((np.broadcast_to(vi, sim.shape), -np.round(sim, 9)), axis=1)[:, :keep]
                    score = np.take_along_axis(sim, order, 1)
                    ok = np.isfinite(score)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, keep)[ok.ravel()]), pa.array(vi[order][ok]), pa.array(score[ok])], ["query_id", "id", "score"])

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, limit: int = CANDIDATES, group: tuple[str, ...] = (), exclude_self: bool = False, block: int = 2048, query_block: int = 512) -> DataFrame:
    """query_id, id, score, pos: the most similar vectors (cosine; 0 for a zero
    vector) of each query (query_id, vec). vectors: id, vec. With `group`, columns
    of both, a query meets the vectors of its own group only; null is a group.
    With exclude_self an id is no hit of the query with the same number. A query
    meets only vectors of its own dimension; null and empty vectors are skipped.

    Exact: queries and vectors are packed in blocks of fixed size, each block of
    queries is sent to every block of vectors of its group, and each pair is one
    matrix product of which only the best `limit` per query leave. So a hot group
    is many blocks, and nothing is broadcast."""
    dim = F.size("vec")
    g = F.xxhash64(dim, *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in group)).alias("g")
    rows = lambda df, key: df.filter(F.coalesce(dim, F.lit(0)) > 0).select(g, F.col(key).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    v, q = rows(vectors, "id"), rows(queries, "query_id")
    blocks = lambda df, size, name: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    vs, qs = blocks(v, block, "nv"), blocks(q, query_block, "nq")
    v = v.join(vs, "g").groupBy("g", F.pmod(F.xxhash64("id"), "nv").alias("b")).agg(F.collect_list(F.struct("id", "vec")).alias("v"))
    q = q.join(qs, "g").groupBy("g", F.pmod(F.xxhash64("id"), "nq").alias("qb")).agg(F.collect_list(F.struct("id", "vec")).alias("q"))
    q = q.join(vs, "g").select("g", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)).alias("b"))
    scored = q.join(v, ["g", "b"]).select("q", "v").mapInArrow(_block_topk(limit, exclude_self), "query_id long, id long, score double")
    return top(scored, limit)


def collapse(hits: DataFrame, owner: DataFrame) -> DataFrame:
    """Chunk hits to notes: owner maps id (chunk) to note_id; the first chunk of
    a note stays, and pos counts distinct notes."""
    notes = hits.join(owner, "id").groupBy("query_id", "note_id").agg(F.min(F.struct("pos", "id")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("m.pos", "note_id"))
    return notes.select("query_id", F.col("note_id").alias("id"), F.col("m.id").alias("chunk_id"), rank.alias("pos"))


def rrf(*lists: DataFrame, limit: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, pos from 1): the
    sum of 1 / (60 + pos), best first, ties by id."""
    out = None
    for one in lists:
        one = one.select("query_id", "id", (F.lit(1.0) / (RRF_K + F.col("pos"))).alias("part"))
        out = one if out is None else out.unionByName(one)
    return top(out.groupBy("query_id", "id").agg(F.sum("part").alias("score")), limit, F.round("score", 12).desc(), F.col("id"))


def overlap_rerank(hits: DataFrame, queries: DataFrame, index: TextIndex) -> DataFrame:
    """The offline reranker: the share of a query's distinct tokens that the text
    of a hit (chunk_id) has. Adds score; run it after the cut, on few rows. An own
    provider has the same form: hits (query_id, chunk_id), queries, index."""
    if not isinstance(index, TextIndex):
        return index.overlap(hits, queries)
    q = queries.select("query_id", F.array_distinct(fts_tokens(F.col("query"))).alias("q"))
    c = index.tokens.select(F.col("id").alias("chunk_id"), F.array_distinct("t").alias("c"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("q", "c")), F.size("q")), F.lit(0.0))
    return hits.join(q, "query_id").join(c, "chunk_id").withColumn("score", share).drop("q", "c")


def recall(
    index: TextIndex,
    queries: DataFrame,
    vector_hits: list[DataFrame] | None = None,
    owner: DataFrame | None = None,
    notes: DataFrame | None = None,
    project: str | None = None,
    rerank: Callable[[DataFrame, DataFrame, TextIndex], DataFrame] | None = overlap_rerank,
    min_score: float = 0.2,
    limit: int = 5,
) -> DataFrame:
    """Hybrid retrieval of notes: query_id, id, chunk_id, score, pos. Lexical and
    vector hits are chunks; of each list a note keeps its first chunk, then lists
    are fused, cut to 20, reranked, thresholded on the raw score, ordered with
    the project's boost (+0.08, or x1.3 without reranking), cut to `limit`.
    Reported scores are raw. A note's chunk is the lexical one if there is one.

    owner maps chunks (id) to note_id; without it a chunk is a note. vector_hits
    are lists (query_id, id, pos), one for each policy whose spaces were searched
    with a model of their own; they are laid end to end, in this order, and a
    note counts in the first. notes (id, project), if given, limits hits to its
    ids and provides the boost; an empty notes table gives no hits."""
    owner = index.tokens.select("id", F.col("id").alias("note_id")) if owner is None else owner.select("id", "note_id")
    if notes is not None:
        owner = owner.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    lex = collapse(bm25(index, queries, None if notes is None else owner), owner)
    lists = [lex]
    if vector_hits:
        parts = [top(h.join(owner, "id", "left_semi").drop("pos"), CANDIDATES).select("query_id", "id", (F.lit(i * 10**6) + F.col("pos")).alias("pos")) for i, h in enumerate(vector_hits)]
        lists.append(collapse(reduce(DataFrame.unionByName, parts), owner))
    fused = rrf(*lists).withColumnRenamed("pos", "rrf_pos")
    chunk = reduce(DataFrame.unionByName, (x.select("query_id", "id", F.lit(i).alias("o"), "chunk_id") for i, x in enumerate(lists))).groupBy("query_id", "id").agg(F.min_by("chunk_id", "o").alias("chunk_id"))
    fused = fused.join(chunk, ["query_id", "id"])
    if notes is not None and project is not None:
        fused = fused.join(notes.select("id", (F.col("project") == project).alias("mine")), "id").withColumn("mine", F.coalesce("mine", F.lit(False)))
    else:
        fused = fused.withColumn("mine", F.lit(False))
    if rerank is not None:
        out = rerank(fused.drop("score"), queries, index).filter(F.col("score") >= min_score)
        keys = (F.round(F.col("score") + F.when(F.col("mine"), 0.08).otherwise(0.0), 9).desc(), F.col("id"))
    else:
        out = fused
        keys = (F.round(F.col("score") * F.when(F.col("mine"), 1.3).otherwise(1.0), 12).desc(), F.col("rrf_pos"))
    return top(out, limit, *keys).select("query_id", "id", "chunk_id", "score", "pos")


def allowed_notes(notes: DataFrame, spaces: list[int] | None = None, kinds: list[str] | None = None, tags: list[str] | None = None, project: str | None = None) -> DataFrame:
    """Live notes (status, deleted_h, space_id, kind, tags, project) that a search
    may show: of the spaces and kinds (an empty list or None: any), with all of
    the tags in their exact case, of the project. A search over no space at all
    is an empty one, which the caller asks for with no rows, not an empty list."""
    out = notes.filter("status = 'active' and deleted_h is null")
    for c, values in (("space_id", spaces), ("kind", kinds)):
        if values:
            out = out.filter(F.col(c).isin(*values))
    for t in tags or []:
        out = out.filter(F.array_contains("tags", t))
    return out if not project else out.filter(F.col("project") == project)


def stages(hits: DataFrame, vector_hits: DataFrame | None, rerank: bool) -> DataFrame:
    """What each stage of `recall` did, so that degraded service is visible."""
    n = hits.agg(F.count(F.lit(1)).alias("n"))
    vec = "skipped:none" if vector_hits is None else "ok"
    return n.select(F.lit(vec).alias("vector"), F.lit("ok" if rerank else "skipped:off").alias("rerank"), F.concat(F.lit("ok:"), F.col("n")).alias("hits"))


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Over the queries with relevant ids (query_id, id): n_queries, mean
    recall@k and mean reciprocal rank of ranked (query_id, id, pos)."""
    found = relevant.join(ranked, ["query_id", "id"], "left")
    per = found.groupBy("query_id").agg(F.avg(F.when(F.col("pos") <= k, 1.0).otherwise(0.0)).alias("recall"), F.coalesce(F.max(1.0 / F.col("pos")), F.lit(0.0)).alias("rr"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall_at_k"), F.avg("rr").alias("mrr"))
