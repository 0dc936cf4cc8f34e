"""A full-text index that outlives a query and is kept in step with its texts.

An index is a folder of segments, one for each committed batch, and each segment
a few Parquet tables:

* docs: id, doc_len and t (the tokens) of the texts that the batch put in;
* dead: id and segment of the texts that it took out or replaced;
* terms: by bucket of the term, how much each term's number of texts changed,
  and of those put in the greatest tf and the least length;
* postings: by bucket of the term, blocks of up to BLOCK postings of a term with
  the greatest tf and the least length in the block. A term's postings lie in
  falling order of tf, so most of a long list is blocks that say themselves that
  they matter little;
* stats: changes of the number of texts and tokens. Written last: a segment
  without its _SUCCESS mark is none, so a batch that failed is committed anew
  and one that was committed is found.

A search reads the buckets of its own terms only, and of their postings the
blocks that can still bring a text among the best (`StoredIndex.search`). merge
writes what is live as one segment that stands for all before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreforge.functions.text import fts_tokens
from loreforge.operators.search import B, BROADCAST_TERMS, CANDIDATES, K1, STEP, TextIndex, _steps, _term_counts, top
from loreforge.sources.scratch import shared_dir, spread, written

BLOCK = 128
#: A term with more postings than this is laid out by several tasks.
SHARD = 1 << 16
#: Blocks of its strongest terms that a query looks at for its first bound.
SEED_TERMS, SEED_BLOCKS = 8, 2
#: Postings of all queries' terms from which on blocks are skipped; below, finding
#: out which costs more than scoring them.
SKIP_FROM = 200_000_000
#: Scores are compared rounded to nine places; bounds give way by more than that.
SLACK = 1e-6
#: Part of an index's name in `index_of`; raised when the tables change.
LAYOUT = "2"

_BLOCKS = "term string, n int, max_tf int, min_len int, p array<struct<id:{id},doc_len:int,tf:int>>, bucket int"


class StoredIndex:
    """The index under `path`, a folder that the cluster shares. One batch is
    committed at a time. Ids are of one type, `id_type`; a term's bucket is one
    of `buckets`, which stays the same for the life of an index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.id_type = spark, path.rstrip("/"), buckets, id_type

    # ------------------------------------------------------------ segments

    def _marks(self) -> list[tuple[int, str, bool]]:
        """Number, batch and whether it is a merge, of each segment, from one
        listing of the marks."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/stats-*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        folders = [f.getPath().getParent() for f in found or []]
        return sorted((int(p.getName().split("-")[1]), p.getParent().getName()[6:], p.getName().endswith("-merge")) for p in folders)

    def batches(self) -> list[str]:
        """Names of the committed batches, in order."""
        return [b for _, b, _ in self._marks()]

    def _segments(self) -> list[tuple[int, str, bool]]:
        """The last merge and what came after it."""
        marks = self._marks()
        last = max((i for i, (_, _, merge) in enumerate(marks) if merge), default=0)
        return marks[last:]

    def _read(self, table: str, schema: str, segments: list[tuple[int, str, bool]]) -> DataFrame:
        """A table of some segments with seg, the number of the segment."""
        out = None
        for n, b, merge in segments:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/batch-{b}/{table}{f'-{n}' + '-merge' * merge if table == 'stats' else ''}").withColumn("seg", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], f"{schema}, seg int") if out is None else out

    def _docs(self) -> DataFrame:
        return self._read("docs", f"id {self.id_type}, doc_len int, t array<string>", self._segments())

    def _dead(self) -> DataFrame:
        return self._read("dead", f"id {self.id_type}, of int", self._segments()).select("id", F.col("of").alias("seg"))

    def _has_dead(self) -> bool:
        segments = self._segments()
        return len(segments) > 1 and bool(self._dead().limit(1).count())

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Those of rows (id, seg) whose text was not taken out or replaced."""
        return rows.join(self._dead(), ["id", "seg"], "left_anti") if self._has_dead() else rows

    @property
    def tokens(self) -> DataFrame:
        """id, doc_len and t of the live texts."""
        return self._alive(self._docs()).select("id", "doc_len", "t")

    def stats(self) -> DataFrame:
        """n_docs, n_tokens and avgdl of the live texts."""
        rows = self._read("stats", "n_docs long, n_tokens long", self._segments())
        n, m = F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))
        return rows.agg(n.alias("n_docs"), m.alias("n_tokens"), F.try_divide(m, n).alias("avgdl"))

    # ------------------------------------------------------------ changes

    def _bucket(self, term: str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _lay(self, docs: DataFrame, out: str) -> DataFrame:
        """Writes the postings of docs and returns term, n, max_tf and min_len."""
        rows = written(docs.select("id", "doc_len", "t").mapInArrow(_term_counts, f"id {self.id_type}, doc_len int, term string, tf int"), "index-terms")
        counts = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len")), "index-counts")
        long_ = counts.filter(F.col("n") > SHARD).select("term", F.ceil(F.col("n") / SHARD).alias("shards"))
        # how many terms are that long grows slowly with the texts, and is looked at
        long_ = F.broadcast(long_) if long_.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else long_
        rows = rows.join(long_, "term", "left").withColumns({"bucket": self._bucket(), "shard": F.coalesce(F.pmod(F.xxhash64("id"), F.col("shards")), F.lit(0))})
        nth = F.row_number().over(Window.partitionBy("bucket", "term", "shard").orderBy(F.col("tf").desc(), "doc_len", "id")) - 1
        blocks = rows.repartition("bucket", "shard").withColumn("block", F.floor(nth / BLOCK)).groupBy("bucket", "shard", "term", "block")
        blocks = blocks.agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.collect_list(F.struct("id", "doc_len", "tf")).alias("p"))
        blocks.sortWithinPartitions("bucket", "term", "block").select("term", "n", "max_tf", "min_len", "p", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/postings")
        return counts

    def _put_terms(self, counts: DataFrame, out: str) -> None:
        rows = counts.groupBy("term").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len")).withColumn("bucket", self._bucket())
        rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/terms")

    def commit(self, batch_id: str, texts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Puts in texts (id, text), each in the place of the text that the id had,
        and takes out deletes (id); an id in both is put in. Returns whether the
        batch is new: one that was committed does nothing.

        A null text has no tokens. Ids that are not in the index are no error in
        deletes; null ids in deletes mean nothing. A null id, or one id twice, in
        texts is an error: it would be two texts or none. Other columns are
        ignored. An empty batch is committed empty.
        """
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        done = self._marks()
        if batch_id in [b for _, b, _ in done]:
            return False
        number, out = (done[-1][0] + 1 if done else 1), f"{self.path}/batch-{batch_id}"
        fresh = self.spark.createDataFrame([], f"id {self.id_type}, text string") if texts is None else texts.select(F.col("id").cast(self.id_type).alias("id"), F.col("text").alias("text"))
        tokens = spread(fresh).select("id", fts_tokens(F.coalesce("text", F.lit(""))).alias("t")).select("id", F.explode(F.array("t")).alias("t"))
        tokens.select("id", F.size("t").alias("doc_len"), "t").write.mode("overwrite").parquet(f"{out}/docs")
        new = self.spark.read.schema(f"id {self.id_type}, doc_len int, t array<string>").parquet(f"{out}/docs")
        n, ids, some = new.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count("id")).first()
        if not n == ids == some:
            raise ValueError("a batch has each id once")
        leaving = new.select("id") if deletes is None else new.select("id").unionByName(deletes.select(F.col("id").cast(self.id_type).alias("id")).filter("id is not null")).distinct()
        gone = written(self._alive(self._docs()).join(leaving, "id", "left_semi"), "index-gone")
        gone.select("id", F.col("seg").alias("of")).write.mode("overwrite").parquet(f"{out}/dead")
        lost = gone.mapInArrow(_term_counts_of_gone, "term string, n long")
        self._put_terms(self._lay(new, out).unionByName(lost, allowMissingColumns=True), out)
        sums = new.select(F.lit(1).alias("s"), "doc_len").unionByName(gone.select(F.lit(-1).alias("s"), "doc_len"))
        self._seal(sums, f"{out}/stats-{number}")
        return True

    def merge(self, batch_id: str) -> bool:
        """What is live as one segment that stands for all before it. Done again
        under the same name it does nothing."""
        done = self._marks()
        if batch_id in [b for _, b, _ in done]:
            return False
        number, out = (done[-1][0] + 1 if done else 1), f"{self.path}/batch-{batch_id}"
        self.tokens.write.mode("overwrite").parquet(f"{out}/docs")
        live = self.spark.read.schema(f"id {self.id_type}, doc_len int, t array<string>").parquet(f"{out}/docs")
        self.spark.createDataFrame([], f"id {self.id_type}, of int").write.mode("overwrite").parquet(f"{out}/dead")
        self._put_terms(self._lay(live, out), out)
        self._seal(live.select(F.lit(1).alias("s"), "doc_len"), f"{out}/stats-{number}-merge")
        return True

    def _seal(self, rows: DataFrame, out: str) -> None:
        total = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum(F.col("s") * F.col("doc_len")), F.lit(0)).cast("long").alias("n_tokens"))
        total.write.mode("overwrite").parquet(out)

    # ------------------------------------------------------------ search

    def _of(self, table: str, schema: str, words: DataFrame, buckets: list[int]) -> DataFrame:
        """The rows of a table by term that belong to words, from their buckets."""
        rows = self._read(table, schema, self._segments())
        return rows.filter(F.col("bucket").isin(buckets)).join(words, "term", "left_semi")

    def _weighed(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, list[int], Callable, Callable]:
        """Per query and term its weight w, df and ub, the most it can add; the
        words; their buckets; what a posting adds without its weight; and broadcast
        if the terms of all queries are few, else nothing."""
        terms = queries.select("query_id", F.explode(fts_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        # at most `buckets` rows, and one row
        found = terms.groupBy(self._bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        near = F.broadcast if sum(r.n for r in found) <= BROADCAST_TERMS else (lambda x: x)
        buckets, words = [r.b for r in found], near(terms.select("term").distinct())
        n_docs, _, avgdl = self.stats().first()
        adds = lambda tf, size: tf / (tf + K1 * (1 - B + B * size / F.lit(float(avgdl or 1))))
        known = self._of("terms", "term string, n long, max_tf int, min_len int, bucket int", words, buckets)
        df = known.groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len")).filter("df > 0")
        idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        w = F.col("qf") * F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * (K1 + 1)
        weighed = terms.join(near(df), "term").select("query_id", "term", "df", w.alias("w"), (w * adds(F.col("max_tf"), F.col("min_len"))).alias("ub"))
        return written(weighed, "index-weighed"), words, buckets, adds, near

    def search(self, queries: DataFrame, allowed: DataFrame | None = None, limit: int = CANDIDATES, skip_from: int = SKIP_FROM) -> DataFrame:
        """The rows of search.bm25: query_id, id, score, pos.

        Where the queries' terms have under `skip_from` postings in all, each is
        scored. Beyond that blocks are skipped. A query's terms are ranked by the
        most they can add to a score. A text whose highest term has rank i scores
        at most what i adds to it and all lower ranks together, so it can be among
        the best only if its posting of that term lies in a block where this sum
        reaches the bound: the score, so far, of the query's limit-th text in the
        first blocks of its strongest terms. Of the texts found in such blocks,
        those that could still reach the bound with all that was left out are
        looked up there; what a term adds to a text is in one block, so sums are
        exact either way.
        """
        weighed, words, buckets, adds, near = self._weighed(queries)
        blocks = self._of("postings", _BLOCKS.format(id=self.id_type), words, buckets)
        dead, permitted = self._dead() if self._has_dead() else None, None if allowed is None else allowed.select("id").distinct()

        def postings(of: DataFrame, *keep: str) -> DataFrame:
            rows = of.select(*keep, "seg", F.explode("p").alias("x")).select(*keep, "seg", "x.id", adds(F.col("x.tf"), F.col("x.doc_len")).alias("part"))
            if dead is not None:
                rows = rows.join(dead, ["id", "seg"], "left_anti")
            return rows if permitted is None else rows.join(permitted, "id", "left_semi")

        gain = F.sum(F.col("w") * F.col("part"))
        total = weighed.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        if total < skip_from:
            every = postings(blocks, "term").join(near(weighed.select("query_id", "term", "w")), "term")
            return top(every.groupBy("query_id", "id").agg(gain.alias("score")), limit)

        nth = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c)))
        order = Window.partitionBy("query_id").orderBy("ub", "term")
        ranked = weighed.withColumns({"below": F.coalesce(F.sum("ub").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "from_top": nth("ub")})
        blocks = blocks.withColumn("most", adds(F.col("max_tf"), F.col("min_len")))
        strong = ranked.filter(F.col("from_top") <= SEED_TERMS).select("query_id", "term", "w")
        # a term has about a block of each tf at this place or above
        heads = blocks.join(near(strong), "term").withColumn("b", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("most")))).filter(F.col("b") <= SEED_BLOCKS)
        seen = postings(heads, "query_id", "w").groupBy("query_id", "id").agg(gain.alias("s"))
        bound = seen.withColumn("nth", nth("s")).filter(F.col("nth") == limit).select("query_id", F.col("s").alias("bound"))
        ranked = written(ranked.join(near(bound), "query_id", "left").select("query_id", "term", "w", "below", (F.coalesce("bound", F.lit(0.0)) - SLACK).alias("bound")), "index-bounds")

        sides = blocks.join(near(ranked), "term").withColumn("in", F.col("w") * F.col("most") + F.col("below") >= F.col("bound"))
        # what stands in blocks left out can add at most this
        rests = written(sides.filter("not in").groupBy("query_id", "term").agg(F.max(F.col("w") * F.col("most")).alias("rest")), "index-rests")
        whole = rests.groupBy("query_id").agg(F.sum("rest").alias("all_rest"))
        found = postings(sides.filter("in"), "query_id", "term", "w").join(near(rests), ["query_id", "term"], "left")
        texts = found.groupBy("query_id", "id").agg(gain.alias("s"), F.coalesce(F.sum("rest"), F.lit(0.0)).alias("met"), F.collect_list(F.when(F.col("rest").isNotNull(), F.col("term"))).alias("has"))
        texts = texts.join(near(whole), "query_id", "left").withColumn("nth", nth("s"))
        at = F.max(F.when(F.col("nth") == limit, F.col("s"))).over(Window.partitionBy("query_id"))
        open_ = F.coalesce(F.col("all_rest") - F.col("met"), F.lit(0.0))
        texts = written(texts.withColumn("at", F.coalesce(at, F.lit(0.0)) - SLACK).filter(F.col("s") + open_ >= F.col("at")).select("query_id", "id", "s", "has", (open_ > 0).alias("open")), "index-texts")
        asked = texts.filter("open").join(near(rests), "query_id").filter(~F.array_contains("has", F.col("term"))).select("query_id", "id", "term")
        close = F.broadcast if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda x: x)
        held = postings(blocks.join(near(rests.select("term").distinct()), "term", "left_semi"), "term").join(close(asked.select("id", "term").distinct()), ["id", "term"], "left_semi")
        more = asked.join(held.select("id", "term", "part"), ["id", "term"]).join(near(weighed), ["query_id", "term"]).groupBy("query_id", "id").agg(gain.alias("more"))
        return top(texts.join(more, ["query_id", "id"], "left").select("query_id", "id", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("score")), limit)

    def overlap(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """search.overlap_rerank from the postings of the queries' terms alone."""
        terms = queries.select("query_id", F.explode(F.array_distinct(fts_tokens(F.col("query")))).alias("term"))
        size = queries.select("query_id", F.size(F.array_distinct(fts_tokens(F.col("query")))).alias("size"))
        # few rows that took a whole search; they are asked for twice
        hits = written(hits, "index-hits")
        asked = written(hits.join(terms, "query_id", "left").select("query_id", F.col("chunk_id").alias("id"), "term"), "index-asked")
        words = asked.select("term").distinct().filter("term is not null")
        found = asked.filter("term is not null").groupBy(self._bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        near = F.broadcast if sum(r.n for r in found) <= BROADCAST_TERMS else (lambda x: x)
        buckets = [r.b for r in found]
        rows = self._of("postings", _BLOCKS.format(id=self.id_type), near(words), buckets)
        rows = rows.select("term", "seg", F.explode(F.transform("p", lambda x: x["id"])).alias("id")).join(near(asked.select("id", "term").distinct()), ["id", "term"], "left_semi")
        met = asked.join(self._alive(rows), ["id", "term"]).groupBy("query_id", F.col("id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("met"))
        share = F.coalesce(F.try_divide(F.coalesce("met", F.lit(0)), "size"), F.lit(0.0))
        return hits.join(met, ["query_id", "chunk_id"], "left").join(size, "query_id").withColumn("score", share).drop("met", "size")


def _term_counts_of_gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("id", "doc_len", "t")], ["id", "doc_len", "t"])
        for got in _term_counts(iter([keep])):
            yield pa.RecordBatch.from_arrays([got.column(2), pa.array(np.full(len(got), -1, np.int64))], ["term", "n"])


def index_of(spark: SparkSession, files: str, id_col: str, text_col: str) -> StoredIndex:
    """The stored index of a Parquet table, made when it is first asked for and
    found from then on, in the shared folder under a digest of the table's files
    (names, sizes, times), so that a table that was written anew gets a new one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(files)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed, walk = [], fs.listFiles(path, True)
    while walk.hasNext():
        f = walk.next()
        listed.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    name = hashlib.sha256("\n".join([LAYOUT, id_col, text_col, *sorted(listed)]).encode()).hexdigest()[:32]
    table = spark.read.parquet(files)
    index = StoredIndex(spark, f"{shared_dir(spark)}/loreforge/text-{name}", id_type=dict(table.dtypes)[id_col])
    index.commit("load", table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return index


__all__ = ["STEP", "StoredIndex", "TextIndex", "_steps", "index_of"]
