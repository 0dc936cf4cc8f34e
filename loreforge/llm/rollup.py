"""Token counts by source, language and tokenizer version, kept up to date by
deltas.

A batch of changes inserts, deletes and revises documents. It becomes signed
rows: what a document counted before leaves its group, what it counts now enters
its new one. Totals are a small table that each commit makes from the one before
it and the sums of its own rows, so nothing is recounted; what a document counted
before is looked up for the documents of the batch alone.

A batch has a folder of its own name, with its rows and, in a folder that has
the commit's number, the new totals. It counts once the _SUCCESS mark of the
totals stands, which Spark's committer writes last. Committing a batch again
finds the mark and does nothing; one that failed half-way has no mark and is
written anew.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.sources.scratch import spread

from .storage import shared_path, written


@dataclass(frozen=True)
class Tokenizer:
    """A public tokenizer file and the version its counts are filed under. kind
    is tiktoken, tokenizers or sentencepiece; path names a file that every
    executor can read, or, without a slash, one of the public_tokenizers."""

    version: str
    kind: str
    path: str

    def counter(self):
        path = self.path
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        if self.kind == "tiktoken":
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda text: len(enc.encode_ordinary(text))
        if self.kind == "tokenizers":
            from tokenizers import Tokenizer as Tok

            tok = Tok.from_file(path)
            tok.encode_special_tokens = True
            return lambda text: len(tok.encode(text, add_special_tokens=False).ids)
        if self.kind == "sentencepiece":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda text: len(sp.encode(text, num_threads=1))
        raise ValueError(f"no tokenizer of kind {self.kind!r}")


BYTES_50K = Tokenizer("byte_bpe_50k", "tiktoken", "byte_bpe_50k.tiktoken")
MULTI_50K = Tokenizer("byte_bpe_multi_50k", "tiktoken", "byte_bpe_multi_50k.tiktoken")
#: The counters a Python worker has loaded.
_loaded: dict[Tokenizer, object] = {}

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "doc_id string, source string, lang string, tokenizer string, docs long, tokens long"
#: After so many commits what stands is written whole, so that a commit looks
#: documents up in one such table and at most as many batches, not in all history.
COMPACT = 16
_TOTAL = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _count(tokenizers: tuple[Tokenizer, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokenizers:
            if t not in _loaded:
                _loaded[t] = t.counter()
        for batch in batches:
            counts = [_loaded[t] for t in tokenizers]
            n = [[count(x) if x else 0 for count in counts] for x in (text.as_py() for text in batch.column("text"))]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n, pa.list_(pa.int64()))], [*rest, "n"])

    return run


def token_counts(docs: DataFrame, tokenizers: tuple[Tokenizer, ...] = (BYTES_50K,)) -> DataFrame:
    """The columns of docs but text, and n: the tokens of the text under each
    tokenizer, in their order; a null text has none."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(_count(tuple(tokenizers)), f"{kinds}, n array<long>")


class TokenRollup:
    """Totals under `path`, a folder that the cluster shares. One batch is
    committed at a time."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: tuple[Tokenizer, ...] = (BYTES_50K,)):
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), tuple(tokenizers)

    def _commits(self) -> list[tuple[int, str]]:
        """Number and batch of each commit, from one listing of the marks."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/totals-*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        folders = [f.getPath().getParent() for f in found or []]
        return sorted((int(p.getName()[7:]), p.getParent().getName()[6:]) for p in folders)

    def committed(self) -> list[str]:
        """Names of the committed batches, in order."""
        return [b for _, b in self._commits()]

    def ledger(self) -> DataFrame:
        """The signed rows of all committed batches."""
        paths = [f"{self.path}/batch-{b}/rows" for b in self.committed()]
        return self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)

    def _recent(self) -> DataFrame:
        """Rows that sum up to what each document with an id counts now: the last
        whole table and the batches after it."""
        done = self._commits()
        whole = max((n for n, _ in done if n % COMPACT == 0), default=0)
        paths = [f"{self.path}/batch-{b}/rows" for n, b in done if n > whole] + [f"{self.path}/batch-{b}/standing" for n, b in done if n == whole]
        return self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)

    def standing(self, of: DataFrame | None = None) -> DataFrame:
        """What each document with an id counts now; with `of` (column t: ids),
        only those, and only their rows are shuffled."""
        rows = self._recent().filter("doc_id is not null")
        if of is not None:
            rows = rows.join(of, F.col("doc_id") == F.col("t"), "left_semi")
        return rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the groups with documents:
        the last commit's table."""
        last = self._commits()[-1:]
        if not last:
            return self.spark.createDataFrame([], _TOTAL)
        return self.spark.read.schema(_TOTAL).parquet(f"{self.path}/batch-{last[0][1]}/totals-{last[0][0]}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch: doc_id, source, lang, text and op (insert, revise or
        delete), with seq if a document may have several changes; the one with
        the greatest seq counts, ties go to the greater op and then to the
        greater counts, source and language. Returns whether the batch is new.

        Inserting a document that stands, or revising one that does not, leaves
        it standing once as given; deleting one that does not stand changes
        nothing. Ids are of any type and are told apart by their text. A row
        without an id is a document of its own: inserts and revisions each count
        once and for good, deletions change nothing. Null sources and languages
        are groups of their own; a null text counts 0 tokens. An unknown op is an
        error. Other columns are ignored. An empty batch is committed empty.
        """
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        done = self._commits()
        if batch_id in [b for _, b in done]:
            return False
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        op = F.when(F.col("op").isin("insert", "revise", "delete"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
        text = F.when(F.col("op") != "delete", F.col("text")).alias("text")
        # texts are counted where they are read, and once: what follows reads their counts twice
        given = spread(changes.select(F.col("doc_id").cast("string").alias("doc_id"), seq.alias("seq"), op.alias("op"), "source", "lang", text))
        rows = written(token_counts(given, self.tokenizers), "op3-counts")
        last = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("seq", "op", "n", "source", "lang")).alias("last")).select("doc_id", "last.*")
        # asked for twice: for what it adds and for what its documents counted before
        last = written(last.unionByName(rows.filter("doc_id is null").select(*last.columns)), "op3-changes")
        names = F.array(*(F.lit(t.version) for t in self.tokenizers))
        plus = last.filter("op <> 'delete'").select("doc_id", "source", "lang", F.explode(F.arrays_zip(names.alias("tokenizer"), F.col("n").alias("tokens"))).alias("c"))
        plus = plus.select("doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("docs"), "c.tokens")
        old = self.standing(last.filter("doc_id is not null").select(F.col("doc_id").alias("t")))
        minus = old.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        out = f"{self.path}/batch-{batch_id}"
        plus.unionByName(minus).write.mode("overwrite").parquet(f"{out}/rows")
        added = self.spark.read.schema(_DELTA).parquet(f"{out}/rows").groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        new = self.totals().unionByName(added).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0")
        number = done[-1][0] + 1 if done else 1
        if number % COMPACT == 0:
            rows = self._recent().unionByName(self.spark.read.schema(_DELTA).parquet(f"{out}/rows")).filter("doc_id is not null")
            whole = rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")
            whole.select("doc_id", *KEYS, "docs", "tokens").write.mode("overwrite").parquet(f"{out}/standing")
        new.write.mode("overwrite").parquet(f"{out}/totals-{number}")
        return True


def op3_token_rollup(spark, sf_dir: str) -> DataFrame:
    """All documents are loaded as one batch, sent twice as after a lost reply. A
    second batch revises every text that changes when its runs of white space
    become one space each; a third deletes the copies of texts with a lesser
    doc_id (null texts are no copies of one another)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    rollup = TokenRollup(spark, shared_path(spark, "op3-rollup"), (BYTES_50K, MULTI_50K))
    rollup.commit("load", docs.withColumn("op", F.lit("insert")))
    rollup.commit("load", docs.withColumn("op", F.lit("insert")))
    clean = docs.withColumn("clean", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("clean <> text")
    rollup.commit("clean", clean.select("doc_id", "source", "lang", F.col("clean").alias("text"), F.lit("revise").alias("op")))
    keyed = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(17), "text").alias("t2"))
    # read from a table, so that Spark can split the rows of a hot text in the join
    first = written(keyed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "op3-copied")
    none = F.lit(None).cast("string")
    copies = keyed.join(first, ["t1", "t2"]).filter("doc_id > first")
    rollup.commit("copies", copies.select("doc_id", none.alias("source"), none.alias("lang"), none.alias("text"), F.lit("delete").alias("op")))
    return rollup.totals()
