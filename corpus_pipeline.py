"""The corpus pipeline: documents pass five stages, each working on all that the
one before it kept. Every stage takes (spark, docs, sf_dir) and returns a frame,
which is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.llm.decontaminate import contamination
from loreforge.llm.lines import line_dedup
from loreforge.llm.mixing import mix
from loreforge.llm.near_dup import near_dedup
from loreforge.llm.quality import quality_filter
from loreforge.llm.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that the weighed rules find bad go; so do
    null and empty texts, which fail the base. Rows that repeat are judged each,
    null ids and sources change nothing. An empty table stays empty."""
    return quality_filter(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines, and of lines of 50 words, go; a document that
    loses all goes too. n_chars follows the text. Null texts stay as they are;
    ties between texts of one id are settled by a hash of the text, and rows that
    repeat id and text are one text. An empty table stays empty."""
    # the row travels as one column, so that its names meet none of the result's
    out = line_dedup(docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))).alias("row")))
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    cut = F.col("n_removed") > 0
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies the least doc_id stays, once, also
    where rows repeat. Null texts stay. An empty table stays empty."""
    return near_dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null texts have no words and stay; with an empty
    benchmark all stay. Rows that repeat are judged alike."""
    rows = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(~F.col("contaminated"))
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null and empty texts have
    size 0 and none is taken, a null source is a source of its own, rows that
    repeat are rows of their own. An empty table gives an empty result."""
    return mix(docs)[0].select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("near-dedup", near_copies),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
]

#: EM and near-duplicate classes have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i + 1}")
    return docs
