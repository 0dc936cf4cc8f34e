"""Columns of a table may have any names, those that operators use inside too."""

import pytest
from loreforge.llm.audit import filter_audit
from loreforge.llm.centroids import cluster_vectors
from loreforge.llm.decontaminate import contamination
from loreforge.llm.lines import line_dedup
from loreforge.llm.mixing import mix
from loreforge.llm.near_dup import near_dedup, near_duplicates
from loreforge.llm.packing import pack
from loreforge.llm.quality import quality, quality_filter
from loreforge.llm.substring import substring_dedup
from pyspark.sql import functions as F

NAMES = ["__text", "__n_words", "__t1", "__t2", "__id", "__i", "__k1", "__k2", "__n", "__lines", "__late", "__class", "__none", "k1", "k2", "h", "id", "t1", "rid", "column_0", "column_9", "part", "digest", "c", "v", "key", "source", "lang", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    body = " ".join(f"word{i} is here." for i in range(120))
    rows = [(1, body), (2, body + " tail"), (3, "one\ntwo\nthree\none\ntwo"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def test_rows_come_back_whole(spark, docs):
    bench = spark.createDataFrame([("a", "word1 is here. word2 is here.")], "item_id string, text string")
    for got in (quality_filter(docs), line_dedup(docs), near_dedup(docs), contamination(docs, bench)):
        assert got.columns[: len(docs.columns)] == docs.columns
        kept = got.collect()
        assert kept
        for r in kept:
            assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)
    assert {r.doc_id: r.n_removed for r in line_dedup(docs).collect()}[3] == 2
    assert {r.doc_id: r.n_hit > 0 for r in contamination(docs, bench).collect()}[1]


def test_others_read_their_own_columns(spark, docs):
    for run in (quality, near_duplicates, substring_dedup, lambda d: mix(d)[0], lambda d: pack(d)[0]):
        got = run(docs)
        got = got[0] if isinstance(got, tuple) else got
        assert {r.doc_id for r in got.select("doc_id").collect()} == {1, 2, 3, 4, 5}
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), *NAMES)
    assert filter_audit(docs, labels).filter("filter_order = 'ABCDE' and step = 1").agg(F.sum(F.col("kept") + F.col("removed"))).first()[0] == 5
    vectors = docs.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(*(F.lit(float(i)) for i in range(64)))})
    assert cluster_vectors(vectors)[0].count() == 5
