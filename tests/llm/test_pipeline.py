import corpus_pipeline
import test_decontaminate
import test_lines
import test_near_dup
from loreforge.llm.quality import quality
from pyspark.sql import functions as F


def test_run_against_plain_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in quality(docs).filter("kept").collect()}  # its counts and estimate have tests of their own
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    rows = [(i, t) for i, n, g, t in test_lines.brute(rows) if not (g and g >= n)]
    rows = [(i, t) for (i, t), (_, c) in zip(rows, test_near_dup.brute(rows), strict=True) if i == c]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(i, t) for (i, t), hit in zip(rows, test_decontaminate.brute(rows, bench), strict=True) if not hit[-1]]
    got = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r["size"]) for r in got} == {(i, len(test_near_dup.words(t))) for i, t in rows}
    assert len(got) == len(rows) < len(kept)


def test_stages_keep_columns_and_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, small).dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0


def test_stages_take_nulls_repeats_and_any_names(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    none = docs.limit(3).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")})
    some = docs.unionByName(docs.limit(20)).unionByName(none)
    names = ["__text", "__n_words", "__t1", "__k1", "__n", "n_lines", "n_removed", "kept_text", "n_words", "n_hit", "items", "spans", "contaminated", "row", "k1", "hits"]
    some = some.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, some, small)
        assert got.dtypes == some.dtypes, name
        rows = got.collect()
        assert rows and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, some, small).count() == some.count()
