import random

import pytest
from loreforge.operators import search
from loreforge.operators import textindex as T
from loreforge.operators.textindex import StoredIndex, index_of
from loreforge.sources.scratch import shared_path
from pyspark.sql import functions as F

WORDS = ["alpha", "beta", "Gamma", "délta", "eta", "theta", "the", "of", "2024", "x1"]


def texts(rng, n):
    return [rng.choice([None, "", " ".join(rng.choice(WORDS[: rng.randint(2, 10)]) for _ in range(rng.randint(1, 30)))]) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def rows(df):
    return {(r.query_id, r.id, round(r.score, 6), r.pos) for r in df.collect()}


@pytest.fixture(scope="module")
def asked(spark):
    qs = [(0, "alpha beta"), (1, "the of the"), (2, "délta 2024 x1 eta"), (3, ""), (4, None), (5, "nowhere"), (6, "Gamma theta alpha the the")]
    return spark.createDataFrame(qs, "query_id long, query string")


def same(spark, index, docs, asked, allowed=None):
    plain = search.TextIndex.build(frame(spark, list(docs.items())))
    want = rows(search.bm25(plain, asked, allowed, 5))
    assert rows(index.search(asked, allowed, 5)) == want
    assert rows(index.search(asked, allowed, 5, skip_from=0)) == want
    a, b = index.stats().first(), plain.stats().first()
    assert (a.n_docs, a.n_tokens or 0) == (b.n_docs, b.n_tokens or 0)
    hits = frame(spark, [(i, None) for i in docs]).select(F.col("id").alias("chunk_id")).crossJoin(asked.select("query_id"))
    score = lambda df: {(r.query_id, r.chunk_id, r.score) for r in df.collect()}
    assert score(index.overlap(hits, asked)) == score(search.overlap_rerank(hits, asked, plain))


def test_kept_in_step(spark, asked, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "SHARD", 16)
    rng = random.Random(3)
    index = StoredIndex(spark, shared_path(spark, "test-index"), buckets=4)
    docs = dict(enumerate(texts(rng, 120)))
    assert index.commit("a", frame(spark, list(docs.items())))
    same(spark, index, docs, asked)
    new = {i: t for i, t in zip([5, 6, 7, *range(200, 230)], texts(rng, 33), strict=True)}
    gone = [*range(20, 40), 5, 9999, None]
    assert index.commit("b", frame(spark, list(new.items())), frame(spark, [(i, None) for i in gone]).select("id"))
    docs = {i: t for i, t in docs.items() if i not in gone} | new
    same(spark, index, docs, asked)
    assert not index.commit("b", frame(spark, [(1, "alpha")]))
    allowed = frame(spark, [(i, None) for i in docs if i % 2]).select("id")
    same(spark, index, docs, asked, allowed)
    assert index.merge("m") and not index.merge("m")
    same(spark, index, docs, asked)
    assert index.commit("c", frame(spark, [(21, "alpha alpha beta")]), frame(spark, [(200, None)]).select("id"))
    del docs[200]
    docs[21] = "alpha alpha beta"
    same(spark, index, docs, asked)
    assert index.batches() == ["a", "b", "m", "c"]


def test_a_batch_that_failed_is_none(spark, asked):
    path = shared_path(spark, "test-index")
    index = StoredIndex(spark, path)
    index.commit("a", frame(spark, [(1, "alpha"), (2, "beta")]))
    index.commit("b", frame(spark, [(3, "alpha")]), frame(spark, [(1, None)]).select("id"))
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-b/stats-2/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
    assert index.batches() == ["a"]
    same(spark, index, {1: "alpha", 2: "beta"}, asked)
    assert index.commit("b", frame(spark, [(3, "alpha")]), frame(spark, [(1, None)]).select("id"))
    same(spark, index, {3: "alpha", 2: "beta"}, asked)


def test_empty_index_and_bad_batches(spark, asked):
    index = StoredIndex(spark, shared_path(spark, "test-index"))
    assert index.search(asked).count() == 0 and index.stats().first().n_docs == 0
    assert index.commit("none") and index.search(asked).count() == 0
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="once"):
            index.commit("bad", frame(spark, bad))
    with pytest.raises(ValueError):
        index.commit("../x")
    assert index.batches() == ["none"]


def test_search_reads_only_its_buckets_and_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    index = StoredIndex(spark, shared_path(spark, "test-index"), buckets=64)
    docs = [(i, "the " * (1 + i % 7) + ("rare " * 3 if i % 40 == 0 else "") + f"word{i}") for i in range(800)]
    index.commit("a", frame(spark, docs))
    q = spark.createDataFrame([(1, "rare the")], "query_id long, query string")
    words = q.select(F.explode(F.split("query", " ")).alias("term"))
    buckets = [r.b for r in words.select(index._bucket().alias("b")).collect()]
    plan = index._of("postings", T._BLOCKS.format(id="bigint"), F.broadcast(words), buckets)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    kept = []
    real = T.written
    monkeypatch.setattr(T, "written", lambda df, what: kept.append((what, real(df, what))) or kept[-1][1])
    got = rows(index.search(q, limit=5, skip_from=0))
    assert got == rows(search.bm25(search.TextIndex.build(frame(spark, docs)), q, limit=5))
    found = dict(kept)
    assert found["index-rests"].filter("term = 'the'").count() == 1  # blocks of the common word were left out
    assert found["index-texts"].count() < 100


def test_index_of_a_table_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    frame(spark, [(1, "alpha")]).write.parquet(path)
    one = index_of(spark, path, "id", "text")
    assert index_of(spark, path, "id", "text").path == one.path and one.batches() == ["load"]
    frame(spark, [(2, "alpha beta")]).write.mode("append").parquet(path)
    two = index_of(spark, path, "id", "text")
    assert two.path != one.path and two.stats().first().n_docs == 2
