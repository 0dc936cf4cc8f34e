"""What a Python worker holds does not grow with the batches that Spark sends it."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from loreforge.operators import search
from loreforge.operators import textindex as T
from loreforge.sources import documents
from pyspark.sql import functions as F


def test_tokens_are_counted_a_few_texts_at_a_time():
    rng = np.random.default_rng(1)
    texts = [[f"w{x}" for x in rng.integers(0, 90, n)] for n in [0, 3, 2 * T.STEP, 0, *rng.integers(0, 400, 4000)]]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([len(t) for t in texts], pa.int32()), pa.array(texts, pa.list_(pa.string()))], ["id", "doc_len", "t"])
    batch = whole.slice(1)
    parts = list(T._steps(batch))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert all(p.num_rows == 1 or sum(len(t) for t in p["t"]) <= T.STEP for p in parts)
    got = list(T._term_counts(iter([batch])))
    assert len(got) >= 4
    rows = {(r["id"], r["term"]): (r["doc_len"], r["tf"]) for b in got for r in b.to_pylist()}
    assert rows == {(i, w): (len(texts[i]), n) for i in range(1, len(texts)) for w, n in Counter(texts[i]).items()}


def test_pages_are_parsed_a_few_at_a_time(spark):
    n = 3 * documents.PAGES + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([None, *(f"<p>text {i}</p>" for i in range(1, n))])], ["page_id", "html"])
    got = list(documents._html_texts(iter([batch])))
    assert [b.num_rows for b in got] == [documents.PAGES] * 3 + [1]
    assert [r for b in got for r in b.to_pylist()] == [{"page_id": i, "text": f"text {i}" if i else ""} for i in range(n)]
    rows = spark.createDataFrame([("a", "<p>x</p>"), (None, None)], "k string, h string")
    assert {tuple(r) for r in documents.parse_html(rows, "k", "h").collect()} == {("a", "x"), (None, "")}


def test_scores_of_few_queries_are_held():
    rng = np.random.default_rng(2)
    one = lambda n, at: [{"id": i + at, "vec": list(x)} for i, x in enumerate(rng.normal(size=(n, 8)))]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("vec", pa.list_(pa.float64()))]))
    q, v = one(512, 0), one(2048, 500)
    batch = pa.RecordBatch.from_arrays([pa.array([q], kind), pa.array([v], kind)], ["q", "v"])
    tracemalloc.start()
    got = list(search._block_topk(3, True)(iter([batch])))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 16e6
    unit = lambda rows: (m := np.array([r["vec"] for r in rows])) / np.linalg.norm(m, axis=1)[:, None]
    sim = unit(q) @ unit(v).T
    sim[np.arange(512)[:, None] == np.arange(500, 2548)[None]] = -np.inf
    best = np.argsort(-sim, axis=1)[:, :3] + 500
    rows = [(r["query_id"], r["id"]) for b in got for r in b.to_pylist()]
    assert rows == [(i, int(x)) for i in range(512) for x in best[i]]


def test_postings_and_passages_without_a_shuffle_of_texts(spark, monkeypatch):
    from loreforge.plans import registry

    rows = [(1, "The cat sat on the mat"), (2, "a cat, the catalogue"), (3, None), (4, ""), (5, "Zoë sat on the mat again")]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = search.TextIndex.build(docs)
    post = index.postings()
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.doc_len, r.term): r.tf for r in post.filter("id < 3").collect()} == {
        (1, 6, "the"): 2, (1, 6, "cat"): 1, (1, 6, "sat"): 1, (1, 6, "on"): 1, (1, 6, "mat"): 1, (2, 4, "a"): 1, (2, 4, "cat"): 1, (2, 4, "the"): 1, (2, 4, "catalogue"): 1}
    words = spark.createDataFrame([("the",), ("zoe",), ("none",)], "term string")
    assert {(r.term, r.df) for r in index.containing(words).collect()} == {("the", 3), ("zoe", 1)}
    q = spark.createDataFrame([(7, "sat on the mat"), (8, "at on th"), (9, "cat, the cat"), (10, "on the mat sat")], "query_id long, query string")
    rare = spark.createDataFrame([(7, "on"), (8, "on"), (9, "the"), (10, "the")], "query_id long, term string")
    want = {(7, 1), (7, 5), (8, 1), (8, 5), (9, 2)}
    one = registry._passages(docs, index, rare, q)
    assert {tuple(r) for r in one.collect()} == want
    assert "hashpartitioning(id" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert {tuple(r) for r in registry._passages(docs, index, rare, q).collect()} == want


def test_a_stored_vector_is_made_once_a_row(spark):
    from loreforge.functions import vectors

    rows = spark.createDataFrame([([float(x) for x in range(64)], 1), ([0.0] * 64, 2), (None, 3)], "v array<double>, id int")
    made = spark.sparkContext.accumulator(0)

    @F.udf("struct<q:array<tinyint>,scale:double>")
    def stored(v):
        made.add(1)
        return None if v is None else ([int(x) for x in v], 0.5)

    got = {r.id: r.w for r in rows.select("id", vectors.dequantise(stored("v")).alias("w")).collect()}
    assert got == {1: [x / 2 for x in range(64)], 2: [0.0] * 64, 3: None} and made.value == 3
    z = vectors.quantise(F.col("v"))
    plan = rows.select(vectors.dequantise(z).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max") == 1
