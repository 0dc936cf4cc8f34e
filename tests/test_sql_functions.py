from loreforge.functions import sql, text, vectors
from loreforge.operators import chunking
from pyspark.sql import functions as F

TEXTS = ["", None, "  A  b ", "Élan Ñandú đ ø — 2024!", "x" * 200, "a b " * 60, "İstanbul ΣΑΣ ﬁ", "one\n\ntwo " + "word. " * 300]


def test_same_as_the_column_functions(spark):
    sql.register(spark)
    sql.register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    df.createOrReplaceTempView("lf_texts")
    got = {r.i: tuple(r)[1:] for r in spark.sql("SELECT i, lf_est_tokens(t), lf_clip(t, 120), lf_norm_title(t), lf_fts_tokens(t) FROM lf_texts").collect()}
    want = {r.i: tuple(r)[1:] for r in df.select("i", text.est_tokens(F.col("t")), text.clip(F.col("t")), text.norm_title(F.col("t")), text.fts_tokens(F.col("t"))).collect()}
    assert got == want
    chunks = spark.sql("SELECT i, c.ordinal, c.text, c.token_count FROM lf_texts, LATERAL lf_chunk_text(t) c")
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, chunking.chunk(df, "i", "t").collect()))
    v = spark.createDataFrame([(1, [1.0, 2.0], [2.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0])], "i int, a array<double>, b array<double>")
    v.createOrReplaceTempView("lf_vectors")
    assert [tuple(r) for r in spark.sql("SELECT i, round(lf_cosine(a, b), 9) FROM lf_vectors ORDER BY i").collect()] == [tuple(r) for r in v.select("i", F.round(vectors.cosine(F.col("a"), F.col("b")), 9)).orderBy("i").collect()] == [(1, 0.8), (2, 0.0)]
