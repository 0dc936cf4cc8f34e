"""Queries over the driver's tables, each with the same question in DuckDB's SQL
where SQL can say it. The memory tables are derived as in sources.adapters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreforge.functions import dates, text, vectors
from loreforge.operators import chunking, reports, search, state, textindex, transcripts
from loreforge.sources import documents, sinks
from loreforge.sources.adapters import cte, load
from loreforge.sources.scratch import spread, written
from loreforge.streaming import capture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2001-06-01 12:00:00"
#: The same moment in the hours of notes.
NOW_H = 9000
_AT = "TIMESTAMP '2024-01-15 00:00:00'"
_TOKENS = "regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


def _fill(sql: str, **parts) -> str:
    """SQL with its {names} filled in; other braces stay."""
    for k, v in parts.items():
        sql = sql.replace("{" + k + "}", str(v))
    return sql


def _tokens(c: str) -> str:
    return _TOKENS.format(c=c)


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _docs(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _index(spark, sf):
    """The stored index of the documents: made by the first query that asks for
    it, read by those after it."""
    return textindex.index_of(spark, f"{sf}/documents.parquet", "doc_id", "text")


def _queries(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _live(notes):
    return notes.filter("status = 'active' and deleted_h is null")


# ---------------------------------------------------------------- full text

_BM25 = f"""
dt AS MATERIALIZED (SELECT doc_id AS id, {_tokens('text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM dt),
post AS MATERIALIZED (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, greatest(ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)), 0) AS w FROM post, st GROUP BY term),
bm AS (
  SELECT query_id, id, sum(qf * CASE WHEN w > 0 THEN w ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))) AS score
  FROM qt JOIN df USING (term) JOIN post USING (term), st {{where}} GROUP BY ALL
),
bmr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM bm QUALIFY pos <= {{n}})
"""


@query(f"SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens, round(avg(len(t)), 6) AS avgdl FROM (SELECT {_tokens('text')} AS t FROM documents)")
def fts_corpus_stats(spark, sf):
    return search.TextIndex.build(_docs(spark, sf), store=False).stats().withColumn("avgdl", F.round("avgdl", 6))


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def fts_term_stats(spark, sf):
    return search.TextIndex.build(_docs(spark, sf), store=False).postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("WITH " + _fill(_BM25, where="", n=10) + " SELECT query_id, id, round(score, 6) AS score, pos FROM bmr")
def fts_bm25_topk(spark, sf):
    return search.bm25(_index(spark, sf), _queries(spark, sf), limit=10).withColumn("score", F.round("score", 6))


@query(cte("notes") + ", " + _fill(_BM25, where="WHERE id IN (SELECT id FROM notes WHERE status = 'active' AND deleted_h IS NULL AND space_id IN (1, 2) AND kind IN ('note', 'fact', 'decision') AND lang = 'en')", n=10) + " SELECT query_id, id, round(score, 6) AS score, pos FROM bmr")
def fts_filtered_topk(spark, sf):
    notes = load(spark, sf, "notes").withColumn("tags", F.array("lang", "tag2"))
    allowed = search.allowed_notes(notes, spaces=[1, 2], kinds=["note", "fact", "decision"], tags=["en"])
    return search.bm25(_index(spark, sf), _queries(spark, sf), allowed, 10).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- vectors


def _vectors(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _vector_hits(spark, sf, n):
    v = _vectors(spark, sf)
    return search.vector_topk(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), n, exclude_self=True)


_VEC = """
ev AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
vs AS (SELECT q.id AS query_id, e.id, list_cosine_similarity(q.v, e.v) AS score FROM ev q JOIN ev e ON q.id <> e.id WHERE q.id % 20 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM vs QUALIFY pos <= {n})
"""


@query("WITH " + _fill(_VEC, n=10) + " SELECT query_id, id, round(score, 6) AS score, pos FROM vr")
def vector_topk(spark, sf):
    return _vector_hits(spark, sf, 10).withColumn("score", F.round("score", 6))


_QUANT = """
nv AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
qv AS (SELECT id, u, list_max(list_transform(u, lambda x: abs(x))) / 127 AS scale FROM nv),
iv AS (SELECT id, u, scale, list_transform(u, lambda x: round(x / scale)::INT) AS q FROM qv)
"""


@query("WITH " + _QUANT + " SELECT id, round(scale, 9) AS scale, list_sum(q)::BIGINT AS q_sum, list_max(q)::BIGINT AS q_max, len(q)::BIGINT AS dim FROM iv")
def vector_quantise(spark, sf):
    q = _vectors(spark, sf).select("id", vectors.quantise(F.col("vec")).alias("z"))
    whole = F.aggregate("z.q", F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("id", F.round("z.scale", 9).alias("scale"), whole.alias("q_sum"), F.array_max("z.q").cast("long").alias("q_max"), F.size("z.q").cast("long").alias("dim"))


@query("WITH " + _QUANT + " SELECT id, round(abs(1 - scale * list_sum(list_transform(list_zip(q, u), lambda z: z[1] * z[2]))), 9) AS error FROM iv")
def vector_int8_error(spark, sf):
    """How far the product of each vector with its stored form is from 1."""
    q = _vectors(spark, sf).select("id", vectors.unit(F.col("vec")).alias("u"), vectors.quantise(F.col("vec")).alias("z"))
    return q.select("id", F.round(F.abs(1 - F.col("z.scale") * vectors.dot(F.col("z.q"), F.col("u"))), 9).alias("error"))


@query("WITH " + _QUANT + ", qs AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.u, b.q::DOUBLE[]) AS score FROM iv a JOIN iv b ON a.id <> b.id WHERE a.id % 20 = 0) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM qs QUALIFY pos <= 10")
def vector_int8_topk(spark, sf):
    """The search as it runs on stored vectors: exact queries against int8 ones."""
    v = _vectors(spark, sf)
    stored = v.select("id", vectors.dequantise(vectors.quantise(F.col("vec"))).alias("vec"))
    return search.vector_topk(stored, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, exclude_self=True).withColumn("score", F.round("score", 6))


@query("WITH d AS (SELECT doc_id FROM documents) SELECT doc_id AS id FROM d WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf):
    return _docs(spark, sf).select("id").join(_vectors(spark, sf).select("id"), "id", "left_anti")


# ---------------------------------------------------------------- hybrid


def _query_vectors(spark, sf):
    """Vector hits of each passage: those of the vector that has its number."""
    v = _vectors(spark, sf)
    q = v.join(_queries(spark, sf).select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    # vectors of chunks that are not in the index are no hits
    return search.vector_topk(v.join(_docs(spark, sf).select("id"), "id", "left_semi"), q, 50)


_INDEXED = "AND e.id IN (SELECT doc_id FROM documents)"
_HYBRID = (
    _BM25
    + """,
ev AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
vs AS (SELECT q.id AS query_id, e.id, list_cosine_similarity(q.v, e.v) AS score FROM ev q CROSS JOIN ev e WHERE q.id IN (SELECT item_id FROM benchmark) {vwhere}),
vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM vs QUALIFY pos <= 50),
fu AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + pos)) AS score FROM (SELECT query_id, id, pos FROM bmr UNION ALL SELECT query_id, id, pos FROM vr) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rrf_pos FROM fu QUALIFY rrf_pos <= 20)
"""
)


@query("WITH " + _fill(_HYBRID, where="", n=50, vwhere=_INDEXED) + " SELECT query_id, id, round(score, 9) AS score, rrf_pos AS pos FROM fr")
def rrf_fusion(spark, sf):
    lex = search.bm25(_index(spark, sf), _queries(spark, sf))
    return search.rrf(lex, _query_vectors(spark, sf)).withColumn("score", F.round("score", 9))


_RERANK = f"""
qd AS (SELECT item_id AS query_id, list_distinct({_tokens('text')}) AS q FROM benchmark),
rr AS (
  SELECT fr.query_id, fr.id, rrf_pos, len(list_intersect(q, list_distinct(t)))::DOUBLE / len(q) AS score FROM fr JOIN qd USING (query_id) JOIN dt USING (id)
)
"""


@query("WITH " + _fill(_HYBRID, where="", n=50, vwhere=_INDEXED) + "," + _RERANK + " SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM rr WHERE score >= 0.2 QUALIFY pos <= 5")
def recall_hybrid(spark, sf):
    hits = search.recall(_index(spark, sf), _queries(spark, sf), [_query_vectors(spark, sf)])
    return hits.drop("chunk_id").withColumn("score", F.round("score", 6))


_NOTE_FILTER = "id IN (SELECT id FROM notes WHERE status = 'active' AND deleted_h IS NULL AND space_id = 1)"


@query(
    cte("notes")
    + ", "
    + _fill(_HYBRID, where="WHERE " + _NOTE_FILTER, n=50, vwhere="AND e.id IN (SELECT id FROM notes WHERE status = 'active' AND deleted_h IS NULL AND space_id = 1)")
    + " SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score * CASE WHEN project = 'src0' THEN 1.3 ELSE 1 END, 12) DESC, rrf_pos) AS pos FROM fr JOIN (SELECT id, project FROM notes) USING (id) QUALIFY pos <= 5"
)
def recall_project_boost(spark, sf):
    notes = _live(load(spark, sf, "notes")).filter("space_id = 1")
    v = _vectors(spark, sf).join(notes.select("id"), "id", "left_semi")
    q = _vectors(spark, sf).join(_queries(spark, sf).select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    hits = search.vector_topk(v, q, 50)
    got = search.recall(_index(spark, sf), _queries(spark, sf), [hits], notes=notes, project="src0", rerank=None)
    return got.drop("chunk_id").withColumn("score", F.round("score", 9))


def _near(rows):
    """Broadcast if the rows (of terms of queries) are few."""
    return F.broadcast(rows) if rows.limit(search.BROADCAST_TERMS + 1).count() <= search.BROADCAST_TERMS else rows


def _passages(docs, index, rare, q):
    """query_id and id of the texts that have a passage's term in rare (query_id,
    term) and hold the passage. Texts are compared as they are read, where the
    passages are few enough to come to them; else by joins."""
    if rare.limit(search.BROADCAST_TERMS + 1).count() > search.BROADCAST_TERMS:
        found = index.postings(rare.select("term").distinct()).join(rare, "term").select("query_id", "id").join(q, "query_id").join(docs, "id")
        return found.filter(F.contains("text", F.col("query"))).select("query_id", "id")
    words = F.broadcast(rare.agg(F.collect_set("term").alias("words")))
    met = docs.crossJoin(words).select("id", "text", F.explode(F.array_intersect(text.fts_tokens(F.col("text")), F.col("words"))).alias("term"))
    return met.join(F.broadcast(rare.join(q, "query_id")), "term").filter(F.contains("text", F.col("query"))).select("query_id", "id")


@query("WITH " + _fill(_BM25, where="", n=50) + ", rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''), per AS (SELECT query_id, avg(CASE WHEN pos <= 10 THEN 1.0 ELSE 0 END) AS recall, coalesce(max(1.0 / pos), 0) AS rr FROM rel LEFT JOIN bmr USING (query_id, id) GROUP BY query_id) SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall_at_k, round(avg(rr), 6) AS mrr FROM per")
def recall_eval_at10(spark, sf):
    docs, q = _docs(spark, sf), _queries(spark, sf)
    index = search.TextIndex.build(docs)
    ranked = search.bm25(index, q, limit=50)
    # a passage stands in a text only with all its tokens but the first and the last, which may be parts of the
    # text's: only texts that share the rarest of the others are compared; passages without others with all texts
    t = text.fts_tokens(F.col("query"))
    inner = q.filter("query <> ''").select("query_id", F.explode(F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0)))).alias("term"))
    df = index.containing(_near(inner.select("term").distinct()))
    rare = inner.join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("m")).select("query_id", F.col("m.term").alias("term"))
    near = _passages(docs, index, written(rare, "eval-rare"), q)
    # such passages are one or two words, and few: a stated query set
    short = F.broadcast(q.filter("query <> ''").join(inner.select("query_id").distinct(), "query_id", "left_anti"))
    rest = docs.join(short, F.contains("text", F.col("query"))).select("query_id", "id")
    return search.evaluate(ranked, near.unionByName(rest)).withColumns({"recall_at_k": F.round("recall_at_k", 6), "mrr": F.round("mrr", 6)})


# ---------------------------------------------------------------- recall of notes with several chunks

#: A note is the texts of one source and language; its chunks are the documents.
_OWNER = "SELECT dense_rank() OVER (ORDER BY source, lang) AS note_id, doc_id AS id FROM documents"


@query(
    "WITH "
    + _fill(_HYBRID.split("fu AS (")[0].rstrip().rstrip(","), where="", n=50, vwhere=_INDEXED)
    + f""", ow AS ({_OWNER}),
cl AS (SELECT query_id, note_id, min(pos) AS p, arg_min(id, pos) AS chunk_id FROM bmr JOIN ow USING (id) GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pos FROM cl),
cv AS (SELECT query_id, note_id, min(pos) AS p, arg_min(id, pos) AS chunk_id FROM vr JOIN ow USING (id) GROUP BY ALL),
vx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pos FROM cv),
fu AS (SELECT query_id, note_id, sum(1.0::DOUBLE / (60 + pos)) AS score, arg_min(chunk_id, o) AS chunk_id FROM (SELECT query_id, note_id, pos, chunk_id, 0 AS o FROM lx UNION ALL SELECT query_id, note_id, pos, chunk_id, 1 FROM vx) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, note_id) AS rrf_pos FROM fu QUALIFY rrf_pos <= 20),
qd AS (SELECT item_id AS query_id, list_distinct({_tokens('text')}) AS q FROM benchmark),
rr AS (SELECT fr.query_id, note_id AS id, chunk_id, len(list_intersect(q, list_distinct(t)))::DOUBLE / len(q) AS score FROM fr JOIN qd USING (query_id) JOIN dt ON dt.id = chunk_id)
SELECT query_id, id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM rr WHERE score >= 0.2 QUALIFY pos <= 5"""
)
def recall_notes(spark, sf):
    """Recall where notes have many chunks: each note takes one place."""
    d = load(spark, sf, "documents").select("doc_id", "source", "lang")
    notes = d.select("source", "lang").distinct()
    # a row per source and language
    notes = notes.withColumn("note_id", F.row_number().over(Window.orderBy("source", "lang")).cast("long"))
    owner = d.join(F.broadcast(notes), d["source"].eqNullSafe(notes["source"]) & d["lang"].eqNullSafe(notes["lang"])).select(F.col("doc_id").alias("id"), "note_id")
    return search.recall(_index(spark, sf), _queries(spark, sf), [_query_vectors(spark, sf)], owner=owner).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- text


@query("SELECT doc_id AS id, ((length(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def est_tokens(spark, sf):
    return _docs(spark, sf).select("id", text.est_tokens(F.col("text")).alias("tokens"))


_RE2 = [(n, p.replace("(?iu)", "(?i)"), r.replace("$1$2", r"\1\2")) for n, p, r in text.REDACTIONS]


def _sql_redact(c: str) -> str:
    for _, p, r in _RE2:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{r}', 'g')"
    return c


_SECRETS = "(SELECT doc_id AS id, concat('api_key=', md5(doc_id::VARCHAR), ' x ', coalesce(text, ''), ' Bearer ', md5(lang)) AS t FROM documents)"


@query(f"SELECT id, md5({_sql_redact('t')}) AS redacted FROM {_SECRETS}")
def redact_text(spark, sf):
    d = load(spark, sf, "documents")
    t = F.concat(F.lit("api_key="), F.md5(F.col("doc_id").cast("string")), F.lit(" x "), F.coalesce("text", F.lit("")), F.lit(" Bearer "), F.md5("lang"))
    return spread(d.select(F.col("doc_id").alias("id"), t.alias("t"))).select("id", F.md5(text.redact(F.col("t"))).alias("redacted"))


def _sql_counts() -> str:
    out, c = {n: [] for n in text.REDACTION_NAMES}, "t"
    for n, p, r in _RE2:
        q = p.replace("'", "''")
        out[n].append(f"len(regexp_extract_all({c}, '{q}'))")
        c = f"regexp_replace({c}, '{q}', '{r}', 'g')"
    return ", ".join(f"sum({' + '.join(v)})::BIGINT AS {n.replace('-', '_')}" for n, v in out.items())


@query(f"SELECT {_sql_counts()} FROM {_SECRETS}")
def redact_counts(spark, sf):
    d = load(spark, sf, "documents")
    t = F.concat(F.lit("api_key="), F.md5(F.col("doc_id").cast("string")), F.lit(" x "), F.coalesce("text", F.lit("")), F.lit(" Bearer "), F.md5("lang"))
    return text.redact_counts(spread(d.select(t.alias("t"))), "t").agg(*(F.sum(n.replace("-", "_")).alias(n.replace("-", "_")) for n in text.REDACTION_NAMES))


_NORM_SQL = "trim(regexp_replace(translate(lower({c}), '" + "".join(text.FOLD.values()) + "', '" + "".join(k * len(v) for k, v in text.FOLD.items()) + "'), '[^\\p{L}\\p{Nd}]+', ' ', 'g'))"


@query(cte("tasks") + " SELECT " + _fill(_NORM_SQL, c="title") + " AS norm, count(*) AS n, min(id) AS first_id FROM tasks GROUP BY 1")
def norm_title_dedupe(spark, sf):
    return load(spark, sf, "tasks").groupBy(text.norm_title(F.col("title")).alias("norm")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(
    r"""WITH l AS (SELECT doc_id AS id, source, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[ \t\r/\\:*?"<>|]', '-', 'g'), '-') AS s FROM documents),
m AS (SELECT id, source, trim(left(s, 60), '-') AS s FROM l)
SELECT id, CASE WHEN s = '' THEN 'note' ELSE s END AS slug, concat('file:', source, '-v2') AS tag FROM m"""
)
def slug_filetag(spark, sf):
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), text.slug(F.col("text")).alias("slug"), text.file_tag(F.concat(F.lit("/data/"), F.col("source"), F.lit(" (V2).md"))).alias("tag"))


@query("SELECT doc_id AS id, CASE WHEN length(s) <= 120 THEN s ELSE concat(left(s, 120), '…') END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\v]+', ' ', 'g')) AS s FROM documents)")
def clip_lines(spark, sf):
    return _docs(spark, sf).select("id", text.clip(F.col("text")).alias("clipped"))


@query()
def chunk_documents(spark, sf):
    return chunking.chunk(spread(_docs(spark, sf)))


@query()
def html_to_text(spark, sf):
    return documents.parse_html(spread(load(spark, sf, "pages")), "page_id", "html")


@query()
def html_chunks(spark, sf):
    return chunking.chunk(documents.parse_html(spread(load(spark, sf, "pages")), "page_id", "html"), "page_id")


# ---------------------------------------------------------------- notes and tasks


def _writes(spark, sf):
    n = load(spark, sf, "notes")
    return n.select("space_id", "kind", "text", F.array("lang", "tag2").alias("tags"), "project", "why", F.col("created_h").alias("at"), F.col("id").alias("seq"))


_HASH = "sha256(concat(space_id, '|', kind, '|', regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g')))"
_FOLD = f"""
w AS (SELECT *, {_HASH} AS h FROM notes),
f AS (SELECT space_id, h, any_value(kind) AS kind, list_sort(list_distinct(flatten(list([lang, tag2])))) AS tags, arg_min(project, created_h) FILTER (WHERE project IS NOT NULL) AS project,
  arg_max(why, created_h) FILTER (WHERE why IS NOT NULL) AS why, min(created_h) AS created_at, max(created_h) AS updated_at, count(*) AS n_writes FROM w GROUP BY space_id, h)
"""


@query(cte("notes") + "," + _FOLD + " SELECT space_id, h AS content_hash, kind, array_to_string(tags, ',') AS tags, project, why, created_at, updated_at, n_writes FROM f")
def note_fold_writes(spark, sf):
    return state.fold_notes(_writes(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query(
    cte("notes")
    + f""",
w AS (SELECT *, {_HASH} AS h FROM notes),
g AS (SELECT space_id, h, id % 3 = 0 AS old, any_value(kind) AS kind, list_distinct(flatten(list([lang, tag2]))) AS tags, arg_min(project, created_h) FILTER (WHERE project IS NOT NULL) AS project,
  arg_max(why, created_h) FILTER (WHERE why IS NOT NULL) AS why, min(created_h) AS c, max(created_h) AS u FROM w GROUP BY ALL),
o AS (SELECT * FROM g WHERE old), n AS (SELECT * FROM g WHERE NOT old)
SELECT coalesce(o.space_id, n.space_id) AS space_id, coalesce(o.h, n.h) AS content_hash, coalesce(o.kind, n.kind) AS kind,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(o.tags, []), coalesce(n.tags, [])))), ',') AS tags, coalesce(o.project, n.project) AS project, coalesce(n.why, o.why) AS why,
  coalesce(o.c, n.c) AS created_at, coalesce(n.u, o.u) AS updated_at, o.h IS NULL AS fresh
FROM o FULL JOIN n ON o.space_id = n.space_id AND o.h = n.h"""
)
def note_upsert_merge(spark, sf):
    """Notes whose id divides by 3 are the state, all others a batch of writes."""
    w = _writes(spark, sf)
    old = state.fold_notes(w.filter("seq % 3 = 0"))
    return state.upsert_notes(old, w.filter("seq % 3 <> 0")).withColumn("tags", F.array_join("tags", ","))


@query(
    cte("tasks")
    + ", t AS (SELECT *, "
    + _fill(_NORM_SQL, c="title")
    + " AS norm, coalesce(project, '') AS proj FROM tasks WHERE status = 'open') SELECT space_id, proj, norm, min(id) AS id, arg_min(next_step, id) FILTER (WHERE next_step IS NOT NULL) AS next_step, arg_min(waiting_on, id) FILTER (WHERE waiting_on IS NOT NULL) AS waiting_on, arg_min(due_at, id) FILTER (WHERE due_at IS NOT NULL) AS due_at, count(*) AS n_merged FROM t GROUP BY space_id, proj, norm"
)
def task_fill_blank_merge(spark, sf):
    return state.merge_tasks(load(spark, sf, "tasks"))


@query(cte("tasks") + " SELECT id, space_id, title, due_at FROM tasks WHERE status = 'open' AND due_at <= DATE '1998-06-30'")
def tasks_due(spark, sf):
    return reports.due_tasks(load(spark, sf, "tasks"), F.lit("1998-06-30").cast("date")).select("id", "space_id", "title", "due_at")


@query(cte("tasks") + " SELECT id, space_id, waiting_on FROM tasks WHERE status = 'open' AND waiting_on IS NOT NULL")
def tasks_waiting(spark, sf):
    return reports.waiting_tasks(load(spark, sf, "tasks")).select("id", "space_id", "waiting_on")


@query(cte("tasks") + " SELECT space_id, count(*) FILTER (WHERE coalesce(project, '') = 'p1' OR coalesce(project, '') ILIKE 'p1-%') AS n_in, count(*) FILTER (WHERE NOT (coalesce(project, '') = 'p1' OR coalesce(project, '') ILIKE 'p1-%')) AS n_out FROM tasks WHERE status = 'open' GROUP BY space_id")
def tasks_project_family(spark, sf):
    t = load(spark, sf, "tasks").filter("status = 'open'").withColumn("own", reports.in_family(F.col("project"), "p1"))
    return t.groupBy("space_id").agg(F.count_if("own").alias("n_in"), F.count_if(~F.col("own")).alias("n_out"))


@query(cte("tasks") + f" SELECT id, status = 'open' AND coalesce(due_at < DATE '{NOW[:10]}', false) AS overdue, status = 'open' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY AS stale FROM tasks")
def task_flags(spark, sf):
    return reports.task_flags(load(spark, sf, "tasks"), F.lit(NOW).cast("timestamp")).select("id", "overdue", "stale")


@query(cte("notes") + f" SELECT space_id, kind, id, row_number() OVER (PARTITION BY space_id, kind ORDER BY updated_h DESC, id) AS nth FROM notes WHERE status = 'active' AND deleted_h IS NULL AND updated_h >= {NOW_H - 24 * 300} QUALIFY nth <= 12")
def notes_by_kind_since(spark, sf):
    from pyspark.sql import Window

    n = _live(load(spark, sf, "notes")).filter(F.col("updated_h") >= NOW_H - 24 * 300)
    return n.withColumn("nth", F.row_number().over(Window.partitionBy("space_id", "kind").orderBy(F.col("updated_h").desc(), "id"))).filter("nth <= 12").select("space_id", "kind", "id", "nth")


@query(cte("notes") + " SELECT id, kind, source FROM notes WHERE deleted_h IS NULL AND created_h >= 100 AND created_h < 700 AND source IN ('hook:stop', 'tool:remember')")
def notes_created_between(spark, sf):
    return load(spark, sf, "notes").filter("deleted_h is null and created_h >= 100 and created_h < 700").filter(F.col("source").isin("hook:stop", "tool:remember")).select("id", "kind", "source")


@query(cte("notes", "relations") + " SELECT r.id, r.from_ref, r.to_ref FROM relations r LEFT JOIN notes n ON r.source_note_id = n.id WHERE created_at >= TIMESTAMP '1999-01-01' AND (r.source_note_id IS NULL OR n.deleted_h IS NULL)")
def relations_recent(spark, sf):
    out = reports.recent_relations(load(spark, sf, "relations"), load(spark, sf, "notes"), F.lit("1999-01-01").cast("timestamp"))
    return out.select("id", "from_ref", "to_ref")


@query(cte("episodes") + " SELECT space_id, session_id, seq, row_number() OVER (PARTITION BY space_id ORDER BY at_m DESC, session_id, seq) AS nth FROM episodes QUALIFY nth <= 5")
def episodes_recent(spark, sf):
    from pyspark.sql import Window

    e = load(spark, sf, "episodes")
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("space_id").orderBy(F.col("at_m").desc(), "session_id", "seq"))).filter("nth <= 5").select("space_id", "session_id", "seq", "nth")


@query(cte("notes") + f", o AS (SELECT id, space_id, kind, left(n, 40) AS opening FROM (SELECT id, space_id, kind, {_fill(_NORM_SQL, c='text')} AS n FROM notes WHERE kind IN ('decision', 'fact', 'preference', 'procedure')) WHERE length(n) >= 40) SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY space_id, kind, opening) QUALIFY n > 1")
def same_opening(spark, sf):
    n = load(spark, sf, "notes").filter(F.col("kind").isin(*state.KNOWLEDGE_KINDS))
    return reports.near_opening(n, text.opening(F.col("text")))


@query()
def near_dup_batches(spark, sf):
    """The notes of a label are what one extraction gave, at most 50 by id. The
    test vectors have no near copies, so the bound is lower than in use."""
    n = load(spark, sf, "notes").select("id", "kind")
    v = _vectors(spark, sf).join(n, "id").withColumn("batch", F.floor(F.col("id") / 50))
    return reports.sequential_near_dups(v, ["batch"], 0.3)


# ---------------------------------------------------------------- jobs, purge, status


@query(cte("jobs") + " SELECT state, count(*) AS n FROM jobs GROUP BY state")
def job_state_counts(spark, sf):
    return load(spark, sf, "jobs").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(cte("jobs") + f" SELECT id, state FROM jobs WHERE (state IN ('queued', 'failed') AND run_after <= {_AT}) OR (state = 'running' AND updated_at < {_AT} - INTERVAL 30 MINUTE)")
def job_claim_eligible(spark, sf):
    return state.jobs_to_run(load(spark, sf, "jobs"), F.lit("2024-01-15").cast("timestamp")).select("id", "state")


@query(
    cte("jobs")
    + f""", o AS (SELECT *, CASE WHEN state = 'running' THEN CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'permanent' ELSE 'deferred' END END AS o FROM jobs)
SELECT id, CASE WHEN o = 'done' THEN 'done' WHEN o = 'permanent' OR (o = 'failed' AND attempts >= 5) THEN 'dead' WHEN o = 'failed' THEN 'failed' WHEN o = 'deferred' THEN 'queued' ELSE state END AS state,
  CASE WHEN o = 'deferred' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts,
  CASE WHEN o = 'failed' AND attempts < 5 THEN {_AT} + to_seconds(least(3600, 30 * 2 ** (greatest(attempts, 1) - 1))::BIGINT) WHEN o = 'deferred' THEN {_AT} + INTERVAL 1 DAY ELSE run_after END AS run_after,
  CASE WHEN o IS NOT NULL THEN {_AT} ELSE updated_at END AS updated_at FROM o"""
)
def job_backoff_transition(spark, sf):
    """Running jobs end in the four ways that there are."""
    j = load(spark, sf, "jobs")
    how = F.element_at(F.array(*(F.lit(x) for x in ("done", "failed", "permanent", "deferred"))), (F.col("id") % 4 + 1).cast("int"))
    now = F.lit("2024-01-15").cast(j.schema["run_after"].dataType)
    ends = j.select("id", how.alias("outcome"), F.lit("e").alias("error"), (now + F.expr("INTERVAL 1 DAY")).alias("until"))
    return state.settle_jobs(j, ends, now).select("id", "state", "attempts", "run_after", "updated_at")


@query(
    cte("jobs")
    + f""", e AS (SELECT id FROM jobs WHERE (state IN ('queued', 'failed') AND run_after <= {_AT}) OR (state = 'running' AND updated_at < {_AT} - INTERVAL 30 MINUTE) ORDER BY id LIMIT 25)
SELECT id, id IN (FROM e) AS claimed, CASE WHEN id IN (FROM e) THEN 'running' ELSE state END AS state, attempts + (id IN (FROM e))::INT AS attempts, CASE WHEN id IN (FROM e) THEN {_AT} ELSE updated_at END AS updated_at FROM jobs"""
)
def job_claim(spark, sf):
    """25 workers claim a job each."""
    j = load(spark, sf, "jobs")
    return state.claim_jobs(j, F.lit("2024-01-15").cast(j.schema["run_after"].dataType), 25).select("id", "claimed", "state", "attempts", "updated_at")


@query(cte("jobs") + " SELECT id, type, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS nth FROM jobs WHERE state = 'dead' QUALIFY nth <= 20")
def jobs_dead_newest(spark, sf):
    """The dead jobs that a status report shows."""
    j = load(spark, sf, "jobs").filter("state = 'dead'").orderBy(F.desc("updated_at"), F.desc("id")).limit(20)
    return j.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("updated_at"), F.desc("id")))).select("id", "type", "nth")


@query(cte("jobs") + " SELECT DISTINCT type, payload FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM jobs a WHERE a.state IN ('queued', 'failed', 'running') AND a.type = j.type AND a.payload = j.payload)")
def job_enqueue_dedupe(spark, sf):
    j = load(spark, sf, "jobs")
    return state.enqueue(j, j.select("type", "payload"))


#: Both live tiers spare notes that were soft-deleted: those have their grace period.
_REASON = f"CASE WHEN deleted_h IS NOT NULL AND deleted_h < {NOW_H - 24 * 90} THEN 'deleted' WHEN deleted_h IS NULL AND status = 'superseded' THEN 'superseded' WHEN deleted_h IS NULL AND kind IN ('note', 'task_hint', 'transcript', 'caption') AND updated_h < {NOW_H - 24 * 200} THEN 'event' END"


@query(cte("notes") + f" SELECT id, kind FROM notes WHERE {_REASON} IS NULL")
def purge_survivors(spark, sf):
    return state.purge(load(spark, sf, "notes"), {}, state.purge_reason(NOW_H, 200, 90))[0].select("id", "kind")


@query(cte("notes") + f" SELECT {_REASON} AS reason, count(*) AS n FROM notes WHERE {_REASON} IS NOT NULL GROUP BY 1")
def purge_report(spark, sf):
    return state.purge(load(spark, sf, "notes"), {}, state.purge_reason(NOW_H, 200, 90))[2]


@query(cte("notes") + f" SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM notes WHERE {_REASON} IS NOT NULL)")
def purge_cascade(spark, sf):
    owned = {"embeddings": (_vectors(spark, sf), "id")}
    return state.purge(load(spark, sf, "notes"), owned, state.purge_reason(NOW_H, 200, 90))[1]["embeddings"].select("id")


@query(
    cte("tasks", "jobs", "episodes", "relations", "notes")
    + f""" SELECT 'tasks' AS name, count(*) AS n FROM tasks WHERE NOT (status <> 'open' AND updated_at < TIMESTAMP '2024-01-20' - INTERVAL 9300 DAY)
UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE NOT (state IN ('done', 'dead') AND updated_at < TIMESTAMP '2024-01-20' - INTERVAL 5 DAY)
UNION ALL SELECT 'raws', count(*) FROM jobs WHERE NOT run_after < TIMESTAMP '2024-01-20'
UNION ALL SELECT 'media', count(*) FROM tasks WHERE NOT updated_at < TIMESTAMP '2024-01-20' - INTERVAL 9300 DAY
UNION ALL SELECT 'episodes', count(*) FROM episodes WHERE NOT TIMESTAMP '1998-01-01' + to_minutes(at_m) < TIMESTAMP '2024-01-20' - INTERVAL 9300 DAY
UNION ALL SELECT 'relations', count(*) FROM relations WHERE NOT (source_note_id IS NULL AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 9300 DAY) AND (source_note_id IS NULL OR source_note_id NOT IN (SELECT id FROM notes WHERE {_REASON} IS NOT NULL))"""
)
def purge_tables(spark, sf):
    """What stays of all other tables; jobs stand in for raws and tasks for media."""
    t, j = load(spark, sf, "tasks"), load(spark, sf, "jobs")
    e = load(spark, sf, "episodes").withColumn("at", F.lit("1998-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("at_m").cast("int")))
    tables = {"tasks": t, "jobs": j, "raws": j.withColumnRenamed("run_after", "retained_until"), "media": t, "episodes": e, "relations": load(spark, sf, "relations")}
    gone = load(spark, sf, "notes").withColumn("reason", state.purge_reason(NOW_H, 200, 90)).filter("reason is not null")
    kept = state.purge_tables(tables, F.lit("2024-01-20").cast("timestamp"), 9300, 5, gone)
    return reduce(DataFrame.unionByName, (x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, x in kept.items()))


@query(cte("notes", "tasks") + " SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM notes WHERE status = 'active' AND deleted_h IS NULL) AS live, (SELECT count(*) FROM tasks WHERE status = 'open') AS open_tasks, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions")
def status_counts(spark, sf):
    n = load(spark, sf, "notes").agg(F.count(F.lit(1)).alias("notes"), F.count_if((F.col("status") == "active") & F.col("deleted_h").isNull()).alias("live"))
    t = load(spark, sf, "tasks").agg(F.count_if(F.col("status") == "open").alias("open_tasks"))
    return n.crossJoin(t).crossJoin(load(spark, sf, "conversations").agg(F.count_distinct("conv_id").alias("sessions")))


# ---------------------------------------------------------------- briefing, export


#: One o'clock at night still is the work day before.
BRIEF_AT, BRIEF_DAY = "1998-06-01 01:00:00", "1998-05-31"
_FAMILY = "(coalesce(project, '') = 'p1' OR coalesce(project, '') ILIKE 'p1-%')"


def _items(spark, sf):
    return reports.briefing_items(load(spark, sf, "tasks"), load(spark, sf, "notes"), load(spark, sf, "episodes"), load(spark, sf, "relations"), BRIEF_AT, NOW_H, "p1")


_TOP = "SELECT space_id, {s} AS section, row_number() OVER (PARTITION BY space_id ORDER BY {o}) AS nth, {k} AS key, {l} AS line FROM {t} QUALIFY nth <= {n}"
_TAG = "CASE WHEN coalesce(project, '') IN ('', 'p1') THEN '' ELSE concat(' [', project, ']') END"
_TASK = f"concat('- #', id, ' (', CASE WHEN due_at < DATE '{BRIEF_DAY}' THEN concat('QUÁ HẠN ', strftime(due_at, '%Y-%m-%d')) WHEN due_at IS NOT NULL THEN concat('hạn ', strftime(due_at, '%Y-%m-%d')) ELSE concat('cập nhật ', strftime(updated_at, '%Y-%m-%d')) END, CASE WHEN updated_at < TIMESTAMP '{BRIEF_AT}' - INTERVAL 14 DAY THEN ', stale' ELSE '' END, '): ', title, {_TAG}, CASE WHEN waiting_on <> '' THEN concat(' — chờ: ', waiting_on) ELSE '' END, CASE WHEN next_step <> '' THEN concat(' — bước kế: ', next_step) ELSE '' END)"


def _note_section(s: int, kind: str, n: int, hours: int | None) -> str:
    since = "" if hours is None else f" AND updated_h >= {NOW_H - hours}"
    src = f"(SELECT * FROM notes WHERE status = 'active' AND deleted_h IS NULL AND kind = '{kind}'{since})"
    return _fill(_TOP, s=s, o="updated_h DESC, id", k="concat('n', id)", l=f"concat('- ', strftime(TIMESTAMP '{BRIEF_AT}' - to_hours({NOW_H} - updated_h), '%Y-%m-%d'), ': ', text, CASE WHEN coalesce(why, '') <> '' AND NOT contains(text, why) THEN concat(' (vì: ', why, ')') ELSE '' END, {_TAG})", t=src, n=n)


@query(
    cte("tasks", "notes", "episodes", "relations")
    + ", it AS ("
    + " UNION ALL ".join(
        "(" + x + ")"
        for x in [
            _fill(_TOP, s=1, o="due_at, id", k="concat('t', id)", l=_TASK, t=f"(SELECT * FROM tasks WHERE status = 'open' AND due_at <= DATE '{BRIEF_DAY}' + 3)", n=10),
            _fill(_TOP, s=2, o="updated_at, id", k="concat('t', id)", l=_TASK, t="(SELECT * FROM tasks WHERE status = 'open' AND waiting_on IS NOT NULL)", n=10),
            _fill(_TOP, s=3, o="CASE WHEN coalesce(project, '') = 'p1' THEN 0 ELSE 1 END, updated_at DESC, id", k="concat('t', id)", l=_TASK, t=f"(SELECT * FROM tasks WHERE status = 'open' AND {_FAMILY})", n=20),
            f"SELECT space_id, 3, 21, 'outside', concat('- … còn ', count(*), ' việc ngoài project hiện tại (task_list để xem)') FROM tasks WHERE status = 'open' AND NOT {_FAMILY} GROUP BY space_id",
            _note_section(4, "decision", 12, 24 * 30),
            _note_section(5, "preference", 12, None),
            _fill(_TOP, s=6, o="created_at DESC, id DESC", k="concat_ws('|', 'r', from_ref, to_ref, rel_type)", l="concat('- ', from_ref, ' → ', to_ref, ' (', rel_type, ')')", t=f"(SELECT * FROM relations WHERE created_at >= DATE '{BRIEF_DAY}' - 30 AND (source_note_id IS NULL OR source_note_id NOT IN (SELECT id FROM notes WHERE deleted_h IS NOT NULL)))", n=10),
            _fill(_TOP, s=7, o="at_m DESC, session_id, seq", k="concat_ws('|', 'e', session_id, seq)", l="concat('- ', strftime(TIMESTAMP '1998-01-01' + to_minutes(at_m), '%Y-%m-%d'), ': ', summary)", t="episodes", n=5),
            _note_section(8, "note", 10, 24 * 7),
        ]
    )
    + ") SELECT space_id, section, nth, line FROM (SELECT *, row_number() OVER (PARTITION BY space_id, key ORDER BY section, nth) AS seen FROM it) WHERE seen = 1"
)
def briefing_sections(spark, sf):
    return _items(spark, sf)


@query()
def briefing_render(spark, sf):
    return reports.render_briefing(_items(spark, sf), reports.TITLES)


@query(cte("tasks") + " SELECT space_id, id, concat('- [', CASE status WHEN 'done' THEN 'x' WHEN 'dropped' THEN '-' ELSE ' ' END, '] ', title, CASE WHEN next_step IS NOT NULL THEN concat(' — next: ', next_step) ELSE '' END) AS line FROM tasks")
def export_checklist(spark, sf):
    return sinks.vault_tasks(load(spark, sf, "tasks"))


_STAMP = "strftime(TIMESTAMP '2024-01-01' + to_hours({c}), '%Y-%m-%dT%H:%M:%SZ')"


@query(
    cte("notes")
    + f""", sl AS (SELECT *, trim(left(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[ \t\r/\\:*?"<>|]', '-', 'g'), '-'), 60), '-') AS s FROM notes WHERE deleted_h IS NULL)
SELECT concat(CASE space_id WHEN 1 THEN 'personal' WHEN 2 THEN 'work' ELSE 'learning' END, '/', kind, '/', id, '-', CASE WHEN s = '' THEN 'note' ELSE s END, '.md') AS path,
  concat('---', chr(10), 'kind: ', kind, chr(10), 'tags: ["', lang, '","', tag2, '"]', chr(10), 'created: ', {_STAMP.format(c='created_h')}, chr(10), 'updated: ', {_STAMP.format(c='updated_h')}, chr(10), 'source: "', source, '"', chr(10), '---', chr(10), chr(10), text, chr(10)) AS body FROM sl"""
)
def export_markdown(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp")
    n = load(spark, sf, "notes").withColumns({"tags": F.array("lang", "tag2"), **{f"{c}_at": start + F.make_dt_interval(hours=F.col(f"{c}_h").cast("int")) for c in ("created", "updated")}})
    return sinks.vault_notes(n, {1: "personal", 2: "work", 3: "learning"})


@query(cte("relations") + " SELECT id, concat('- ', from_ref, ' → ', to_ref, ' (', rel_type, ')', CASE WHEN source_note_id IS NOT NULL THEN concat(' — note #', source_note_id) ELSE '' END) AS line FROM relations")
def export_relations(spark, sf):
    return sinks.vault_relations(load(spark, sf, "relations"))


# ---------------------------------------------------------------- usage, sessions

_ROLL = """count(*) AS calls, count(*) FILTER (WHERE failed) AS errors, count(*) FILTER (WHERE latency_ms > 60000) AS slow, count(*) FILTER (WHERE bytes > 262144) AS big, sum(bytes)::BIGINT AS bytes,
sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, count(*) FILTER (WHERE cached_tokens >= 0) AS cache_reported, max(prompt_tokens) AS max_prompt, max(latency_ms) AS max_latency_ms,
round(CASE WHEN coalesce(sum(prompt_tokens) FILTER (WHERE cached_tokens >= 0), 0) > 0 THEN sum(cached_tokens) FILTER (WHERE cached_tokens >= 0) / sum(prompt_tokens) FILTER (WHERE cached_tokens >= 0) ELSE -1.0::DOUBLE END, 3) AS cache_hit"""


@query(cte("usage") + f" SELECT op, model, purpose, {_ROLL} FROM usage GROUP BY op, model, purpose")
def usage_rollup(spark, sf):
    return reports.usage_rollup(load(spark, sf, "usage"))


@query(cte("usage") + f" SELECT op, model, purpose, date_trunc('hour', ts) AS hour, {_ROLL} FROM usage GROUP BY ALL")
def usage_rollup_hourly(spark, sf):
    return capture.hourly_usage(load(spark, sf, "usage"))


@query(cte("usage") + " SELECT id, op, concat_ws(',', CASE WHEN failed THEN 'failed' END, CASE WHEN prompt_tokens > 30000 THEN 'long_prompt' END, CASE WHEN bytes > 262144 THEN 'large_body' END, CASE WHEN latency_ms > 60000 THEN 'slow' END) AS why FROM usage WHERE failed OR prompt_tokens > 30000 OR bytes > 262144 OR latency_ms > 60000")
def usage_anomalies(spark, sf):
    return reports.usage_anomalies(load(spark, sf, "usage"))


@query(cte("usage") + " SELECT id, op, model, purpose, row_number() OVER (PARTITION BY op, model, purpose ORDER BY ts, id) AS nth FROM usage QUALIFY nth = 1 OR nth % 50 = 0")
def usage_sampling(spark, sf):
    return reports.sampled_calls(load(spark, sf, "usage"))


@query(
    """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM e)
SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS started_at, max(ts) AS last_seen_at, count(*) AS n_events FROM s GROUP BY user_id, session_no"""
)
def session_gap_reuse(spark, sf):
    return reports.session_groups(load(spark, sf, "events"))


@query("SELECT user_id, (ts - INTERVAL 4 HOUR)::DATE AS day, min(ts) AS first_at, count(*) AS n_events FROM events GROUP BY ALL")
def workday_gate(spark, sf):
    e = load(spark, sf, "events").withColumn("day", dates.work_day(F.col("ts")))
    return e.groupBy("user_id", "day").agg(F.min("ts").alias("first_at"), F.count(F.lit(1)).alias("n_events"))


# ---------------------------------------------------------------- transcripts


def _records(spark, sf):
    c = load(spark, sf, "conversations")
    body = F.to_json(F.struct(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("type"), (F.col("role") == "system").alias("isMeta"), F.struct(F.col("text").alias("content")).alias("message")))
    return c.select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("seq"), body.alias("line"))


@query("SELECT conv_id AS session_id, turn + 1 AS seq, concat(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END, t) AS line FROM (SELECT *, regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS t FROM conversations) WHERE role IN ('user', 'assistant') AND t <> '' AND length(t) <= 4000 UNION ALL SELECT conv_id, turn + 1, concat(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END, left(t, 2666), ' …[cut]… ', right(t, 1334)) FROM (SELECT *, regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS t FROM conversations) WHERE role IN ('user', 'assistant') AND length(t) > 4000")
def transcript_condense(spark, sf):
    return transcripts.condense(_records(spark, sf), ["session_id", "seq"]).select("session_id", "seq", "line")


@query()
def transcript_windows(spark, sf):
    said = transcripts.condense(_records(spark, sf), ["session_id", "seq"])
    # a session is one extraction's input: its windows are packed from its whole text
    whole = said.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return chunking.windows(whole, "session_id", "text", most=4000, keep=2)


@query()
def consolidate_batches(spark, sf):
    return reports.consolidation_batches(load(spark, sf, "notes").filter(F.col("kind").isin(*state.KNOWLEDGE_KINDS)))
