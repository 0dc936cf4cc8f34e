"""Queries over operators.memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.functions import text
from loreforge.operators import memory, state, transcripts
from loreforge.plans.registry import _AT, _NORM_SQL, NOW_H, _docs, _fill, _records, _vectors, query
from loreforge.sources.adapters import cte, load


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def lookup_by_ids(spark, sf):
    return memory.by_ids(_docs(spark, sf), _vectors(spark, sf))


@query("SELECT doc_id AS id, CASE WHEN lang = source THEN lang ELSE concat(lang, ',', source) END AS tags FROM documents")
def tags_normalised(spark, sf):
    d = load(spark, sf, "documents")
    tags = memory.normal_tags(F.array(F.concat(F.lit(" "), "lang"), F.lit(""), "lang", F.lit("\t "), "source"))
    return d.select(F.col("doc_id").alias("id"), F.array_join(tags, ",").alias("tags"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://blog\\.[^/]+/en/') THEN 'learning' WHEN url LIKE 'https://%' THEN 'work' ELSE 'personal' END AS space FROM pages")
def space_by_path(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "[?#].*$", "")).alias("p"))
    rules = [("/http*:/*/blog.*/en/**", "learning"), ("/https:/**", "work")]
    return p.select("page_id", memory.space_of(F.regexp_replace("p", "//+", "/"), [("/http*:/blog.*/en/**", "learning"), rules[1]], "personal").alias("space"))


@query("SELECT role, max(conv_id) AS conv_id, arg_max(turn, conv_id * 1000 + turn) AS turn FROM conversations GROUP BY role")
def latest_per_role(spark, sf):
    c = load(spark, sf, "conversations")
    return memory.latest(c, ["role"], [F.col("conv_id").desc(), F.col("turn").desc()]).select("role", "conv_id", "turn")


@query(cte("notes") + f" SELECT id, coalesce(deleted_h, CASE WHEN id IN (SELECT vec_id FROM embeddings) THEN {NOW_H} END) AS deleted_h, deleted_h IS NULL AND id IN (SELECT vec_id FROM embeddings) AS changed FROM notes")
def note_soft_delete(spark, sf):
    out = memory.soft_delete(load(spark, sf, "notes"), _vectors(spark, sf), F.lit(NOW_H).cast("long"))
    return out.select("id", "deleted_h", "changed")


@query(
    """WITH m AS (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey % 5 <> 0),
w AS (SELECT n_name AS key, (n_regionkey + n_nationkey % 2)::VARCHAR AS value, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE (n_regionkey - n_nationkey % 3 // 2)::VARCHAR END AS expect FROM nation WHERE n_nationkey % 7 <> 0),
b AS (SELECT coalesce(m.key, w.key) AS key, m.value AS old, w.value AS new, w.key IS NOT NULL AND (w.expect IS NULL OR w.expect = coalesce(m.value, '')) AS ok FROM m FULL JOIN w ON m.key = w.key)
SELECT key, CASE WHEN ok THEN new ELSE old END AS value, ok AND new IS DISTINCT FROM old AS changed FROM b WHERE CASE WHEN ok THEN new ELSE old END IS NOT NULL"""
)
def meta_compare_and_set(spark, sf):
    """Writes with and without an expectation, of keys that are stored and that are not."""
    n = load(spark, sf, "nation")
    meta = n.filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    expect = F.when(F.col("n_nationkey") % 4 == 0, "").when(F.col("n_nationkey") % 4 != 1, (F.col("n_regionkey") - F.floor(F.col("n_nationkey") % 3 / 2)).cast("string"))
    writes = n.filter("n_nationkey % 7 <> 0").select(F.col("n_name").alias("key"), (F.col("n_regionkey") + F.col("n_nationkey") % 2).cast("string").alias("value"), expect.alias("expect"))
    return memory.set_meta(meta, writes)


@query(cte("jobs") + f" SELECT id, CASE state WHEN 'dead' THEN 'queued' ELSE state END AS state, CASE state WHEN 'dead' THEN 0 ELSE attempts END AS attempts, CASE state WHEN 'dead' THEN {_AT} ELSE run_after END AS run_after, CASE state WHEN 'dead' THEN {_AT} ELSE updated_at END AS updated_at, CASE state WHEN 'dead' THEN '' ELSE 'e' END AS last_error FROM jobs")
def job_retry_dead(spark, sf):
    j = load(spark, sf, "jobs").withColumn("last_error", F.lit("e"))
    return memory.retry_dead(j, F.lit("2024-01-15").cast(dict(j.dtypes)["run_after"])).select("id", "state", "attempts", "run_after", "updated_at", "last_error")


@query(
    """WITH f AS (SELECT doc_id, 1 + doc_id % 2 AS space_id, concat('/in/', source, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' ELSE '.txt' END) AS path, sha256(text) AS sha,
  CASE doc_id % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' WHEN 2 THEN 'unsupported' END AS kind, doc_id % 7 = 0 AS fresh FROM documents),
k AS (SELECT DISTINCT 1 AS space_id, sha256(text) AS sha FROM documents WHERE doc_id % 11 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY space_id, sha, coalesce(kind <> 'unsupported', false) AND NOT fresh ORDER BY path) AS nth FROM f),
o AS (SELECT space_id, CASE WHEN fresh THEN 'fresh' WHEN kind IS NULL THEN 'type' WHEN kind = 'unsupported' THEN kind WHEN nth > 1 OR (space_id, sha) IN (SELECT (space_id, sha) FROM k) THEN 'already' ELSE 'ingested' END AS outcome FROM n)
SELECT space_id, outcome, count(*) AS n FROM o GROUP BY ALL"""
)
def media_watch_outcomes(spark, sf):
    d = load(spark, sf, "documents")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".mp3", ".JPG", ".webp", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    now = F.lit("2024-01-15").cast("timestamp")
    files = d.select((1 + F.col("doc_id") % 2).alias("space_id"), F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 7 == 0, now - F.expr("INTERVAL 59 SECONDS")).otherwise(now - F.expr("INTERVAL 60 SECONDS")).alias("modified"))
    known = d.filter("doc_id % 11 = 0").select(F.lit(1).cast("long").alias("space_id"), F.sha2("text", 256).alias("sha256"))
    return memory.media_outcomes(files, known, now).groupBy("space_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT conv_id AS session_id, string_agg(concat(text, chr(10)), '' ORDER BY turn, role, text) || 'half' AS t, count(*) AS n FROM conversations GROUP BY conv_id), c AS (SELECT session_id, left(t, length(t) - 4) AS t, CASE WHEN session_id % 2 = 0 THEN 0 ELSE 1000000000 END AS off FROM f) SELECT session_id, 0::BIGINT AS expect_offset, strlen(t)::BIGINT AS new_offset, md5(t) AS content FROM c")
def transcript_read_deltas(spark, sf):
    c = load(spark, sf, "conversations")
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "")
    files = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.concat(text_.cast("binary"), F.lit(bytearray("half é".encode()[:-1]))).alias("content"))
    offsets = files.select("session_id", F.when(F.col("session_id") % 2 == 0, 0).otherwise(1_000_000_000).alias("offset"))
    return memory.read_deltas(files, offsets).withColumn("content", F.md5("content"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS session_id, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
w AS (SELECT session_id, i, t, t AS opened FROM e WHERE i = 1
  UNION ALL SELECT e.session_id, e.i, e.t, CASE WHEN e.t <= w.opened + INTERVAL 600 MINUTE THEN w.opened ELSE e.t END FROM w JOIN e ON e.session_id = w.session_id AND e.i = w.i + 1)
SELECT session_id, opened + INTERVAL 600 MINUTE AS fires_at, count(*) AS n FROM w GROUP BY session_id, opened"""
)
def capture_debounce(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"))
    return memory.debounce(e, 600).withColumn("fires_at", F.col("fires_at").cast(e.schema["at"].dataType))


@query(
    """WITH e AS (SELECT event_id AS id, event_id % 6 AS shape, (props->>'k')::INT AS k FROM events)
SELECT id, (k * 10)::BIGINT AS prompt_tokens, CASE WHEN shape = 3 THEN 0 ELSE k * 3 END::BIGINT AS completion_tokens,
  CASE shape WHEN 0 THEN k WHEN 1 THEN k * 2 WHEN 4 THEN k * 2 ELSE -1 END::BIGINT AS cached_tokens FROM e"""
)
def usage_fields_normalised(spark, sf):
    """Six shapes: details; details with a greater cache hit; a zero prompt beside input_tokens; a total only; cache hits only; a total less the completion."""
    e = load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    k, pt, ct = F.col("k"), (F.col("k") * 10).alias("prompt_tokens"), (F.col("k") * 3).alias("completion_tokens")
    details, hit = F.struct(k.alias("cached_tokens")).alias("prompt_tokens_details"), (k * 2).alias("prompt_cache_hit_tokens")
    shapes = [
        (pt, ct, details),
        (pt, ct, details, hit),
        (F.lit(0).alias("prompt_tokens"), (k * 10).alias("input_tokens"), ct),
        ((k * 10).alias("total_tokens"),),
        (pt, ct, hit),
        ((k * 13).alias("total_tokens"), ct),
    ]
    usage = F.coalesce(*(F.when(F.col("event_id") % 6 == i, F.to_json(F.struct(*s))) for i, s in enumerate(shapes)))
    return memory.usage_fields(e.select(F.col("event_id").alias("id"), usage.alias("usage"))).drop("usage")


_SAID = "SELECT conv_id AS session_id, turn + 1 AS seq, concat(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END, CASE WHEN length(t) <= 4000 THEN t ELSE concat(left(t, 2666), ' …[cut]… ', right(t, 1334)) END) AS line FROM (SELECT *, regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS t FROM conversations) WHERE role IN ('user', 'assistant') AND t <> ''"


@query(f"WITH l AS ({_SAID}), s AS (SELECT session_id, string_agg(line, chr(10) ORDER BY seq, line) AS text FROM l GROUP BY session_id) SELECT session_id, CASE WHEN length(text) > 2000 THEN concat('… [cut]', chr(10), right(text, 2000)) ELSE text END AS text FROM s")
def session_summary_input(spark, sf):
    """The bound is lower than in use, so that sessions of the test tables are cut."""
    lines = transcripts.condense(_records(spark, sf), ["session_id", "seq"])
    return memory.summary_input(lines, ["session_id"], 2000)


_MERGES = "(SELECT space_id, kind, project, list_sort(list(id)) AS ids FROM notes WHERE status = 'active' AND deleted_h IS NULL AND kind IN ('decision', 'fact', 'preference', 'procedure') GROUP BY ALL HAVING count(*) >= 2)"


@query(cte("notes") + f", m AS {_MERGES} SELECT space_id, kind, project, len(ids)::BIGINT AS n_deleted, array_to_string(list_sort((SELECT list_distinct(flatten(list([lang, tag2]))) FROM notes WHERE list_contains(m.ids, id))), ',') AS tags FROM m")
def consolidate_apply(spark, sf):
    """All knowledge notes of one space, kind and project merge to one text that
    none of them has."""
    n = load(spark, sf, "notes").filter("status = 'active' and deleted_h is null").filter(F.col("kind").isin(*state.KNOWLEDGE_KINDS)).withColumn("tags", F.array("lang", "tag2"))
    groups = n.groupBy("space_id", "kind", "project").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") >= 2)
    merges = groups.select(F.col("ids")[0].alias("merge_id"), F.concat(F.lit("merged "), F.col("ids")[0].cast("string")).alias("text"), "ids")
    new, gone = memory.apply_merges(n, merges)
    per = merges.select("merge_id", F.explode("ids").alias("id")).join(gone, "id").groupBy("merge_id").agg(F.count(F.lit(1)).alias("n_deleted"))
    return new.join(per, "merge_id").select("space_id", "kind", "project", "n_deleted", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query(
    cte("notes")
    + f""", n AS (SELECT id, space_id, kind, CASE WHEN length(t) >= 40 THEN left(t, 40) END AS opening FROM (SELECT id, space_id, kind, {_fill(_NORM_SQL, c='text')} AS t FROM notes WHERE status = 'active' AND deleted_h IS NULL)),
ev AS (SELECT n.*, embedding::DOUBLE[] AS v FROM n JOIN embeddings ON vec_id = n.id),
s AS (SELECT q.id AS query_id, e.id, list_cosine_similarity(q.v, e.v) AS score, q.opening AS o, e.opening AS p FROM ev q JOIN ev e ON q.id <> e.id AND q.space_id = e.space_id AND q.kind = e.kind WHERE q.id % 20 = 0 AND q.kind IN ('decision', 'fact', 'preference', 'procedure')),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM s QUALIFY pos <= 5)
SELECT query_id AS id, CASE WHEN max(score) >= 0.3 THEN arg_min(id, pos) ELSE arg_min(id, pos) FILTER (WHERE o = p) END AS replaces FROM h GROUP BY query_id HAVING replaces IS NOT NULL"""
)
def note_dedupe_plan(spark, sf):
    """Live notes whose number divides by 20 as new ones against all live notes.
    The test vectors have no near copies, so the bound is lower than in use."""
    notes = load(spark, sf, "notes").filter("status = 'active' and deleted_h is null").select("id", "space_id", "kind", text.opening(F.col("text")).alias("opening")).join(_vectors(spark, sf), "id")
    return memory.dedupe_plan(notes.filter("id % 20 = 0"), notes, 0.3)


@query(
    cte("notes", "tasks")
    + """, r AS (SELECT space_id, 0 AS o, created_at, id, concat('- task #', id, ': ', title) AS line FROM tasks WHERE status = 'open' AND created_at >= TIMESTAMP '1998-01-01' AND created_at < TIMESTAMP '1998-01-08'
UNION ALL SELECT space_id, 1, TIMESTAMP '1998-01-01' + to_hours(created_h), id, concat('- note #', id, ' [', kind, ']') FROM notes WHERE deleted_h IS NULL AND created_h < 168 AND source IN ('hook:stop', 'tool:remember')),
n AS (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY o, created_at, id) AS nth FROM r)
SELECT space_id, nth, line FROM n WHERE nth <= 8 UNION ALL SELECT space_id, 9, concat('- … and ', count(*) - 8, ' more') FROM r GROUP BY space_id HAVING count(*) > 8"""
)
def captured_since(spark, sf):
    start, end = (F.lit(x).cast("timestamp") for x in ("1998-01-01", "1998-01-08"))
    notes = load(spark, sf, "notes").withColumn("created_at", start + F.make_dt_interval(hours=F.col("created_h").cast("int")))
    return memory.captured(notes, load(spark, sf, "tasks"), start, end)


@query("SELECT doc_id AS id, 8::BIGINT AS dim FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_missing_chunks(spark, sf):
    out = memory.embed_missing(_docs(spark, sf), _vectors(spark, sf), memory.hash_embedder)
    return out.select("id", F.size("vec").cast("long").alias("dim"))


@query(
    f"""WITH e AS (SELECT conv_id AS session_id, {_fill(_NORM_SQL, c='text')} AS e FROM conversations WHERE text <> ''),
f AS (SELECT conv_id AS session_id, {_fill(_NORM_SQL, c='left(text, 60)')} AS f FROM conversations WHERE role = 'assistant')
SELECT count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.session_id = e.session_id AND contains(f.f, e.e)) THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM e"""
)
def extraction_evaluation(spark, sf):
    """What the first 60 characters of assistant turns hold of all turns."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "text", "role")
    found = c.filter("role = 'assistant'").select("session_id", F.left("text", F.lit(60)).alias("text"))
    return memory.extraction_recall(found, c.filter("text <> ''").select("session_id", F.col("text").alias("expect"))).withColumn("recall", F.round("recall", 6))
