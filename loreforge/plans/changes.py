"""Queries over the write path: notes, tasks, extractions, capture."""

from __future__ import annotations

import gzip
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions import dates, sql, text, vectors
from loreforge.operators import extraction, memory, reports, search, state, writing
from loreforge.plans.registry import _AT, _HASH, _NORM_SQL, _fill, _sql_redact, _tokens, query
from loreforge.sources import documents, migrations
from loreforge.sources.adapters import cte, load
from loreforge.sources.scratch import spread, written
from loreforge.streaming import capture


@query(
    cte("notes")
    + f""", w AS (SELECT *, {_HASH} AS h, regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS t FROM notes WHERE id % 3 <> 0),
ok AS (SELECT * FROM w WHERE t <> '' AND kind <> 'document'),
old AS (SELECT DISTINCT space_id, {_HASH} AS h FROM notes WHERE id % 3 = 0),
f AS (SELECT space_id, h, any_value(kind) AS kind, any_value(t) AS t, arg_max(why, id) FILTER (WHERE why IS NOT NULL) AS why FROM ok WHERE (space_id, h) NOT IN (SELECT (space_id, h) FROM old) GROUP BY space_id, h)
SELECT space_id, h AS content_hash, kind, md5({_sql_redact("CASE WHEN coalesce(why, '') = '' OR contains(t, why) THEN t ELSE concat(t, chr(10), 'Why: ', why) END")}) AS indexed FROM f"""
)
def note_write_path(spark, sf):
    """Writes of notes against a table of notes: what is fresh, and the text that is chunked and embedded."""
    n = load(spark, sf, "notes").withColumn("tags", F.array("lang", "tag2"))
    n = n.select("id", "space_id", "kind", "text", "tags", "project", "why", F.col("created_h").alias("at"), F.col("id").alias("seq"))
    kinds = [k for k in writing.KINDS if k != "document"]
    done = writing.write_notes(state.fold_notes(n.filter("id % 3 = 0")), n.filter("id % 3 <> 0"), kinds)
    return done.fresh.select("space_id", "content_hash", "kind", F.md5("indexed").alias("indexed"))


@query()
def note_write_chunks(spark, sf):
    """The chunks and jobs of the same writes."""
    n = load(spark, sf, "notes").withColumn("tags", F.array("lang", "tag2"))
    n = n.select("id", "space_id", "kind", "text", "tags", "project", "why", F.col("created_h").alias("at"), F.col("id").alias("seq"))
    done = writing.write_notes(state.fold_notes(n.filter("id % 3 = 0")), n.filter("id % 3 <> 0"))
    return done.chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens")).join(done.jobs.select(F.get_json_object("payload", "$.content_hash").alias("content_hash")), "content_hash")


@query(
    cte("tasks")
    + f""", n AS (SELECT *, {_fill(_NORM_SQL, c='title')} AS norm, coalesce(project, '') AS proj FROM tasks),
have AS (SELECT space_id, proj, norm, min(id) AS hit FROM n WHERE status = 'open' AND id % 2 = 0 GROUP BY ALL),
new AS (SELECT space_id, proj, norm, min(id) AS seq, arg_min(title, id) AS title, arg_min(next_step, id) FILTER (WHERE next_step IS NOT NULL) AS next_step, arg_min(waiting_on, id) FILTER (WHERE waiting_on IS NOT NULL) AS waiting_on, arg_min(due_at, id) FILTER (WHERE due_at IS NOT NULL) AS due_at FROM n WHERE id % 2 = 1 GROUP BY ALL),
m AS (SELECT new.*, hit FROM new LEFT JOIN have USING (space_id, proj, norm))
SELECT t.id, t.space_id, t.project, t.title, t.status, coalesce(t.next_step, m.next_step) AS next_step, coalesce(t.waiting_on, m.waiting_on) AS waiting_on, coalesce(t.due_at, m.due_at) AS due_at, false AS fresh FROM tasks t LEFT JOIN m ON m.hit = t.id WHERE t.id % 2 = 0
UNION ALL SELECT (SELECT max(id) FROM tasks WHERE id % 2 = 0) + row_number() OVER (ORDER BY seq), space_id, nullif(proj, ''), title, 'open', next_step, waiting_on, due_at, true FROM m WHERE hit IS NULL"""
)
def task_insert_merge(spark, sf):
    """Tasks of odd numbers come as new ones to a table of the others."""
    t = load(spark, sf, "tasks")
    return state.insert_tasks(t.filter("id % 2 = 0"), t.filter("id % 2 = 1").withColumnRenamed("id", "seq"))


@query(
    cte("tasks")
    + f""" SELECT id, CASE WHEN id % 3 = 0 THEN CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'dropped' ELSE status END ELSE status END AS status,
CASE WHEN id % 3 = 0 THEN CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'next' ELSE next_step END ELSE next_step END AS next_step,
CASE WHEN id % 3 = 0 AND id % 7 = 0 THEN DATE '2000-01-02' ELSE due_at END AS due_at, CASE WHEN id % 3 = 0 THEN {_AT} ELSE updated_at END AS updated_at FROM tasks"""
)
def task_update_patch(spark, sf):
    """Updates that set, clear and keep; half of their ids do not exist."""
    t, i = load(spark, sf, "tasks"), F.col("id")
    u = t.filter("id % 3 = 0").select("id", F.when(i % 4 == 0, "Done ").when(i % 4 == 1, "dropped").when(i % 4 == 2, "odd").alias("status"), F.when(i % 5 == 0, "-").when(i % 5 == 1, "next").otherwise("").alias("next_step"), F.when(i % 7 == 0, "2000-01-02").alias("due_at"))
    u = u.unionByName(u.withColumn("id", -F.col("id") - 1))
    return state.update_tasks(t, u, F.lit("2024-01-15").cast(t.schema["updated_at"].dataType)).select("id", "status", "next_step", "due_at", "updated_at")


def _sessions(spark, sf):
    """Every conversation is a session of the space 1 + conv_id % 3. Its raws wait
    in two windows or more, one for four turns; the model finds a note in every
    turn of the assistant, a relation to each note and one to none, a task, and an
    update of the task that has the number of the conversation. The first answer
    of every fifth is broken. Notes of every third are there, soft-deleted."""
    c = load(spark, sf, "conversations").filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    c = c.withColumn("t", text.trim_all(F.col("text"))).filter("t <> ''").withColumn("space", 1 + F.col("conv_id") % 3)
    none = lambda *names: [F.lit(None).cast(dict(x.split(" ", 1) for x in extraction.SCHEMAS["notes"].split(", "))[n]).alias(n) for n in names]
    at = F.lit("2024-01-01").cast("timestamp")
    was = c.filter("conv_id % 3 = 0").groupBy("space", "t").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    notes = was.select(
        "id", F.col("space").cast("long").alias("space_id"), F.lit("note").alias("kind"), F.col("t").alias("text"), F.array(F.lit("was")).alias("tags"), F.lit("tool:remember").alias("source"), *none("session_id"),
        state.content_hash(F.col("space"), F.lit("note"), F.col("t")).alias("content_hash"), at.alias("created_at"), at.alias("updated_at"), at.alias("deleted_at"), F.lit("active").alias("status"), *none("project", *extraction.META),
    )
    tasks = load(spark, sf, "tasks").withColumns({"due_at": F.col("due_at").cast("string"), **{x: F.lit(None).cast("string") for x in ("why", "owner", "constraints")}}).select(*spark.createDataFrame([], extraction.SCHEMAS["tasks"]).columns)
    relations = load(spark, sf, "relations")
    raws = load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("seq"), F.lit(None).cast("timestamp").alias("extracted_at"))
    note = F.struct(F.lit("Note").alias("kind"), F.col("t").alias("text"), F.array(F.concat(F.lit("t"), (F.col("turn") % 2).cast("string"))).alias("tags"))
    per = c.groupBy(F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 4).cast("int").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct("turn", note.alias("n")))).alias("n"))
    per = per.withColumn("n", F.transform("n", lambda x: x["n"]))
    rel = F.transform(F.sequence(F.lit(0), F.size("n")), lambda i: F.struct(F.col("session_id").cast("string").alias("from"), F.col("ordinal").cast("string").alias("to"), i.cast("string").alias("type"), i.alias("note_index")))
    task = F.array(F.struct(F.concat(F.lit("do "), (F.col("session_id") % 50).cast("string")).alias("title"), F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("next_step")))
    upd = F.array(F.struct(F.col("session_id").alias("id"), F.lit("Done").alias("status")))
    out = F.to_json(F.struct(F.col("n").alias("notes"), task.alias("tasks"), upd.alias("task_updates"), rel.alias("relations")))
    broken = (F.col("session_id") % 5 == 0) & (F.col("ordinal") == 0)
    outputs = per.select("session_id", "ordinal", F.when(broken, "{broken").otherwise(out).alias("output"))
    sessions = outputs.select("session_id").distinct().select("session_id", (1 + F.col("session_id") % 3).cast("long").alias("space_id"), F.lit(None).cast("string").alias("project"))
    vectors = spark.createDataFrame([], extraction.SCHEMAS["vectors"])
    tables = {"notes": notes, "tasks": tasks, "relations": relations, "raws": raws, "vectors": vectors}
    now = F.lit("2024-05-01").cast("timestamp")
    shown = written(extraction.shown_tasks(tasks, sessions), "query-shown")
    return extraction.changes(tables, sessions, outputs, shown, partial(memory.hash_embedder, dim=32), now)


_TRIM = "regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g')"
_ASKED = f"""c AS (SELECT conv_id, turn, {_TRIM} AS t, 1 + conv_id % 3 AS space, turn // 4 AS ordinal FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL) WHERE {_TRIM} <> ''),
broken AS (SELECT DISTINCT conv_id FROM c WHERE conv_id % 5 = 0 AND ordinal = 0),
good AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, row_number() OVER (PARTITION BY conv_id, ordinal ORDER BY turn) - 1 AS i, row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) > 1 AS skip, sha256(concat(space, '|note|', t)) AS h FROM c WHERE conv_id NOT IN (FROM broken)),
was AS (SELECT DISTINCT space, t FROM c WHERE conv_id % 3 = 0)"""


@query(f"WITH {_ASKED} SELECT g.space::BIGINT AS space_id, h AS content_hash, w.t IS NULL AS fresh, array_to_string(list_sort(list_distinct(list(concat('t', turn % 2)) || CASE WHEN any_value(w.t) IS NULL THEN [] ELSE ['was'] END)), ',') AS tags FROM good g LEFT JOIN was w ON w.space = g.space AND w.t = g.t WHERE NOT skip GROUP BY g.space, h, w.t")
def extraction_notes(spark, sf):
    """The notes that extractions write and refresh."""
    n = _sessions(spark, sf).puts["notes"]
    return n.select("space_id", "content_hash", (F.col("created_at") == F.col("updated_at")).alias("fresh"), F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_ASKED}, n AS (SELECT conv_id, ordinal, space, count(*) AS n FROM good GROUP BY ALL), r AS (SELECT conv_id, ordinal, space, unnest(range(n + 1)) AS i FROM n) SELECT r.space::BIGINT AS space_id, r.conv_id::VARCHAR AS from_ref, r.ordinal::VARCHAR AS to_ref, r.i::VARCHAR AS rel_type, CASE WHEN NOT skip THEN h END AS note FROM r LEFT JOIN good g ON g.conv_id = r.conv_id AND g.ordinal = r.ordinal AND g.i = r.i")
def extraction_relations(spark, sf):
    """Their relations, each with the note of its place."""
    x = _sessions(spark, sf).puts
    return x["relations"].join(x["notes"].select(F.col("id").alias("source_note_id"), F.col("content_hash").alias("note")), "source_note_id", "left").select("space_id", "from_ref", "to_ref", "rel_type", "note")


@query(
    cte("tasks")
    + f""", {_ASKED},
s AS (SELECT DISTINCT conv_id, space FROM good),
new AS (SELECT space, concat('do ', conv_id % 50) AS title, min(conv_id) AS first FROM s GROUP BY ALL),
shown AS (SELECT space_id, id FROM (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY CASE WHEN coalesce(project, '') = '' THEN 0 ELSE 1 END, updated_at DESC, id) AS nth FROM tasks WHERE status = 'open') WHERE nth <= 60)
SELECT (SELECT max(id) FROM tasks) + row_number() OVER (ORDER BY first) AS id, space::BIGINT AS space_id, title, 'open' AS status, concat('s', first) AS next_step FROM new
UNION ALL SELECT t.id, t.space_id, title, 'done', next_step FROM tasks t JOIN shown USING (id) JOIN s ON conv_id = t.id AND s.space = t.space_id"""
)
def extraction_tasks(spark, sf):
    """The tasks that they make and end; only tasks that a session was shown end."""
    return _sessions(spark, sf).puts["tasks"].select("id", "space_id", "title", "status", "next_step")


@query(f"WITH {_ASKED} SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE conv_id IN (SELECT conv_id FROM good) GROUP BY conv_id")
def extraction_raws(spark, sf):
    """The raws that are marked: those of sessions without a broken answer."""
    return _sessions(spark, sf).puts["raws"].groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH f AS (SELECT conv_id AS session_id, turn, coalesce(sum(strlen(text) + 1) OVER w, 0) AS a, strlen(text) + 1 AS n, text FROM (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM f),
l AS (SELECT session_id, min(i) AS stop FROM g WHERE session_id % 3 = 0 AND i = 3 GROUP BY session_id)
SELECT session_id, i::INT AS seq, a::BIGINT AS expect_offset, (a + n)::BIGINT AS new_offset FROM g LEFT JOIN l USING (session_id) WHERE stop IS NULL OR i < stop"""
)
def spool_replay(spark, sf):
    """The turns of conversations as spooled deltas, each twice; of every third session the third is lost, so what follows it is dropped."""
    c = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id"), "turn").agg(F.any_value("text").alias("text"))
    w = Window.partitionBy("session_id").orderBy("turn")
    n = F.octet_length("text") + 1
    d = c.withColumns({"i": F.row_number().over(w), "new_offset": F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("expect_offset", F.col("new_offset") - n)
    d = d.filter(~((F.col("session_id") % 3 == 0) & (F.col("i") == 3)))
    line = F.to_json(F.struct("session_id", "expect_offset", "new_offset", F.col("text").alias("content")))
    spool = d.select(line.alias("line"))
    spool = spool.unionByName(spool).unionByName(spark.createDataFrame([("no json",), ("{}",)], "line string"))
    none = spark.createDataFrame([], capture.Raws.SCHEMA)
    return capture.replay_spool(none, spool).drop("content")


@query(
    """SELECT user_id, min(ts) AS first_at, (strftime(min(ts) - INTERVAL 4 HOUR, '%Y-%m-%d')::DATE)::VARCHAR AS day,
  CASE WHEN user_id % 4 = 0 THEN date_trunc('day', min(ts) - INTERVAL 4 HOUR) - INTERVAL 3 DAY ELSE date_trunc('day', min(ts) - INTERVAL 4 HOUR) - INTERVAL 1 DAY END + INTERVAL 4 HOUR AS from_at,
  date_trunc('day', min(ts) - INTERVAL 4 HOUR) + INTERVAL 4 HOUR AS to_at FROM events GROUP BY user_id"""
)
def captured_window(spark, sf):
    """Users briefed three days ago, today, nine days ago or never."""
    e = load(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"))
    kind = e.schema["first_at"].dataType
    day = dates.work_day(F.col("first_at"))
    i = F.col("user_id") % 4
    last = F.when(i == 0, F.date_sub(day, 3)).when(i == 1, day).when(i == 2, F.date_sub(day, 9))
    a, b = memory.captured_window(F.col("first_at"), last)
    return e.select("user_id", "first_at", day.cast("string").alias("day"), a.cast(kind).alias("from_at"), b.cast(kind).alias("to_at"))


@query("SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',') AS v FROM embeddings WHERE vec_id % 9 <> 0")
def legacy_vectors(spark, sf):
    """Vectors stored as 32-bit floats; every ninth lost its last byte and is left out."""
    e = load(spark, sf, "embeddings")

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.asarray(v, "<f4").tobytes())

    blob = packed("embedding")
    rows = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, F.substring(blob, F.lit(1), F.octet_length(blob) - 1)).otherwise(blob).alias("b"))
    got = rows.select("id", vectors.legacy_vector(F.col("b"), 64).alias("v")).filter("v is not null")
    return got.select("id", F.array_join(F.transform("v", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias("v"))


@query(cte("notes") + " SELECT id FROM notes WHERE status = 'active' AND deleted_h IS NULL AND space_id IN (1, 3) AND kind IN ('fact', 'note') AND lang = 'en' AND project = 'src0'")
def note_filter(spark, sf):
    n = load(spark, sf, "notes").withColumn("tags", F.array("lang", "tag2"))
    return search.allowed_notes(n, [1, 3], ["fact", "note"], ["en"], "src0").select("id")


@query("SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS project FROM pages WHERE regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) <> ''")
def project_from_directory(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^https?://[^/]+|[?#].*$", "").alias("path"))
    first = F.regexp_extract("path", "^(/[^/]+)", 1)
    return p.select("page_id", writing.project_of(first).alias("project")).filter("project <> ''")


@query(cte("jobs") + " SELECT type, max(id) AS last_id, max(ts) AS last_at, count(*) AS n FROM (SELECT *, run_after AS ts FROM jobs) WHERE state IN ('queued', 'failed', 'running') GROUP BY type")
def pending_by_type(spark, sf):
    """The work that waits, per type."""
    j = load(spark, sf, "jobs").filter(F.col("state").isin("queued", "failed", "running"))
    return j.groupBy("type").agg(F.max("id").alias("last_id"), F.max("run_after").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT event_id AS id, (props->>'k')::INT AS k FROM events)
SELECT id, CASE id % 3 WHEN 0 THEN NULL ELSE k::VARCHAR END AS why, CASE WHEN id % 3 = 1 THEN 'new' ELSE 'old' END AS who FROM e"""
)
def meta_merge_patch(spark, sf):
    """Patches that set a field and add one, that clear one, and empty ones."""
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"))
    old = F.to_json(F.struct(F.col("k").alias("why"), F.lit("old").alias("who")))
    patch = F.when(F.col("id") % 3 == 0, F.lit('{"why":null}')).when(F.col("id") % 3 == 1, F.lit('{"who":"new","x":{"y":1}}')).otherwise(F.lit("{}"))
    out = e.select("id", writing.merge_patch(old, patch).alias("m"))
    return out.select("id", F.get_json_object("m", "$.why").alias("why"), F.get_json_object("m", "$.who").alias("who"))


@query("SELECT user_id, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE max(ts) + INTERVAL 7 DAY <= TIMESTAMP '2024-02-04 12:00:00' END AS due FROM events GROUP BY user_id")
def consolidate_due(spark, sf):
    """Whether each user's notes are due: never consolidated, a broken mark, or seven days ago."""
    e = load(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    last = F.when(F.col("user_id") % 3 == 1, "broken").when(F.col("user_id") % 3 == 2, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select("user_id", dates.due_again(last, 7, F.lit("2024-02-04 12:00:00").cast("timestamp")).alias("due"))


@query(cte("notes") + f" SELECT id, {_fill(_NORM_SQL, c='text')} AS norm FROM notes WHERE kind IN ('decision', 'fact')")
def norm_texts(spark, sf):
    return load(spark, sf, "notes").filter(F.col("kind").isin("decision", "fact")).select("id", text.norm_title(F.col("text")).alias("norm"))


@query(
    """WITH t AS (SELECT conv_id, turn, role FROM conversations),
o AS (SELECT conv_id AS id, min(role) AS client, conv_id % 3 AS space_id, min(turn) AS started_at, max(turn) AS last_seen_at, CASE WHEN conv_id % 4 = 0 THEN '/old' END AS cwd FROM t WHERE turn < 2 AND conv_id % 2 = 0 GROUP BY conv_id),
n AS (SELECT conv_id AS id, arg_min(role, turn * 100 + ascii(role)) AS client, conv_id % 5 AS space_id, min(turn) AS started_at, max(turn) AS last_seen_at, '/new' AS cwd FROM t WHERE turn >= 1 GROUP BY conv_id)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.client, n.client) AS client, coalesce(o.space_id, n.space_id) AS space_id, coalesce(o.started_at, n.started_at) AS started_at, greatest(o.last_seen_at, n.last_seen_at) AS last_seen_at, coalesce(o.cwd, n.cwd) AS cwd FROM o FULL JOIN n ON o.id = n.id"""
)
def session_upsert(spark, sf):
    """The first turns of even conversations are the stored sessions, all later turns are sights of them."""
    c = load(spark, sf, "conversations")
    base = lambda df, cwd, m: df.select(F.col("conv_id").alias("id"), F.col("role").alias("client"), (F.col("conv_id") % m).alias("space_id"), F.col("turn").alias("started_at"), F.col("turn").alias("last_seen_at"), cwd.alias("cwd"), F.lit(None).cast("string").alias("project"))
    old = base(c.filter("turn < 2 and conv_id % 2 = 0"), F.when(F.col("conv_id") % 4 == 0, "/old"), 3)
    old = old.groupBy("id", "space_id", "cwd", "project").agg(F.min("client").alias("client"), F.min("started_at").alias("started_at"), F.max("last_seen_at").alias("last_seen_at"))
    new = base(c.filter("turn >= 1"), F.lit("/new"), 5)
    return memory.upsert_sessions(old.select(*new.columns), new).drop("project")


@query("SELECT o_orderkey AS id, md5(concat(o_orderpriority, o_orderkey)) AS content FROM orders")
def raws_gunzip(spark, sf):
    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda t: gzip.compress(t.encode()))

    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), packed(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("content"))
    return memory.gunzip(o).select("id", F.md5("content").alias("content"))


@query(
    """WITH b AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey < 18 THEN 'fact' ELSE 'decision' END AS kind, n_regionkey FROM nation),
m AS (SELECT n_regionkey AS merge_id, 'fact' AS kind, CASE WHEN n_regionkey = 0 THEN ' ' ELSE 't' END AS text, list_sort(list(id)) AS ids FROM b GROUP BY n_regionkey)
SELECT merge_id, CASE WHEN text = ' ' THEN 'text' WHEN len(ids) < 2 THEN 'few' WHEN (SELECT count(DISTINCT kind) FROM b WHERE list_contains(m.ids, b.id)) > 1 THEN 'kind' END AS error FROM m"""
)
def merges_checked(spark, sf):
    n = load(spark, sf, "nation")
    batch = n.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") < 18, "fact").otherwise("decision").alias("kind"), "n_regionkey")
    merges = batch.groupBy(F.col("n_regionkey").alias("merge_id")).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumns({"kind": F.lit("fact"), "text": F.when(F.col("merge_id") == 0, " ").otherwise("t")})
    return memory.valid_merges(merges, batch).select("merge_id", "error")


@query("SELECT o_custkey AS batch, count(*) AS size, count(*) FILTER (WHERE o_orderstatus = 'F') AS removed, count(*) >= 8 AND 2 * count(*) FILTER (WHERE o_orderstatus = 'F') > count(*) AS skip FROM orders GROUP BY o_custkey")
def merges_guarded(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("o_orderstatus") == "F").alias("removed"))
    return reports.merge_guard(o, F.col("removed"))


@query(
    """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, count(*) AS n_events, min(ts) AS started_at, max(ts) AS last_seen_at FROM s GROUP BY user_id, no"""
)
def session_windows(spark, sf):
    """The sessions of the stream, over the whole table at once."""
    e = load(spark, sf, "events")
    kind = e.schema["ts"].dataType
    return capture.sessions(e).withColumns({c: F.col(c).cast(kind) for c in ("started_at", "last_seen_at")})


@query(
    """WITH m AS (SELECT DISTINCT CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('/media/', source, '/', doc_id % 700) END AS path FROM documents),
f AS (SELECT concat('/media/', source, '/', doc_id) AS path FROM documents WHERE doc_id % 11 <> 0)
SELECT 'keys of documents' AS name, CASE WHEN count(*) = count(DISTINCT doc_id) THEN 'ok' ELSE 'fail' END AS state, (count(*) - count(DISTINCT doc_id))::BIGINT AS n FROM documents
UNION ALL SELECT 'keys of conversations', CASE WHEN count(*) = count(DISTINCT conv_id) THEN 'ok' ELSE 'fail' END, (count(*) - count(DISTINCT conv_id))::BIGINT FROM conversations
UNION ALL SELECT 'schema version', 'fail', 1::BIGINT
UNION ALL SELECT 'media files', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM m WHERE path <> '' AND path NOT IN (SELECT path FROM f)"""
)
def doctor_checks(spark, sf):
    """Turns are no key of conversations, and one version is missing; media lie under the sources of documents."""
    d = load(spark, sf, "documents")
    path = lambda i: F.concat(F.lit("/media/"), "source", F.lit("/"), i.cast("string"))
    media = d.select(F.when(F.col("doc_id") % 9 == 0, "").otherwise(path(F.col("doc_id") % 700)).alias("path"))
    files = d.filter("doc_id % 11 <> 0").select(path(F.col("doc_id")).alias("path"))
    return reports.doctor_checks({"documents": (d, "doc_id"), "conversations": (load(spark, sf, "conversations"), "conv_id")}, media, files, 4, 5)



@query("SELECT substr(c_name, 1, 14) AS prefix, max(c_mktsegment) AS value, count(*) AS n FROM customer WHERE c_name LIKE 'Customer#00000%' GROUP BY 1 HAVING prefix = 'Customer#00000'")
def meta_max_of_prefix(spark, sf):
    meta = load(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return memory.max_of_prefix(meta, "Customer#00000").filter("n > 0").select(F.lit("Customer#00000").alias("prefix"), "value", "n")


@query(
    """WITH m AS (SELECT n_name AS key, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey::VARCHAR ELSE 'none' END AS value FROM nation WHERE n_nationkey % 4 <> 0),
a AS (SELECT n_name AS key, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT coalesce(m.key, a.key) AS key, CASE WHEN a.n IS NULL THEN m.value ELSE (coalesce(try_cast(m.value AS BIGINT), 0) + a.n)::VARCHAR END AS value FROM m FULL JOIN a ON m.key = a.key"""
)
def meta_increment(spark, sf):
    """A counter per nation is raised by one per supplier."""
    n, s = load(spark, sf, "nation"), load(spark, sf, "supplier")
    meta = n.filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).otherwise("none").alias("value"))
    adds = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"), F.lit(1).cast("long").alias("n"))
    return memory.increment(meta, adds)


@query("SELECT conv_id AS session_id, count(*) AS n, min(turn + 1) AS first_seq, max(turn + 1) AS last_seq, sum(strlen(text))::BIGINT AS bytes FROM conversations WHERE turn >= 2 GROUP BY conv_id")
def raws_pending(spark, sf):
    """The first two turns of each conversation are extracted; what waits."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("seq"), F.octet_length("text").cast("long").alias("bytes"), F.lit(None).cast("timestamp").alias("extracted_at"))
    return memory.pending_raws(memory.mark_extracted(c, c.filter("seq <= 2"), F.lit("2024-01-15").cast("timestamp")))


def _packed(batches):
    """Office files of texts: a slide deck, a document or a book of their lines."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    for pdf in batches:
        out = []
        for path, lines in zip(pdf["path"], pdf["lines"], strict=True):
            lines = [escape(x) for x in lines]
            if path.endswith("pptx"):
                files = {f"ppt/slides/slide{i}.xml": f'<sld xmlns:a="urn:a"><a:p><a:r><a:t>{x}</a:t></a:r></a:p></sld>' for i, x in enumerate(lines, 1)}
            elif path.endswith("docx"):
                files = {"word/document.xml": '<w:document xmlns:w="urn:w">' + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:document>"}
            else:
                items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(lines)))
                order = "".join(f'<itemref idref="c{i}"/>' for i in range(len(lines)))
                files = {"META-INF/container.xml": '<container><rootfile full-path="b/p.opf"/></container>', "b/p.opf": f"<package><manifest>{items}</manifest><spine>{order}</spine></package>"}
                files |= {f"b/c{i}.xhtml": f"<html><body><p>{x}</p></body></html>" for i, x in enumerate(lines)}
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for name, body in files.items():
                    z.writestr(name, body)
            out.append(held.getvalue())
        yield pd.DataFrame({"path": pdf["path"], "content": out})


_LINES = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E\\n]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')"


@query(
    f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page, unnest(l) AS text FROM d WHERE doc_id % 3 <> 1)
SELECT concat(doc_id, CASE doc_id % 3 WHEN 0 THEN '.pptx' ELSE '.epub' END) AS path, page::INTEGER AS page, concat(CASE doc_id % 3 WHEN 0 THEN 'slide ' ELSE 'chapter ' END, page) AS label, md5(text) AS text, NULL AS error FROM p
UNION ALL SELECT concat(doc_id, '.docx'), 1, NULL, md5(array_to_string(l, chr(10) || chr(10))), NULL FROM d WHERE doc_id % 3 = 1 AND len(l) > 0
UNION ALL SELECT concat(doc_id, CASE doc_id % 3 WHEN 0 THEN '.pptx' WHEN 1 THEN '.docx' ELSE '.epub' END), 0, NULL, NULL, 'empty' FROM d WHERE len(l) = 0"""
)
def document_pages(spark, sf):
    """All texts as slide decks, documents and books, read again page by page."""
    d = load(spark, sf, "documents")
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\n]", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".pptx", ".docx", ".epub"))), (F.col("doc_id") % 3 + 1).cast("int"))
    files = spread(d.select(F.concat(F.col("doc_id").cast("string"), ext).alias("path"), lines.alias("lines"))).mapInPandas(_packed, "path string, content binary")
    return documents.pages_of(files).select("path", "page", "label", F.md5("text").alias("text"), "error")


@query(f"SELECT doc_id AS id, ((length(text) + 3) // 4)::BIGINT AS tokens, len({_tokens('text')})::BIGINT AS words, {_fill(_NORM_SQL, c='left(text, 80)')} AS title FROM documents")
def sql_functions(spark, sf):
    """A query in SQL alone, over the registered functions."""
    sql.register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("lf_documents")
    return spark.sql("SELECT doc_id AS id, lf_est_tokens(text) AS tokens, CAST(size(lf_fts_tokens(text)) AS BIGINT) AS words, lf_norm_title(left(text, 80)) AS title FROM lf_documents")


@query()
def sql_chunks(spark, sf):
    """The chunks of all texts by the table function; chunk_documents has the same by the operator."""
    sql.register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("lf_documents")
    return spark.sql("SELECT doc_id AS id, c.ordinal, c.token_count, md5(c.text) AS text FROM lf_documents, LATERAL lf_chunk_text(text) c")


@query(
    cte("jobs")
    + """, n AS (SELECT DISTINCT k AS id FROM jobs WHERE state IN ('queued', 'failed', 'running') AND type = 'click')
SELECT event_id AS id, CASE WHEN event_id IN (SELECT id FROM n) THEN NULL ELSE ts END AS extracted_at FROM events"""
)
def migrate_extracted_raws(spark, sf):
    """The step that marks old raws: jobs of one type name raws in their payloads."""
    jobs = load(spark, sf, "jobs").select(F.when(F.col("type") == "click", "extract_session").otherwise(F.col("type")).alias("type"), "state", F.to_json(F.struct(F.col("k").alias("raw_id"))).alias("payload"))
    raws = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return migrations.extracted_raws({"jobs": jobs, "raws": raws})["raws"].select("id", "extracted_at")


@query(
    """WITH d AS (SELECT doc_id, concat('/in/', coalesce(source, ''), '/Doc ', doc_id, '.txt') AS path, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'note' WHEN 2 THEN 'fact' WHEN 3 THEN '' ELSE 'caption' END AS kind, coalesce(text, '') AS text, lang FROM documents),
e AS (SELECT *, CASE WHEN kind = 'caption' THEN 'kind: caption' WHEN doc_id % 7 = 0 THEN 'no such file' WHEN regexp_replace(text, '[\\s\\v]+', '', 'g') = '' THEN 'empty' END AS error FROM d)
SELECT path, CASE WHEN error IS NULL THEN CASE WHEN coalesce(kind, '') = '' THEN 'document' ELSE kind END END AS kind, CASE WHEN error IS NULL THEN concat(lang, ',file:doc-', doc_id) END AS tags,
  CASE WHEN error IS NULL THEN concat('Doc ', doc_id, '.txt') END AS title, error FROM e"""
)
def ingest_files(spark, sf):
    """All documents as files: what is written of them, and what is refused and why. Every seventh is not there."""
    d = load(spark, sf, "documents")
    i, path = F.col("doc_id"), F.concat(F.lit("/in/"), F.coalesce("source", F.lit("")), F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".txt"))
    kind = F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, "note").when(i % 5 == 2, "fact").when(i % 5 == 3, "").otherwise("caption")
    asked = d.select(path.alias("path"), F.lit(1).cast("long").alias("space_id"), kind.alias("kind"), F.array("lang").alias("tags"), i.alias("at"), i.alias("seq"))
    files = spread(d.filter("doc_id % 7 <> 0").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))
    texts = files.mapInPandas(documents._read, "path string, text string, error string")
    writes, refused = writing.ingest(asked, texts)
    done = writes.select(F.col("ref").alias("path"), "kind", F.array_join("tags", ",").alias("tags"), "title", F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast("string").alias(c) for c in ("kind", "tags", "title")]
    return done.unionByName(refused.select("path", *none, "error"))
