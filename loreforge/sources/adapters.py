"""The memory tables derived from generic analytics tables, as (Spark SQL that
DuckDB reads too) text over the parquet files. One text serves both engines, so
the oracle of a query starts from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Expressions are kept to what both dialects share.
NOTES = """
SELECT doc_id AS id, 1 + doc_id % 3 AS space_id,
  CASE doc_id % 9 WHEN 0 THEN 'note' WHEN 1 THEN 'fact' WHEN 2 THEN 'preference' WHEN 3 THEN 'decision' WHEN 4 THEN 'document'
    WHEN 5 THEN 'procedure' WHEN 6 THEN 'task_hint' WHEN 7 THEN 'transcript' ELSE 'caption' END AS kind,
  text, lang, source AS tag2, CASE WHEN doc_id % 4 = 0 THEN 'hook:stop' WHEN doc_id % 4 = 1 THEN 'tool:remember' ELSE concat('ingest:', source) END AS source,
  CASE WHEN doc_id % 2 = 0 THEN source END AS project,
  CASE WHEN doc_id % 23 = 5 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN concat('because ', lang) END AS why,
  doc_id AS created_h, doc_id + 24 * (doc_id % 400) AS updated_h,
  CASE WHEN doc_id % 17 = 0 THEN doc_id + 24 * (doc_id % 400) + 24 END AS deleted_h
FROM documents
"""

TASKS = """
SELECT o_orderkey AS id, 1 + o_custkey % 3 AS space_id, concat(o_orderpriority, ' Task: #', CAST(o_orderkey % 50 AS varchar(9)), '!') AS title,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'dropped' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('step ', CAST(o_orderkey % 7 AS varchar(9))) END AS next_step,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('person ', CAST(o_orderkey % 5 AS varchar(9))) END AS waiting_on,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS date) END AS due_at,
  CASE WHEN o_custkey % 7 = 0 THEN 'P1' WHEN o_custkey % 7 = 1 THEN 'p1' WHEN o_custkey % 7 = 2 THEN 'p1-web' WHEN o_custkey % 7 < 6 THEN concat('p', CAST(o_custkey % 7 AS varchar(9))) END AS project,
  o_orderdate AS created_at, o_orderdate + INTERVAL '1' DAY AS updated_at
FROM orders
"""

JOBS = """
SELECT event_id AS id, event_type AS type, k, CASE k % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'dead' END AS state,
  k % 6 AS attempts, ts AS run_after, ts AS updated_at, props AS payload
FROM (SELECT *, CAST(replace(replace(props, '{"k": ', ''), '}', '') AS int) AS k FROM events) e
"""

USAGE = """
SELECT event_id AS id, ts, event_type AS op, CASE WHEN user_id % 2 = 0 THEN 'small' ELSE 'large' END AS model,
  CASE user_id % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'extract' ELSE 'summary' END AS purpose,
  CAST(round(value * 200) AS bigint) AS latency_ms, CAST(k * 397 AS bigint) AS prompt_tokens, CAST(k * 31 AS bigint) AS completion_tokens,
  CASE WHEN k % 4 = 0 THEN CAST(-1 AS bigint) ELSE CAST(k * 97 AS bigint) END AS cached_tokens, CAST(k * 3301 AS bigint) AS bytes, event_type = 'error' AS failed
FROM (SELECT *, CAST(replace(replace(props, '{"k": ', ''), '}', '') AS int) AS k FROM events) e
"""

EPISODES = """
SELECT conv_id AS session_id, 1 + conv_id % 3 AS space_id, turn + 1 AS seq, substring(text, 1, 80) AS summary, conv_id * 60 + turn AS at_m FROM conversations WHERE role = 'assistant'
"""

RELATIONS = """
SELECT l_orderkey * 10 + l_linenumber AS id, 1 + l_orderkey % 3 AS space_id, concat('part:', CAST(l_partkey % 40 AS varchar(20))) AS from_ref, concat('supplier:', CAST(l_suppkey % 10 AS varchar(20))) AS to_ref,
  l_returnflag AS rel_type, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 1000 END AS source_note_id, l_shipdate AS created_at
FROM lineitem
"""

TABLES = {"notes": NOTES, "tasks": TASKS, "jobs": JOBS, "usage": USAGE, "episodes": EPISODES, "relations": RELATIONS}
_OVER = {"notes": ["documents"], "tasks": ["orders"], "jobs": ["events"], "usage": ["events"], "episodes": ["conversations"], "relations": ["lineitem"]}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A memory table, or a file's own table."""
    if table not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")
    sql = TABLES[table]
    for base in _OVER[table]:
        sql = sql.replace(f"FROM {base}", f"FROM {{{base}}}")
    sql = sql.replace('{"k": ', '{{"k": ').replace("'}'", "'}}'")
    return spark.sql(sql, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in _OVER[table]})


def cte(*tables: str) -> str:
    """The same tables as the beginning of a DuckDB query."""
    return "WITH " + ",\n".join(f"{t} AS ({TABLES[t]})" for t in tables)
