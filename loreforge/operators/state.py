"""Changes to the memory tables, each a pure function from a table's rows and a
batch of changes to its new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.dates import backoff_seconds, cutoff
from loreforge.functions.text import norm_title, trim_all

EVENT_KINDS = ("note", "task_hint", "transcript", "caption")
KNOWLEDGE_KINDS = ("decision", "fact", "preference", "procedure")
MAX_ATTEMPTS = 5


def content_hash(space: Column, kind: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", space.cast("string"), kind, trim_all(text)), 256)


def fold_notes(writes: DataFrame) -> DataFrame:
    """Writes of notes (space_id, kind, text, tags, project, why, at, seq) folded
    to one row per note: the last why that is not null, all tags, the first
    project, first and last time."""
    # `at, seq` order the writes; struct minima and maxima skip the nulls
    rows = writes.withColumns({"content_hash": content_hash(F.col("space_id"), F.col("kind"), F.col("text")), "o": F.struct("at", "seq")})
    pick = lambda f, c: f(F.when(F.col(c).isNotNull(), F.struct("o", c)))[c]
    return rows.groupBy("space_id", "content_hash").agg(
        F.min("kind").alias("kind"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        pick(F.min, "project").alias("project"),
        pick(F.max, "why").alias("why"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.count(F.lit(1)).alias("n_writes"),
    )


def upsert_notes(state: DataFrame, writes: DataFrame) -> DataFrame:
    """Notes after a batch of writes: a note met again is refreshed (updated,
    revived, tags joined, last why, first project), a new one is added. The hash
    of its space, kind and trimmed text is its identity."""
    new = fold_notes(writes)
    old = state.select([F.col(c).alias(f"old_{c}") if c not in ("space_id", "content_hash") else F.col(c) for c in new.columns if c != "n_writes"])
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("now", F.lit(True)), ["space_id", "content_hash"], "full_outer")
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    tags = F.array_sort(F.array_union(F.coalesce("old_tags", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))))
    return both.select(
        "space_id",
        "content_hash",
        either("old_kind", "kind").alias("kind"),
        tags.alias("tags"),
        either("old_project", "project").alias("project"),
        either("why", "old_why").alias("why"),
        either("old_created_at", "created_at").alias("created_at"),
        either("updated_at", "old_updated_at").alias("updated_at"),
        F.col("was").isNull().alias("fresh"),
    )


def merge_tasks(tasks: DataFrame) -> DataFrame:
    """Open tasks as inserted one by one: those with one space, project and
    normalised title are the lowest id's, whose blanks the later ones fill, the
    first that is not null winning."""
    open_ = tasks.filter("status = 'open'").withColumns({"norm": norm_title(F.col("title")), "proj": F.coalesce("project", F.lit(""))})
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("id", c)))[c].alias(c)
    return open_.groupBy("space_id", "proj", "norm").agg(F.min("id").alias("id"), first("next_step"), first("waiting_on"), first("due_at"), F.count(F.lit(1)).alias("n_merged"))


TASK_FIELDS = ("next_step", "why", "owner", "waiting_on", "due_at", "constraints")


def insert_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """The task table after new ones (seq, space_id, title, project, TASK_FIELDS)
    are inserted in the order of seq. One whose space, project and normalised
    title an open task has fills only that one's blanks, also where that one is
    new itself; the first value that is not null wins. Fresh tasks are open and
    get ids on from the greatest, in the order of seq. Returns id, space_id,
    project, title, status, TASK_FIELDS and fresh; null and '' projects are one."""
    fields = [f for f in TASK_FIELDS if f in tasks.columns]
    key = ["space_id", "proj", "norm"]
    keyed = lambda df: df.withColumns({"proj": F.coalesce("project", F.lit("")), "norm": norm_title(F.col("title"))})
    rows = keyed(new)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(f"new_{c}")
    folded = rows.groupBy(*key).agg(F.min("seq").alias("seq"), F.min_by("title", "seq").alias("new_title"), *(first(f) for f in fields))
    have = keyed(tasks.filter("status = 'open'")).groupBy(*key).agg(F.min("id").alias("hit"))
    met = folded.join(have, key, "left")
    fill = met.filter("hit is not null").select(F.col("hit").alias("id"), *(f"new_{f}" for f in fields))
    old = tasks.join(fill, "id", "left").select("id", "space_id", "project", "title", "status", *(F.coalesce(f, f"new_{f}").alias(f) for f in fields), F.lit(False).alias("fresh"))
    last = tasks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # new tasks of one batch are numbered together; a batch is small against the table
    nth = F.row_number().over(Window.orderBy("seq"))
    fresh = met.filter("hit is null").withColumn("nth", nth).crossJoin(F.broadcast(last))
    fresh = fresh.select((F.col("last") + F.col("nth")).alias("id"), "space_id", F.when(F.col("proj") != "", F.col("proj")).alias("project"), F.col("new_title").alias("title"), F.lit("open").alias("status"), *(F.col(f"new_{f}").alias(f) for f in fields), F.lit(True).alias("fresh"))
    return old.unionByName(fresh)


def patch(old: Column, given: Column) -> Column:
    """'' or null keeps, '-' clears, else sets."""
    return F.when(F.coalesce(given, F.lit("")) == "", old).when(given == "-", None).otherwise(given)


def update_tasks(tasks: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """The task table after updates (id, status and any of TASK_FIELDS; null or ''
    keeps, '-' clears), one per task. A status other than open, done and dropped
    is ignored; updated_at is now where a task has an update at all. Updates of
    ids that do not exist change nothing."""
    fields = [f for f in TASK_FIELDS if f in tasks.columns and f in updates.columns]
    given = updates.select("id", F.lower(F.trim("status")).alias("u_status"), *(F.col(f).cast("string").alias(f"u_{f}") for f in fields), F.lit(True).alias("hit"))
    rows = tasks.join(given, "id", "left")
    changed = {f: patch(F.col(f).cast("string"), F.col(f"u_{f}")).cast(tasks.schema[f].dataType) for f in fields}
    changed["status"] = F.when(F.col("u_status").isin("open", "done", "dropped"), F.col("u_status")).otherwise(F.col("status"))
    changed["updated_at"] = F.when(F.col("hit"), now).otherwise(F.col("updated_at"))
    return rows.withColumns(changed).select(*tasks.columns)


def jobs_to_run(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that can be claimed: queued or failed and due, or running for more
    than 30 minutes without news."""
    due = F.col("state").isin("queued", "failed") & (F.col("run_after") <= now)
    stale = (F.col("state") == "running") & (F.col("updated_at") < now - F.expr("INTERVAL 30 MINUTES"))
    return jobs.filter(due | stale)


def claim_jobs(jobs: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The job table after the `limit` oldest eligible jobs (by id) are claimed:
    running, one attempt more, touched now; claimed tells which. Attempts count
    at the claim, so a worker that dies uses one up. A job that ran out of
    attempts and hangs is claimed too, and dies at its next failure."""
    due = (F.col("state").isin("queued", "failed") & (F.col("run_after") <= now)) | ((F.col("state") == "running") & (F.col("updated_at") < now - F.expr("INTERVAL 30 MINUTES")))
    # the least ids are found without sorting the table in one task
    first = jobs.filter(due).select("id").orderBy("id").limit(limit).withColumn("claimed", F.lit(True))
    out = jobs.join(F.broadcast(first), "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    mine = F.col("claimed")
    return out.withColumns({"state": F.when(mine, "running").otherwise(F.col("state")), "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))})


def settle_jobs(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The job table after outcomes (id, outcome, error, until) of running jobs:
    done; failed (dead once MAX_ATTEMPTS are used, else due after the back-off);
    permanent (dead at once); deferred (queued again at `until`, its attempt
    given back). A job has one outcome; those of jobs that do not run are
    ignored."""
    rows = jobs.join(outcomes.select("id", "outcome", "error", "until"), "id", "left").withColumn("o", F.when(F.col("state") == "running", F.col("outcome")))
    o, n = F.col("o"), F.col("attempts")
    spent = (o == "permanent") | ((o == "failed") & (n >= MAX_ATTEMPTS))
    state = F.when(o == "done", "done").when(spent, "dead").when(o == "failed", "failed").when(o == "deferred", "queued").otherwise(F.col("state"))
    after = F.when((o == "failed") & ~spent, F.timestamp_seconds(F.unix_micros(now.cast("timestamp")) / 1e6 + backoff_seconds(n)).cast(jobs.schema["run_after"].dataType)).when(o == "deferred", F.col("until")).otherwise(F.col("run_after"))
    attempts = F.when(o == "deferred", F.greatest(n - 1, F.lit(0))).otherwise(n)
    changed = {"state": state, "run_after": after, "attempts": attempts, "updated_at": F.when(o.isNotNull(), now).otherwise(F.col("updated_at"))}
    if "last_error" in jobs.columns:
        changed["last_error"] = F.when(o.isin("failed", "permanent", "deferred"), F.col("error")).otherwise(F.col("last_error"))
    return rows.withColumns(changed).select(*jobs.columns)


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (type, payload) without those that wait, run or failed already."""
    live = jobs.filter(F.col("state").isin("queued", "failed", "running")).select("type", "payload")
    return wanted.distinct().join(live, ["type", "payload"], "left_anti")


def purge_reason(now_h: int, event_days: int, grace_days: int) -> Column:
    """Why a note goes: soft-deleted longer ago than its grace period, or, of
    those not deleted, superseded or an old event; null if it stays. A tier of 0
    days or less is off. Times are hours."""
    live = F.col("deleted_h").isNull()
    old = F.col("updated_h") < now_h - 24 * event_days if event_days > 0 else F.lit(False)
    gone = F.coalesce(F.col("deleted_h") < now_h - 24 * grace_days, F.lit(False)) if grace_days > 0 else F.lit(False)
    return F.when(gone, "deleted").when(live & (F.col("status") == "superseded"), "superseded").when(live & F.col("kind").isin(*EVENT_KINDS) & old, "event")


def purge_tables(tables: dict[str, DataFrame], now: Column, event_days: int, job_days: int, purged_notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows that stay of the tables that have ages of their own: episodes
    (at), ended tasks (status, updated_at), raws (retained_until), done and dead
    jobs (state, updated_at), media (updated_at), and relations (source_note_id,
    created_at): those of purged notes (id) and old ones without a note go. A
    tier of 0 days or less is off; a table that is not given is left out."""
    events, jobs = cutoff(now, event_days), cutoff(now, job_days)
    old = lambda c, than: F.coalesce(F.col(c) < than, F.lit(False))
    goes = {
        "episodes": old("at", events),
        "tasks": (F.col("status") != "open") & old("updated_at", events),
        "raws": old("retained_until", now),
        "jobs": F.col("state").isin("done", "dead") & old("updated_at", jobs),
        "media": old("updated_at", events),
        "relations": F.col("source_note_id").isNull() & old("created_at", events),
    }
    out = {name: table.filter(~goes[name]) for name, table in tables.items()}
    if "relations" in out and purged_notes is not None:
        out["relations"] = out["relations"].join(purged_notes.select(F.col("id").alias("source_note_id")), "source_note_id", "left_anti")
    return out


def purge(notes: DataFrame, owned: dict[str, tuple[DataFrame, str]], reason: Column) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Notes that stay, the tables they own (name: (table, note column)) without
    rows of purged notes, and the purged notes by reason."""
    tagged = notes.withColumn("reason", reason)
    gone = tagged.filter("reason is not null").select("id", "reason")
    rest = {}
    for name, (table, key) in owned.items():
        rest[name] = table.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return tagged.filter("reason is null").drop("reason"), rest, gone.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def next_seq(state: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """New rows numbered on from each key's greatest seq, from 1."""
    base = state.groupBy(key).agg(F.max("seq").alias("base"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("nth", nth).join(base, key, "left").withColumn("seq", F.coalesce("base", F.lit(0)) + F.col("nth")).drop("nth", "base")
