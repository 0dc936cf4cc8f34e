"""Extraction as one flow: from what sessions said to notes, tasks and relations.

Raws that wait are condensed and cut into windows, a model answers each window,
and the answers of a session are taken together: what a relation says of a note
is counted on over the windows before it. Notes that repeat one another are
skipped, notes that say anew what is known take its place. The changes of all
tables are committed as one batch, so an extraction that fails leaves nothing
and one that is sent twice is applied once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.text import embed_text, opening, trim_all
from loreforge.operators import chunking, memory, reports, state
from loreforge.operators.transcripts import condense, parse_extraction
from loreforge.sources.scratch import written
from loreforge.sources.tables import TableSet

#: Characters of a window, windows of a session, open tasks shown.
WINDOW_CHARS, MOST_WINDOWS, SHOWN_TASKS = 40_000, 8, 60
META = ("why", "who", "when", "as_of", "ref", "alternatives", "scope")

SCHEMAS = {
    "notes": "id long, space_id long, kind string, text string, tags array<string>, source string, session_id long, content_hash string, created_at timestamp, updated_at timestamp, deleted_at timestamp, status string, project string, "
    "why string, who array<string>, when string, as_of string, ref string, alternatives array<string>, scope string",
    "tasks": "id long, space_id long, title string, status string, next_step string, why string, owner string, waiting_on string, due_at string, constraints string, project string, created_at timestamp, updated_at timestamp",
    "relations": "id long, space_id long, from_ref string, to_ref string, rel_type string, source_note_id long, created_at timestamp",
    "raws": "id long, session_id long, seq int, line string, extracted_at timestamp",
    "vectors": "id long, vec array<double>",
}
KEYS = dict.fromkeys(SCHEMAS, "id")


def numbered(rows: DataFrame, order: list[str], start: Column | int = 0) -> DataFrame:
    """Rows with nr from start + 1 on in the order of columns, whose first values
    tell rows apart enough to be dealt by range. No task holds more than its
    range; the ranges' sizes are added up on a row each."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    sums = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    start = start if isinstance(start, Column) else F.lit(start)
    return dealt.withColumn("_i", nth).join(F.broadcast(base), "_p").withColumn("nr", (start + F.col("_base") + F.col("_i")).cast("long")).drop("_p", "_i", "_base")


def session_windows(raws: DataFrame, most: int = WINDOW_CHARS, keep: int = MOST_WINDOWS) -> DataFrame:
    """session_id, ordinal, text and dropped: what the raws (session_id, seq,
    line) that wait say, in windows; of many the last stay."""
    said = condense(raws.filter("extracted_at is null").select("session_id", "seq", "line"), ["session_id", "seq"])
    # a session is one conversation; its text is cut to the last windows at once
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    return chunking.windows(said.groupBy("session_id").agg(F.array_join(lines, "").alias("text")), "session_id", "text", most=most, keep=keep)


def shown_tasks(tasks: DataFrame, sessions: DataFrame, most: int = SHOWN_TASKS) -> DataFrame:
    """session_id, id, nth and line: the open tasks of a session's space that its
    windows are sent with, those of its project first, then the last updated."""
    open_ = tasks.filter("status = 'open'").select("space_id", "id", "title", "next_step", "waiting_on", "updated_at", F.coalesce("project", F.lit("")).alias("of"))
    # per space and project the same for all its sessions
    own = sessions.select("space_id", F.coalesce("project", F.lit("")).alias("own")).distinct()
    order = Window.partitionBy("space_id", "own").orderBy((F.col("of") != F.col("own")).cast("int"), F.col("updated_at").desc(), F.col("id"))
    some = own.join(open_, "space_id").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    part = lambda c, t: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(t), F.col(c))).otherwise("")
    line = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(": "), "title", part("next_step", " — next: "), part("waiting_on", " — waiting on: "))
    rows = some.select("space_id", "own", "id", "nth", line.alias("line"))
    return sessions.select("session_id", "space_id", F.coalesce("project", F.lit("")).alias("own")).join(rows, ["space_id", "own"]).select("session_id", "id", "nth", "line")


def prompts(windows: DataFrame, shown: DataFrame) -> DataFrame:
    """The windows with the list of open tasks before each."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n")
    block = shown.groupBy("session_id").agg(F.concat(F.lit("Open tasks (id: title):\n"), lines, F.lit("\n\nTranscript:\n")).alias("block"))
    return windows.join(block, "session_id", "left").select("session_id", "ordinal", F.concat(F.coalesce("block", F.lit("")), "text").alias("text"))


@dataclass(frozen=True)
class Extracted:
    """The rows that the outputs of extractions ask for."""

    notes: DataFrame
    tasks: DataFrame
    updates: DataFrame
    bad_updates: DataFrame
    relations: DataFrame
    broken: DataFrame


def extracted(outputs: DataFrame, open_ids: DataFrame) -> Extracted:
    """From outputs (session_id, space_id, project, ordinal, output), one or more
    per session: the notes, tasks and relations to write, each with nth, its place
    in the session, in the order of the windows; the updates of open tasks
    (open_ids: id, and session_id where each session was shown its own) and those
    that name other ids, which are left out; and the sessions of which an output
    is broken, which give nothing. note_nth is the place of a relation's note in
    the session, null where the window has no such note. Without ordinal a session
    has one output."""
    if "ordinal" not in outputs.columns:
        outputs = outputs.withColumn("ordinal", F.lit(0))
    x = written(parse_extraction(outputs.select("session_id", "space_id", "project", "ordinal", "output"), "output").drop("output"), "extraction-parsed")
    broken = x.filter("error is not null").groupBy("session_id").agg(F.min_by("error", "ordinal").alias("error"))
    key = ["session_id", "space_id", "project"]
    good = x.join(broken.select("session_id"), "session_id", "left_anti")
    before = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)

    def each(c: str) -> DataFrame:
        at = good.withColumns({"base": F.coalesce(F.sum(F.coalesce(F.size(f"ex.{c}"), F.lit(0))).over(before), F.lit(0)), "note_base": F.coalesce(F.sum(F.coalesce(F.size("ex.notes"), F.lit(0))).over(before), F.lit(0)), "n_notes": F.coalesce(F.size("ex.notes"), F.lit(0))})
        return at.select(*key, "base", "note_base", "n_notes", F.posexplode(f"ex.{c}").alias("i", "r")).withColumn("nth", (F.col("base") + F.col("i")).cast("int"))

    trimmed = lambda c: F.when(trim_all(F.col(f"r.{c}")) != "", trim_all(F.col(f"r.{c}")))
    some = lambda c: F.when(F.size(f"r.{c}") > 0, F.col(f"r.{c}"))
    tags = F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags")
    notes = each("notes").select(*key, "nth", F.col("r.kind").alias("kind"), F.col("r.text").alias("text"), tags, *((some(c) if c in ("who", "alternatives") else trimmed(c)).alias(c) for c in META))
    tasks = each("tasks").select(*key, "nth", F.col("r.title").alias("title"), *(trimmed({"due_at": "due"}.get(f, f)).alias(f) for f in state.TASK_FIELDS))
    asked = each("task_updates").select(*key, "nth", F.col("r.id").alias("id"), F.col("r.status").alias("status"), trimmed("next_step").alias("next_step"), trimmed("waiting_on").alias("waiting_on"), trimmed("due").alias("due_at"))
    inside = (F.col("r.note_index") >= 0) & (F.col("r.note_index") < F.col("n_notes"))
    rel = each("relations").select(*key, "nth", F.col("r.from").alias("from_ref"), F.col("r.to").alias("to_ref"), F.col("r.type").alias("rel_type"), F.when(inside, F.col("note_base") + F.col("r.note_index")).cast("int").alias("note_nth"))
    on = [c for c in ("session_id", "id") if c in open_ids.columns]
    return Extracted(notes, tasks, asked.join(open_ids, on, "left_semi").select(*asked.columns), asked.join(open_ids, on, "left_anti").select(*asked.columns), rel, broken)


def plan(notes: DataFrame, known: DataFrame, skip_at: float = 0.95, replace_at: float = memory.REPLACE_AT) -> DataFrame:
    """session_id, nth, skip and replaces for new notes (session_id, space_id,
    nth, kind, text, vec). A note is skipped if it is as similar as skip_at to an
    earlier one of its session and kind that is not; of those that stay, knowledge
    takes the place of what memory.dedupe_plan finds among known (id, space_id,
    kind, opening, vec). Skipped notes replace nothing."""
    ids = written(notes.select("session_id", "nth", "space_id", "kind", opening(trim_all(F.col("text"))).alias("opening"), "vec", (F.col("session_id") * 100_000 + F.col("nth")).alias("id")), "extraction-vectors")
    skipped = reports.sequential_near_dups(ids, ["session_id"], skip_at).filter("copy_of is not null").select("id")
    stay = ids.join(skipped, "id", "left_anti")
    # new and known ids are numbers of two kinds: none is "itself" here
    found = memory.dedupe_plan(stay.withColumn("id", -F.col("id") - 1), known, replace_at).select((-F.col("id") - 1).alias("id"), "replaces")
    return ids.select("id", "session_id", "nth").join(skipped.withColumn("skip", F.lit(True)), "id", "left").join(found, "id", "left").select("session_id", "nth", F.coalesce("skip", F.lit(False)).alias("skip"), "replaces")


@dataclass(frozen=True)
class Changes:
    """Rows to put and keys to take out by table, and counts of what happened."""

    puts: dict[str, DataFrame]
    gone: dict[str, DataFrame]
    counts: DataFrame


def changes(tables: dict[str, DataFrame], sessions: DataFrame, outputs: DataFrame, shown: DataFrame, embed: Callable[[list[str]], list[list[float]]], now: Column, skip_at: float = 0.95, replace_at: float = memory.REPLACE_AT) -> Changes:
    """What outputs (session_id, ordinal, output) change in tables (SCHEMAS).

    Sessions are applied in the order of their ids, all against the tables as they
    are. A note that is there (space, kind and trimmed text) is refreshed and
    revived: tags joined, fields that are given set, the first project kept; others
    get ids on from the greatest. A replaced note goes with its vector and the
    relations that name it, unless it is the new note itself. Tasks are inserted
    and updated as in `state`; relations name the note of their place, null if it
    was skipped. Raws of sessions without a broken output are marked, also where
    nothing was extracted.
    """
    x = extracted(outputs.join(sessions.select("session_id", "space_id", "project"), "session_id"), shown.select("session_id", "id"))
    notes, tasks, relations, raws, vectors = (tables[t] for t in ("notes", "tasks", "relations", "raws", "vectors"))
    fresh = written(x.notes.withColumn("key", F.col("session_id") * 100_000 + F.col("nth")), "extraction-notes")
    text = embed_text(trim_all(F.col("text")), F.col("why"))
    vec = memory.embed_missing(fresh.select(F.col("key").alias("id"), text.alias("text")), vectors.limit(0), embed)
    live = notes.filter("status = 'active' and deleted_at is null").select("id", "space_id", "kind", opening(F.col("text")).alias("opening")).join(vectors, "id")
    planned = fresh.join(vec.select(F.col("id").alias("key"), "vec"), "key", "left")
    todo = written(planned.join(plan(planned, live, skip_at, replace_at), ["session_id", "nth"]), "extraction-plan")
    kept = todo.filter("not skip").withColumn("content_hash", state.content_hash(F.col("space_id"), F.col("kind"), F.col("text")))

    pick = lambda f, c: f(F.when(F.col(c).isNotNull(), F.struct("key", c)))[c].alias(c)
    one = kept.groupBy("space_id", "content_hash").agg(
        F.min("kind").alias("kind"), F.min_by(trim_all(F.col("text")), "key").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        pick(F.min, "project"), F.min("key").alias("first_key"), F.min_by("session_id", "key").alias("session_id"), F.min_by("vec", "key").alias("vec"), *(pick(F.max, c) for c in META),
    )
    was = notes.select("space_id", "content_hash", *(F.col(c).alias(f"was_{c}") for c in notes.columns if c not in ("space_id", "content_hash")))
    met = written(one.join(was, ["space_id", "content_hash"], "left"), "extraction-met")
    last = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids = numbered(met.filter("was_id is null").select("first_key"), ["first_key"], last).select("first_key", F.col("nr").alias("id"))
    named = met.join(ids, "first_key", "left").withColumn("id", F.coalesce("was_id", "id"))
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    put_notes = named.select(
        "id", "space_id", "kind", "content_hash",
        F.when(F.col("was_id").isNull(), F.col("text")).otherwise(F.col("was_text")).alias("text"),
        F.array_sort(F.array_union(F.coalesce("was_tags", F.array().cast("array<string>")), "tags")).alias("tags"),
        F.when(F.col("was_id").isNull(), F.lit("hook:stop")).otherwise(F.col("was_source")).alias("source"),
        F.when(F.col("was_id").isNull(), F.col("session_id")).otherwise(F.col("was_session_id")).alias("session_id"),
        F.coalesce("was_created_at", now).alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit("active").alias("status"),
        either("was_project", "project").alias("project"), *(either(c, f"was_{c}").alias(c) for c in META),
    )
    put_notes = written(put_notes, "extraction-put-notes")
    of = kept.join(put_notes.select("id", "space_id", "content_hash"), ["space_id", "content_hash"]).select("session_id", "nth", "id", "replaces")
    # of a batch that both writes and replaces a note, the writing stands
    gone = written(of.filter("replaces is not null and replaces <> id").select(F.col("replaces").alias("id")).distinct().join(put_notes.select("id"), "id", "left_anti"), "extraction-gone")

    new = x.tasks.withColumns({"seq": F.col("session_id") * 100_000 + F.col("nth"), "title": trim_all(F.col("title"))})
    inserted = state.insert_tasks(tasks, new)
    whole = inserted.join(tasks.select("id", "created_at", F.col("updated_at").alias("was_at")), "id", "left")
    # a task that is met again is filled, which is no update of it
    whole = whole.withColumns({"created_at": F.coalesce("created_at", now), "updated_at": F.coalesce("was_at", now)}).select(*tasks.columns)
    # the last update of a task counts field by field
    upd = x.updates.withColumn("o", F.struct("session_id", "nth"))
    told = lambda c: F.max(F.when(F.coalesce(c, F.lit("")) != "", F.struct("o", c)))[c].alias(c)
    updates = upd.groupBy("id").agg(*(told(c) for c in ("status", "next_step", "waiting_on", "due_at")))
    after = state.update_tasks(whole, updates, now)
    put_tasks = written(after.join(tasks, [after[c].eqNullSafe(tasks[c]) for c in tasks.columns], "left_anti").select(*tasks.columns), "extraction-put-tasks")

    rel = x.relations.join(of.select("session_id", F.col("nth").alias("note_nth"), F.col("id").alias("source_note_id")), ["session_id", "note_nth"], "left")
    last_rel = relations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    put_rel = numbered(rel, ["session_id", "nth"], last_rel).select(F.col("nr").alias("id"), "space_id", "from_ref", "to_ref", "rel_type", "source_note_id", now.alias("created_at"))
    lost = relations.join(gone.select(F.col("id").alias("source_note_id")), "source_note_id", "left_semi").select("id")

    done = sessions.select("session_id").join(x.broken.select("session_id"), "session_id", "left_anti")
    put_raws = raws.filter("extracted_at is null").join(done, "session_id", "left_semi").withColumn("extracted_at", now)
    put_vec = named.filter("was_id is null").select("id", "vec")
    what = {"notes": todo, "skipped": todo.filter("skip"), "replaced": gone, "fresh": put_vec, "tasks": x.tasks, "updates": x.updates, "bad_updates": x.bad_updates, "relations": x.relations, "broken": x.broken}
    counts = None
    for name, df in what.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        counts = c if counts is None else counts.unionByName(c)
    return Changes({"notes": put_notes, "tasks": put_tasks, "relations": put_rel, "raws": put_raws, "vectors": put_vec}, {"notes": gone, "vectors": gone, "relations": lost}, counts)


def extract(store: TableSet, batch_id: str, sessions: DataFrame, model: Callable[[DataFrame], DataFrame], embed: Callable[[list[str]], list[list[float]]], now: Column, **limits: float) -> bool:
    """Extracts all that waits in `sessions` (session_id, space_id, project) as
    one commit. model takes prompts (session_id, ordinal, text) and gives outputs
    (session_id, ordinal, output). Returns whether the batch is new; one that was
    committed asks the model nothing."""
    if batch_id in store.batches():
        return False
    tables = {t: store.read(t) for t in SCHEMAS}
    mine = sessions.join(tables["raws"].filter("extracted_at is null").select("session_id").distinct(), "session_id", "left_semi")
    shown = written(shown_tasks(tables["tasks"], mine), "extraction-shown")
    windows = session_windows(tables["raws"].join(mine.select("session_id"), "session_id", "left_semi"))
    # written: an answer is asked for once
    outputs = written(model(prompts(windows, shown)).select("session_id", "ordinal", "output"), "extraction-outputs")
    made = changes(tables, mine, outputs, shown, embed, now, **limits)
    return store.commit(batch_id, made.puts, made.gone)
