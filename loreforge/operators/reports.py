"""Task lists, the daily briefing, status counts, usage and consolidation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.dates import work_day
from loreforge.operators.ranges import packed
from loreforge.sources.scratch import written

STALE_DAYS, SOON_DAYS, RELATION_DAYS = 14, 3, 30
#: From when on the minutes of episodes count.
EPOCH = "1998-01-01"
# The words in the lines of a briefing.
OVERDUE, DUE, TOUCHED, STALE = "QUÁ HẠN ", "hạn ", "cập nhật ", "stale"
OWNER, WAITS, NEXT, BECAUSE = " — người làm: ", " — chờ: ", " — bước kế: ", "vì: "
CUT = "… (còn %d mục bị cắt do ngân sách)\n"
OUTSIDE = "- … còn %d việc ngoài project hiện tại (task_list để xem)"
TITLES = dict(enumerate(["Quá hạn / sắp đến hạn", "Đang chờ người khác", "Việc đang mở", "Quyết định gần đây", "Sở thích", "Liên quan", "Phiên gần đây", "Notes mới", "Đã ghi kể từ recap trước (sai thì sửa/xoá theo #id)"], 1))
SECTION_LIMITS = {"due": 10, "waiting": 10, "open": 20, "decision": 12, "preference": 12, "note": 10, "episode": 5, "relation": 10}
LONG_PROMPT, LARGE_BODY, SLOW_MS = 30_000, 256 * 1024, 60_000


def due_tasks(tasks: DataFrame, until: Column) -> DataFrame:
    """Open tasks with a due date up to `until`, earliest first."""
    return tasks.filter((F.col("status") == "open") & (F.col("due_at") <= until)).orderBy("due_at", "id")


def waiting_tasks(tasks: DataFrame) -> DataFrame:
    """Open tasks that wait for someone, longest untouched first."""
    return tasks.filter("status = 'open' and waiting_on is not null").orderBy("updated_at", "id")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_family(project: Column, family: str) -> Column:
    """A project's own name, or one that begins with it and '-' in either case
    (% and _ in the name match as in LIKE)."""
    own = F.coalesce(project, F.lit(""))
    return (own == family) | ascii_lower(own).like("".join(c.lower() if c.isascii() else c for c in family) + "-%")


def task_flags(tasks: DataFrame, now: Column) -> DataFrame:
    """overdue (open and due before today) and stale (open and untouched for
    more than 14 days)."""
    open_ = F.col("status") == "open"
    overdue = open_ & F.coalesce(F.col("due_at") < F.to_date(now), F.lit(False))
    return tasks.withColumns({"overdue": overdue, "stale": open_ & (F.col("updated_at") < now - F.make_interval(days=F.lit(STALE_DAYS)))})


def recent_relations(relations: DataFrame, notes: DataFrame, since: Column) -> DataFrame:
    """Relations created from `since` on, without those of deleted notes."""
    gone = notes.filter("deleted_h is not null").select(F.col("id").alias("source_note_id"))
    return relations.filter(F.col("created_at") >= since).join(gone, "source_note_id", "left_anti").select(*relations.columns)


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _optional(df: DataFrame, c: str, kind: str = "string") -> Column:
    return F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)


def project_tag(own: Column, current: str | None) -> Column:
    """[project], unless it is none or the current one."""
    own = F.coalesce(own, F.lit(""))
    return F.when((own == "") | (own == (current or "")), "").otherwise(F.concat(F.lit(" ["), own, F.lit("]")))


def _after(label: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)).otherwise("")


def task_line(tasks: DataFrame, today: Column, now: Column, project: str | None = None) -> Column:
    """Id, when it is due or was last touched, title, project, owner, what it
    waits for and the next step."""
    due = F.col("due_at").cast("string")
    when = F.when(due < _day(today), F.concat(F.lit(OVERDUE), due)).when(due.isNotNull() & (due != ""), F.concat(F.lit(DUE), due)).otherwise(F.concat(F.lit(TOUCHED), _day(F.col("updated_at"))))
    stale = F.when(F.col("updated_at") < now - F.make_dt_interval(days=F.lit(STALE_DAYS)), ", " + STALE).otherwise("")
    head = F.concat(F.lit("- #"), F.col("id").cast("string"), F.lit(" ("), when, stale, F.lit("): "), "title", project_tag(F.col("project"), project))
    return F.concat(head, _after(OWNER, _optional(tasks, "owner")), _after(WAITS, F.col("waiting_on")), _after(NEXT, F.col("next_step")))


def note_line(notes: DataFrame, day: Column, project: str | None = None) -> Column:
    """Day, text, its reason unless the text holds it, scope and project."""
    why = F.coalesce("why", F.lit(""))
    reason = F.when((why != "") & ~F.contains("text", why), F.concat(F.lit(f" ({BECAUSE}"), why, F.lit(")"))).otherwise("")
    scope = F.coalesce(_optional(notes, "scope"), F.lit(""))
    return F.concat(F.lit("- "), _day(day), F.lit(": "), "text", reason, F.when(scope != "", F.concat(F.lit(" ["), scope, F.lit("]"))).otherwise(""), project_tag(F.col("project"), project))


def briefing_items(tasks: DataFrame, notes: DataFrame, episodes: DataFrame, relations: DataFrame, now: str, now_h: int, project: str | None = None, start_hour: int = 4) -> DataFrame:
    """space_id, section (1 to 8), nth and line of the briefing of each space:
    due, waiting and open tasks, decisions, preferences, relations, sessions and
    notes, each within its limit; a task or note stands in its first section
    only. `now` is a timestamp, now_h the same in the hours of notes; the minutes
    of episodes count from EPOCH. Due is what
    ends within SOON_DAYS of the work day, which begins at start_hour. With a
    project, open tasks are those of its family, its own first, and a last line
    counts the others."""
    at = F.lit(now).cast("timestamp")
    limited = lambda df, order, n: df.withColumn("nth", F.row_number().over(Window.partitionBy("space_id").orderBy(*order))).filter(F.col("nth") <= n)
    open_ = tasks.filter("status = 'open'")
    soon = F.date_add(work_day(at, start_hour), SOON_DAYS)
    due = limited(open_.filter(F.col("due_at") <= soon), [F.col("due_at"), F.col("id")], SECTION_LIMITS["due"])
    waiting = limited(open_.filter("waiting_on is not null"), [F.col("updated_at"), F.col("id")], SECTION_LIMITS["waiting"])
    own = open_ if project is None else open_.filter(in_family(F.col("project"), project))
    prefer = [] if project is None else [F.when(F.coalesce("project", F.lit("")) == project, 0).otherwise(1)]
    rest = limited(own, [*prefer, F.col("updated_at").desc(), F.col("id")], SECTION_LIMITS["open"])
    items = [df.select("space_id", F.lit(s).alias("section"), "nth", F.concat(F.lit("t"), F.col("id").cast("string")).alias("key"), task_line(df, work_day(at, start_hour), at, project).alias("line")) for s, df in ((1, due), (2, waiting), (3, rest))]
    if project is not None:
        outside = open_.filter(~in_family(F.col("project"), project)).groupBy("space_id").agg(F.count(F.lit(1)).alias("n"))
        items.append(outside.select("space_id", F.lit(3).alias("section"), F.lit(SECTION_LIMITS["open"] + 1).alias("nth"), F.lit("outside").alias("key"), F.format_string(OUTSIDE, "n").alias("line")))
    live = notes.filter("status = 'active' and deleted_h is null")
    for s, kind, hours in ((4, "decision", 24 * 30), (5, "preference", None), (8, "note", 24 * 7)):
        some = live.filter(F.col("kind") == kind) if hours is None else live.filter((F.col("kind") == kind) & (F.col("updated_h") >= now_h - hours))
        some = limited(some, [F.col("updated_h").desc(), F.col("id")], SECTION_LIMITS[kind])
        touched = at - F.make_dt_interval(hours=(F.lit(now_h) - F.col("updated_h")).cast("int"))
        items.append(some.select("space_id", F.lit(s).alias("section"), "nth", F.concat(F.lit("n"), F.col("id").cast("string")).alias("key"), note_line(some, touched, project).alias("line")))
    rel = recent_relations(relations, notes, F.date_sub(work_day(at, start_hour), RELATION_DAYS).cast("timestamp"))
    rel = limited(rel, [F.col("created_at").desc(), F.col("id").desc()], SECTION_LIMITS["relation"])
    text = F.format_string("- %s → %s (%s)", "from_ref", "to_ref", "rel_type")
    items.append(rel.select("space_id", F.lit(6).alias("section"), "nth", F.concat_ws("|", F.lit("r"), "from_ref", "to_ref", "rel_type").alias("key"), text.alias("line")))
    epi = limited(episodes, [F.col("at_m").desc(), F.col("session_id"), F.col("seq")], SECTION_LIMITS["episode"])
    items.append(epi.select("space_id", F.lit(7).alias("section"), "nth", F.concat_ws("|", F.lit("e"), F.col("session_id").cast("string"), F.col("seq").cast("string")).alias("key"), F.concat(F.lit("- "), _day(F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(mins=F.col("at_m").cast("int"))), F.lit(": "), "summary").alias("line")))
    all_ = reduce(DataFrame.unionByName, items)
    first = Window.partitionBy("space_id", "key").orderBy("section", "nth")
    return all_.withColumn("seen", F.row_number().over(first)).filter("seen = 1").select("space_id", "section", "nth", "line")


def briefing_head(day: str, project: str | None = None, space: str | None = None) -> str:
    """The first line: the day, and project and space where they are named (the
    default space is not)."""
    return "# Briefing — " + " — ".join([day, *([f"project {project}"] if project else []), *([f"space {space}"] if space else [])])


def render_briefing(items: DataFrame, titles: dict[int, str] = TITLES, budget: int = 1500, head: str = "# Briefing") -> DataFrame:
    """space_id, text and n_cut: lines in order while they fit the token budget;
    one that does not fit is counted, and the next is still tried."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        text, cut, shown = head + "\n\n", 0, set()
        for s, line in pdf.sort_values(["section", "nth"])[["section", "line"]].itertuples(index=False):
            more = ("" if s in shown else f"## {titles[s]}\n") + f"{line}\n"
            if (len(text + more) + 3) // 4 <= budget:
                text += more
                shown.add(s)
            else:
                cut += 1
        if cut:
            text += CUT % cut
        return pd.DataFrame({"space_id": [pdf["space_id"].iloc[0]], "text": [text], "n_cut": [cut]})

    # the items of a space are bounded by the section limits
    return items.groupBy("space_id").applyInPandas(one, "space_id long, text string, n_cut long")


def usage_rollup(calls: DataFrame, *also: Column) -> DataFrame:
    """Calls by op, model and purpose (and more columns): counts, sums and the
    cache-hit ratio, -1 where no call reported cached tokens."""
    told = F.col("cached_tokens") >= 0
    prompt = F.sum(F.when(told, F.col("prompt_tokens")))
    cached = F.sum(F.when(told, F.col("cached_tokens")))
    return calls.groupBy("op", "model", "purpose", *also).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("failed").alias("errors"),
        F.count_if(F.col("latency_ms") > SLOW_MS).alias("slow"),
        F.count_if(F.col("bytes") > LARGE_BODY).alias("big"),
        F.sum("bytes").alias("bytes"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.count_if(told).alias("cache_reported"),
        F.max("prompt_tokens").alias("max_prompt"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.round(F.when(F.coalesce(prompt, F.lit(0)) > 0, cached / prompt).otherwise(-1.0), 3).alias("cache_hit"),
    )


def usage_anomalies(calls: DataFrame) -> DataFrame:
    """Calls that failed, were slow or carried too much, and why."""
    flags = {"failed": F.col("failed"), "long_prompt": F.col("prompt_tokens") > LONG_PROMPT, "large_body": F.col("bytes") > LARGE_BODY, "slow": F.col("latency_ms") > SLOW_MS}
    why = F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items())))
    return calls.select("id", "op", F.concat_ws(",", why).alias("why")).filter("why <> ''")


def sampled_calls(calls: DataFrame, every: int = 50, bucket: str = "hour") -> DataFrame:
    """The first and every 50th call of each op, model and purpose. Calls are
    numbered within time buckets, and buckets by the sums of those before, so a
    group of any size is never sorted in one task."""
    key = ["op", "model", "purpose"]
    rows = calls.withColumn("b", F.date_trunc(bucket, "ts"))
    nth = F.row_number().over(Window.partitionBy(*key, "b").orderBy("ts", "id"))
    sums = rows.groupBy(*key, "b").agg(F.count(F.lit(1)).alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*key, "b")])
    numbered = rows.withColumn("nth", nth).alias("r").join(base.alias("s"), same).select("r.id", *(f"r.{c}" for c in key), (F.col("r.nth") + F.col("s.base")).alias("nth"))
    return numbered.filter((F.col("nth") == 1) | (F.col("nth") % every == 0))


def consolidation_batches(notes: DataFrame, most: int = 20_000, line_chars: int = 200) -> DataFrame:
    """id and batch of the knowledge notes to consolidate together: by space,
    project and kind, in order of id, lines packed up to `most` characters;
    batches of one note are left out. A group's notes are packed in ranges, by
    several tasks where it has many."""
    rows = notes.filter("status = 'active' and deleted_h is null").select("space_id", F.coalesce("project", F.lit("")).alias("proj"), "kind", "id", (F.least(F.length("text"), F.lit(line_chars)) + 8).cast("int").alias("n"))
    group = ["space_id", "proj", "kind"]
    batches = written(packed(rows, group, "id", "n", most).select(*group, "id", "batch"), "consolidation")
    several = batches.groupBy(*group, "batch").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    # batches are numbered as if those of one note were there
    return batches.join(several, [*group, "batch"], "left_semi").select(*group, "id", "batch")


def merge_guard(batch_sizes: DataFrame, removed: Column) -> DataFrame:
    """A batch of 8 or more of which a plan would remove over half is skipped."""
    return batch_sizes.withColumn("skip", (F.col("size") >= 8) & (2 * removed > F.col("size")))


def session_groups(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions per user: one more event within the gap, bounds included, goes on
    with the session."""
    prev = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    fresh = F.when(prev.isNull() | (F.col("ts") > prev + F.make_dt_interval(mins=F.lit(gap_minutes))), 1).otherwise(0)
    no = F.sum("fresh").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("fresh", fresh).withColumn("session_no", no).groupBy("user_id", "session_no").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count(F.lit(1)).alias("n_events"))


def missing_media(media: DataFrame, files: DataFrame) -> DataFrame:
    """Media (path) whose file is not among files (path). An empty path is an
    original that was deleted on purpose, and misses nothing."""
    return media.filter(F.coalesce("path", F.lit("")) != "").select("path").distinct().join(files.select("path").distinct(), "path", "left_anti")


def doctor_checks(tables: dict[str, tuple[DataFrame, str]], media: DataFrame, files: DataFrame, version: int, latest: int) -> DataFrame:
    """name, state (ok, warn or fail) and n of each check: that every table
    (rows, key) can be read whole and has each key once, that the tables have the
    latest schema version, and that the files of media are there. Missing files
    are warnings, the others failures."""
    found = []
    for name, (rows, key) in tables.items():
        per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
        bad = per.agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("c")).when(F.col("c") > 1, F.col("c") - 1).otherwise(0)), F.lit(0)).alias("n"))
        found.append(bad.select(F.lit(f"keys of {name}").alias("name"), F.when(F.col("n") == 0, "ok").otherwise("fail").alias("state"), "n"))
    spark = media.sparkSession
    found.append(spark.range(1).select(F.lit("schema version").alias("name"), F.lit("ok" if version == latest else "fail").alias("state"), F.lit(abs(latest - version)).cast("long").alias("n")))
    lost = missing_media(media, files).agg(F.count(F.lit(1)).alias("n"))
    found.append(lost.select(F.lit("media files").alias("name"), F.when(F.col("n") == 0, "ok").otherwise("warn").alias("state"), "n"))
    return reduce(DataFrame.unionByName, found)


def near_opening(notes: DataFrame, opening: Column) -> DataFrame:
    """Per note of a knowledge kind, the least id of its space and kind that has
    the same opening; only where there are two."""
    rows = notes.select("id", "space_id", "kind", opening.alias("opening")).filter("opening is not null")
    first = rows.groupBy("space_id", "kind", "opening").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first, ["space_id", "kind", "opening"]).select("id", "first_id", "n")


def _near_blocks(skip_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].values for c in ("a", "b"))
                am, bm = (s.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1) for s in (a, b))
                norm = np.linalg.norm(am, axis=1)[:, None] * np.linalg.norm(bm, axis=1)[None]
                sim = np.divide(am @ bm.T, norm, out=np.zeros_like(norm), where=norm > 0)
                ai, bi = (s.field("nth").to_numpy() for s in (a, b))
                x, y = np.nonzero((sim >= skip_at - 1e-12) & (ai[:, None] != bi[None]))
                lo, hi = np.minimum(ai[x], bi[y]), np.maximum(ai[x], bi[y])
                order = np.lexsort((lo, hi))
                later, start = np.unique(hi[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(later), pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), pa.array(lo[order]))], ["later", "earlier"])

    return run


def near_pairs(vectors: DataFrame, group: list[str], at: float, block: int = 1024) -> DataFrame:
    """later and earlier (array): which rows (group, nth, vec) of a group and
    dimension are as similar as `at`; nth tells rows of the table apart and orders
    them. Blocks of a group meet in pairs, each pair one matrix product; what is
    not similar never becomes a row."""
    g = F.xxhash64(F.size("vec"), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in group)).alias("g")
    rows = vectors.filter(F.size("vec") > 0).select(g, "nth", F.col("vec").cast("array<double>").alias("vec"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    packed = rows.join(sizes, "g").groupBy("g", "n", F.pmod(F.xxhash64("nth"), "n").alias("b")).agg(F.collect_list(F.struct("nth", "vec")).alias("v"))
    packed = written(packed, "near-blocks")
    left = packed.select("g", F.col("b").alias("x"), F.col("v").alias("a"), F.explode(F.sequence("b", F.col("n") - 1)).alias("b"))
    return left.join(packed.select("g", "b", F.col("v").alias("v")), ["g", "b"]).select("a", F.col("v").alias("b")).mapInArrow(_near_blocks(at), "later long, earlier array<long>")


def sequential_near_dups(vectors: DataFrame, group_cols: list[str], skip_at: float = 0.95) -> DataFrame:
    """group_cols, id and copy_of of notes (group_cols, id, kind, vec), each group
    and kind in order of id: a note that is as similar as skip_at to an earlier
    one that was kept is skipped and names the first such; the others are kept.
    Ids are whole numbers, each once. A zero, empty or null vector is like none.

    The rule is sequential, the work is not: similar pairs are found in blocks,
    and then rounds settle notes of which all earlier neighbours are settled: one
    that a kept one stands before is skipped, one that only skipped ones do is
    kept. Equal vectors share the fate of their first. There are as many rounds as
    the longest chain of notes that wait for one another, which near copies keep
    short; a round is written to the shared folder, and only a count is read."""
    group = [*group_cols, "kind"]
    same = written(vectors.groupBy(*group, F.col("vec").cast("array<double>").alias("vec")).agg(F.min("id").alias("nth")), "near-first")
    pairs = written(near_pairs(same, group, skip_at).select("later", F.explode("earlier").alias("earlier")), "near-pairs")
    # settled: node and of (null: kept)
    waits, settled = pairs, written(pairs.select(F.col("earlier").alias("node")).distinct().join(pairs.select(F.col("later").alias("node")), "node", "left_anti").withColumn("of", F.lit(None).cast("long")), "near-settled")
    while True:
        known = settled.select(F.col("node").alias("earlier"), F.col("of").isNull().alias("kept"), F.lit(True).alias("known"))
        told = waits.join(known, "earlier", "left").groupBy("later").agg(
            F.min(F.when(F.col("kept"), F.col("earlier"))).alias("of"), F.min(F.coalesce("known", F.lit(False))).alias("all"), F.min(F.when(F.col("known").isNull(), F.col("earlier"))).alias("open")
        )
        # a kept one that is known names the copy only if no earlier one can still be kept
        ready = told.filter(F.col("all") | (F.col("of") < F.col("open"))).select(F.col("later").alias("node"), "of")
        more = written(ready, "near-ready")
        if not more.limit(1).count():
            break
        settled = written(settled.unionByName(more), "near-settled")
        waits = written(waits.join(more.select(F.col("node").alias("later")), "later", "left_anti").select("later", "earlier"), "near-waits")
    fate = same.join(settled.withColumnRenamed("node", "nth"), "nth", "left")
    copied = F.size("vec") > 0
    zero = F.coalesce(F.forall("vec", lambda x: x == 0), F.lit(True))
    at = F.when(F.col("of").isNotNull(), F.col("of")).when(copied & ~zero & (F.col("id") != F.col("nth")), F.col("nth"))
    rows = vectors.select(*group_cols, "id", "kind", F.col("vec").cast("array<double>").alias("vec")).alias("v")
    on = [F.col(f"v.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*group, "vec"]]
    return rows.join(fate.alias("f"), on).select(*(F.col(f"v.{c}").alias(c) for c in group_cols), F.col("v.id").alias("id"), F.col("f.nth").alias("nth"), F.col("f.of").alias("of"), F.col("v.vec").alias("vec")).select(*group_cols, "id", at.alias("copy_of"))
