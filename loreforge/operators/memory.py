"""Lookups, single-row changes in batches, capture of files and what is done
with extracted and consolidated notes."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.dates import work_day
from loreforge.functions.text import glob_regex, trim_all
from loreforge.operators.search import vector_topk
from loreforge.operators.state import KNOWLEDGE_KINDS

# Media kinds by extension, and media that is not supported.
MEDIA = {
    "audio": ["m4a", "mp3", "wav", "ogg"],
    "image": ["png", "jpg", "jpeg", "heic"],
    "video": ["mp4", "mov", "m4v"],
}
UNSUPPORTED_MEDIA = ["mkv", "avi", "flv", "wmv", "webm", "aac", "flac", "gif", "webp"]
FRESH_SECONDS = 60
SUMMARY_CHARS = 48_000
REPLACE_AT, SKIP_AT = 0.92, 0.95


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is in ids (column id); a point lookup is one id."""
    return table.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def normal_tags(tags: Column) -> Column:
    """Tags trimmed, empty ones dropped, each once in order of its first place."""
    return F.array_distinct(F.filter(F.transform(tags, trim_all), lambda t: F.coalesce(t != "", F.lit(False))))


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    """Whether every wanted tag is there, in its exact case; none wanted: true."""
    out = F.lit(True)
    for t in wanted:
        out = out & F.coalesce(F.array_contains(tags, t), F.lit(False))
    return out


def space_of(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The space of the first rule (glob, space) that the path matches."""
    out = F.lit(default)
    for pattern, space in reversed(rules):
        out = F.when(path.rlike(glob_regex(pattern)), space).otherwise(out)
    return out


def latest(table: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order given."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return table.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def upsert_sessions(state: DataFrame, starts: DataFrame) -> DataFrame:
    """Sessions (id, client, space_id, started_at, last_seen_at, cwd, project)
    after starts of the same columns: what is set stays, later sight wins."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("started_at", c)))[c].alias(c)
    new = starts.groupBy("id").agg(first("client"), first("space_id"), F.min("started_at").alias("started_at"), F.max("last_seen_at").alias("last_seen_at"), first("cwd"), first("project"))
    n, o = new.alias("n"), state.alias("o")
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(keep("id"), keep("client"), keep("space_id"), keep("started_at"), F.greatest("o.last_seen_at", "n.last_seen_at").alias("last_seen_at"), keep("cwd"), keep("project"))


def soft_delete(notes: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Notes with deleted_h set for the ids, unless it is set already; changed
    tells which rows."""
    hit = ids.select(F.col("id")).distinct().withColumn("_hit", F.lit(True))
    changed = F.col("_hit").isNotNull() & F.col("deleted_h").isNull()
    out = notes.join(hit, "id", "left").withColumn("changed", changed)
    return out.withColumn("deleted_h", F.when(F.col("changed"), at).otherwise(F.col("deleted_h"))).drop("_hit")


def set_meta(meta: DataFrame, writes: DataFrame) -> DataFrame:
    """key, value and changed after writes (key, value, expect): a write with an
    expected value counts only if that is the stored one ('' for none)."""
    w, m = writes.alias("w"), meta.alias("m")
    both = m.join(w, F.col("m.key") == F.col("w.key"), "full_outer")
    ok = F.col("w.key").isNotNull() & (F.col("w.expect").isNull() | (F.col("w.expect") == F.coalesce("m.value", F.lit(""))))
    changed = ok & ~F.col("w.value").eqNullSafe(F.col("m.value"))
    out = both.select(F.coalesce("m.key", "w.key").alias("key"), F.when(ok, F.col("w.value")).otherwise(F.col("m.value")).alias("value"), changed.alias("changed"))
    return out.filter("value is not null")


def retry_dead(jobs: DataFrame, now: Column) -> DataFrame:
    """Dead jobs queued again from the first attempt, without their error."""
    dead = F.col("state") == "dead"
    new = {"state": F.lit("queued"), "attempts": F.lit(0), "run_after": now, "updated_at": now, "last_error": F.lit("")}
    return jobs.withColumns({c: F.when(dead, v).otherwise(F.col(c)) for c, v in new.items() if c in jobs.columns})


def media_outcomes(files: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """space_id, path, sha256, kind and outcome of each file (space_id, path,
    content, modified) of watched folders: fresh (changed under a minute ago),
    type (no media), unsupported (media of a format that is not read), already
    (the space has its content, columns space_id and sha256 of known, or it came
    before), ingested. One content in two spaces is two media."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(*(F.when(ext.isin(v), k) for k, v in MEDIA.items()), F.when(ext.isin(UNSUPPORTED_MEDIA), "unsupported"))
    rows = files.select("space_id", "path", "modified", F.sha2("content", 256).alias("sha256"), kind.alias("kind"))
    recent = F.col("modified") > now - F.make_dt_interval(secs=F.lit(FRESH_SECONDS))
    usable = F.coalesce(F.col("kind") != "unsupported", F.lit(False)) & ~recent
    first = rows.filter(usable).groupBy("space_id", "sha256").agg(F.min("path").alias("first"))
    old = known.select("space_id", "sha256").distinct().withColumn("old", F.lit(True))
    out = rows.join(first, ["space_id", "sha256"], "left").join(old, ["space_id", "sha256"], "left")
    outcome = F.when(recent, "fresh").when(F.col("kind").isNull(), "type").when(F.col("kind") == "unsupported", "unsupported").when(F.col("old").isNotNull() | (F.col("path") > F.col("first")), "already").otherwise("ingested")
    return out.select("space_id", "path", "sha256", "kind", outcome.alias("outcome"))


def read_deltas(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """session_id, expect_offset, new_offset and content: what transcript files
    (session_id, content) hold beyond the stored offset, up to their last
    newline, so a line that is half written, even inside a character, waits. A
    file shorter than its offset is read again from the start."""
    rows = files.join(offsets.select("session_id", F.col("offset").alias("at")), "session_id", "left")
    start = F.when(F.coalesce("at", F.lit(0)) > F.octet_length("content"), 0).otherwise(F.coalesce("at", F.lit(0)))
    rows = rows.withColumn("expect_offset", start.cast("long"))
    # latin1 has a character for each byte, so the last newline is found and cut at before bytes become text
    rest = F.expr("decode(substring(content, cast(expect_offset + 1 as int)), 'ISO-8859-1')")
    rows = rows.withColumn("n", F.length(F.regexp_extract(rest, r"(?s)\A(.*\n)", 1))).filter("n > 0")
    return rows.select("session_id", "expect_offset", F.expr("decode(substring(content, cast(expect_offset + 1 as int), n), 'UTF-8')").alias("content"), (F.col("expect_offset") + F.col("n")).alias("new_offset"))


def gunzip(raws: DataFrame, col: str = "content") -> DataFrame:
    """The column's gzip bytes as text."""

    @F.pandas_udf("string")
    def inflate(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else gzip.decompress(b).decode("utf-8", "replace"))

    return raws.withColumn(col, inflate(col))


def _fires(batches: Iterator[pa.RecordBatch], wait: int) -> Iterator[pa.RecordBatch]:
    """Runs of deltas sorted by session and time; one wait is open at a time."""
    now, first, n = None, None, 0
    for batch in batches:
        out = []
        for key, at in zip(batch.column("session_id").to_pylist(), batch.column("at").to_pylist(), strict=True):
            if n and key == now and at <= first + wait:
                n += 1
                continue
            if n:
                out.append((now, first + wait, n))
            now, first, n = key, at, 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field("session_id").type, pa.int64(), pa.int64()), strict=True)], ["session_id", "fires_at", "n"])
        kind = batch.schema.field("session_id").type
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([first + wait]), pa.array([n])], ["session_id", "fires_at", "n"])


def debounce(deltas: DataFrame, minutes: int = 10) -> DataFrame:
    """session_id, fires_at and n: deltas (session_id, at) wait for `minutes`
    after the first of them; later ones join without moving the time, and one
    after it opens the next wait.

    A delta that comes more than the wait after the one before it opens a wait
    for sure, so the pieces between such gaps are dealt out apart; a piece is
    streamed, never gathered."""
    wait = minutes * 60_000_000
    kind = dict(deltas.dtypes)["session_id"]
    rows = deltas.select("session_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    order = Window.partitionBy("session_id").orderBy("at")
    before = F.lag("at").over(order)
    rows = rows.withColumn("piece", F.when(before.isNull() | (F.col("at") > before + wait), F.col("at")))
    rows = rows.withColumn("piece", F.max("piece").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = rows.repartition("session_id", "piece").sortWithinPartitions("session_id", "piece", "at").select("session_id", "at")
    return dealt.mapInArrow(lambda b: _fires(b, wait), f"session_id {kind}, fires_at long, n long").withColumn("fires_at", F.timestamp_micros("fires_at"))


def usage_fields(raw: DataFrame, col: str = "usage") -> DataFrame:
    """prompt_tokens, completion_tokens and cached_tokens from the JSON of several
    vendors. The prompt is prompt_tokens, else input_tokens, else the total less
    the completion; a zero counts as not told. cached_tokens is the greater of
    the details' and prompt_cache_hit_tokens, -1 where neither is told."""
    get = lambda p: F.get_json_object(col, p).cast("long")
    told = lambda p: F.when(get(p) > 0, get(p))
    zero = lambda p: F.coalesce(get(p), F.lit(0))
    prompt = F.coalesce(told("$.prompt_tokens"), told("$.input_tokens"), zero("$.total_tokens") - zero("$.completion_tokens"))
    details = F.coalesce(F.get_json_object(col, "$.prompt_tokens_details"), F.lit("null")) != "null"
    cached = F.when(details, F.greatest(zero("$.prompt_tokens_details.cached_tokens"), zero("$.prompt_cache_hit_tokens"))).otherwise(F.coalesce(get("$.prompt_cache_hit_tokens"), F.lit(-1)))
    return raw.withColumns({"prompt_tokens": prompt, "completion_tokens": zero("$.completion_tokens"), "cached_tokens": cached})


def summary_input(lines: DataFrame, keys: list[str], most: int = SUMMARY_CHARS) -> DataFrame:
    """text: a session's condensed lines (seq, part, line), the last `most`
    characters. Only the lines that reach into them are gathered."""
    back = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), F.col("part").desc(), F.col("line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("after", F.coalesce(F.sum(F.length("line") + 1).over(back), F.lit(0)))
    total = F.max(F.col("after") + F.length("line")).alias("total")
    # the line end before the last line that reaches in belongs to the tail too
    near = F.when(F.col("after") <= most, F.struct("seq", "part", "line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(near)), lambda x: x["line"]), "\n")
    rows = rows.groupBy(*keys).agg(whole.alias("text"), total)
    return rows.withColumn("text", F.when(F.col("total") > most, F.concat(F.lit("… [cut]\n"), F.right("text", F.lit(most)))).otherwise(F.col("text"))).drop("total")


def apply_merges(notes: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a consolidation writes and deletes. merges: merge_id, text, ids. The
    merged note has its members' space, kind and project and all their tags in
    order of first appearance; if its text is a member's, that member survives.
    Returns (merge_id, space_id, kind, project, tags, text) and the ids to
    soft-delete."""
    member = merges.select("merge_id", F.col("text").alias("new_text"), F.posexplode("ids").alias("nth", "id")).join(notes.select("id", "space_id", "kind", "project", "tags", "text"), "id")
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "tags"))), lambda x: x["tags"])))
    new = member.groupBy("merge_id").agg(F.min("space_id").alias("space_id"), F.min("kind").alias("kind"), F.min_by("project", "nth").alias("project"), tags.alias("tags"), F.min("new_text").alias("text"))
    return new, member.filter(trim_all(F.col("text")) != trim_all(F.col("new_text"))).select("id")


def valid_merges(merges: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds error to proposed merges (merge_id, kind, text, ids) of a batch (id,
    kind): an empty text, under two ids, an id twice or outside the batch,
    members of another kind, an id in two merges."""
    one = merges.select("merge_id", F.explode("ids").alias("id")).join(batch.select("id", F.col("kind").alias("member_kind")), "id", "left")
    shared = one.groupBy("id").agg(F.count_distinct("merge_id").alias("m"))
    per = one.join(shared, "id").groupBy("merge_id").agg(F.count_if(F.col("member_kind").isNull()).alias("foreign"), F.max("m").alias("m"), F.collect_set("member_kind").alias("kinds"))
    text = F.coalesce(trim_all(F.col("text")), F.lit("")) == ""
    error = (
        F.when(text, "text")
        .when(F.size("ids") < 2, "few")
        .when(F.size(F.array_distinct("ids")) < F.size("ids"), "repeated")
        .when(F.coalesce(F.col("foreign"), F.lit(0)) > 0, "foreign")
        .when(F.col("m") > 1, "shared")
        .when(F.exists("kinds", lambda k: k != F.col("kind")), "kind")
    )
    return merges.join(per, "merge_id", "left").withColumn("error", error).drop("foreign", "m", "kinds")


def dedupe_plan(new: DataFrame, existing: DataFrame, replace_at: float = REPLACE_AT, candidates: int = 5) -> DataFrame:
    """id and replaces: for new knowledge notes the existing note that each takes
    the place of: of the `candidates` nearest of its space and kind the first, if
    as similar as replace_at, else the nearest with the same opening. Both tables
    have id, space_id, kind, opening and vec; existing holds live notes. A note is
    not compared with itself."""
    own = new.filter(F.col("kind").isin(*KNOWLEDGE_KINDS))
    hits = vector_topk(existing, own.withColumnRenamed("id", "query_id"), candidates, group=("space_id", "kind"), exclude_self=True)
    rows = hits.join(existing.select("id", F.col("opening").alias("o")), "id").join(own.select(F.col("id").alias("query_id"), "opening"), "query_id")
    near, best = F.min_by("id", "pos"), F.max("score")
    alike = F.min(F.when(F.col("opening") == F.col("o"), F.struct("pos", "id")))["id"]
    per = rows.groupBy("query_id").agg(F.when(best >= replace_at, near).otherwise(alike).alias("replaces"))
    return per.select(F.col("query_id").alias("id"), "replaces").filter("replaces is not null")


def captured_window(now: Column, last_day: Column, start_hour: int = 4) -> tuple[Column, Column]:
    """From when to when a recap looks back: from the start of the work day of
    the last briefing (a date, null if there was none) to the start of today's.
    A last day that is today, or over seven days ago, means yesterday."""
    day = work_day(now, start_hour)
    begin = lambda d: d.cast("timestamp") + F.make_dt_interval(hours=F.lit(start_hour))
    usable = (last_day < day) & (last_day >= F.date_sub(day, 7))
    return begin(F.when(F.coalesce(usable, F.lit(False)), last_day).otherwise(F.date_sub(day, 1))), begin(day)


def captured(notes: DataFrame, tasks: DataFrame, start: Column, end: Column, most: int = 8) -> DataFrame:
    """space_id, nth and line: what was recorded by itself since the last recap:
    new open tasks, then notes from hooks and tools, each space's first `most`
    and how many more there are. notes and tasks have created_at."""
    inside = (F.col("created_at") >= start) & (F.col("created_at") < end)
    t = tasks.filter(inside & (F.col("status") == "open")).select("space_id", F.lit(0).alias("o"), "created_at", "id", F.concat(F.lit("- task #"), F.col("id").cast("string"), F.lit(": "), "title").alias("line"))
    n = notes.filter(inside & F.col("deleted_h").isNull() & F.col("source").isin("hook:stop", "tool:remember"))
    n = n.select("space_id", F.lit(1).alias("o"), "created_at", "id", F.concat(F.lit("- note #"), F.col("id").cast("string"), F.lit(" ["), "kind", F.lit("]")).alias("line"))
    rows = t.unionByName(n)
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("space_id").orderBy("o", "created_at", "id"))).filter(F.col("nth") <= most).select("space_id", "nth", "line")
    more = rows.groupBy("space_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("space_id", F.lit(most + 1).alias("nth"), F.concat(F.lit("- … and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line"))
    return ranked.unionByName(more)


def embed_missing(chunks: DataFrame, embeddings: DataFrame, embed, batch: int = 10) -> DataFrame:
    """id and vec for the chunks (id, text) without a vector. embed takes a list
    of texts, `batch` at most, and gives as many vectors of one length, in
    order; anything else is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                vecs = embed(part["text"].tolist())
                if len(vecs) != len(part) or len({len(v) for v in vecs}) != 1 or not len(vecs[0]):
                    raise ValueError("the provider gave vectors of wrong number or length")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": [list(map(float, v)) for v in vecs]})

    todo = chunks.select("id", "text").join(embeddings.select("id"), "id", "left_anti")
    return todo.mapInPandas(run, "id long, vec array<double>")


def hash_embedder(texts: list[str], dim: int = 8) -> list[list[float]]:
    """The offline embedder: parts of a digest, in -1 to 1. Tells equal texts
    from others and nothing more."""
    import hashlib

    return [[b / 127.5 - 1 for b in hashlib.sha256(t.encode()).digest()[:dim]] for t in texts]


def extraction_recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Over sessions with expectations (session_id, expect): n and recall, the
    share whose normalised text some found note (session_id, text) contains."""
    from loreforge.functions.text import norm_title

    # an expectation meets each note of its session by itself: no session is gathered
    e = expected.select("session_id", norm_title(F.col("expect")).alias("e"))
    f = found.select("session_id", norm_title(F.col("text")).alias("f"))
    hits = e.join(f, (e["session_id"] == f["session_id"]) & F.contains("f", F.col("e")), "left_semi")
    return e.agg(F.count(F.lit(1)).alias("n")).crossJoin(hits.agg(F.count(F.lit(1)).alias("h"))).select("n", F.try_divide(F.col("h"), F.col("n")).cast("double").alias("recall"))


def max_of_prefix(meta: DataFrame, prefix: str) -> DataFrame:
    """The greatest value (as text) of the keys that begin with a prefix, and how
    many keys there are; a null value of no key."""
    return meta.filter(F.startswith("key", F.lit(prefix))).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))


def increment(meta: DataFrame, adds: DataFrame) -> DataFrame:
    """key and value after counters are raised: adds (key, n) are summed per key;
    a key that is new, or whose value is no number, counts from 0."""
    total = adds.groupBy("key").agg(F.sum("n").alias("n"))
    both = meta.alias("m").join(total.alias("a"), "key", "full_outer")
    now = (F.coalesce(F.expr("try_cast(m.value AS BIGINT)"), F.lit(0)) + F.col("a.n")).cast("string")
    return both.select("key", F.when(F.col("a.n").isNull(), F.col("m.value")).otherwise(now).alias("value"))


def mark_extracted(raws: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """Raws (session_id, seq, extracted_at) after those of done (session_id, seq)
    are extracted; one that was keeps its time."""
    hit = done.select("session_id", "seq").distinct().withColumn("_hit", F.lit(True))
    out = raws.join(hit, ["session_id", "seq"], "left")
    return out.withColumn("extracted_at", F.when(F.col("extracted_at").isNull() & F.col("_hit"), at).otherwise(F.col("extracted_at"))).drop("_hit")


def pending_raws(raws: DataFrame) -> DataFrame:
    """Per session what waits for extraction: n, first_seq, last_seq and bytes."""
    rows = raws.filter("extracted_at is null")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("bytes").alias("bytes"))
