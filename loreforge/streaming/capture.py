"""Transcript capture and usage metering as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreforge.operators.reports import usage_rollup
from loreforge.operators.state import next_seq


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of deltas sorted by session and expected offset those that go on from the
    stored end `at`, or from one another."""
    session, end = None, None
    for batch in batches:
        keep = []
        columns = (batch.column(c).to_pylist() for c in ("session_id", "expect_offset", "new_offset", "at"))
        for i, (s, expect, new, at) in enumerate(zip(*columns, strict=True)):
            if s != session:
                session, end = s, at
            if expect == end:
                keep.append(i)
                end = new
        yield batch.take(pa.array(keep, pa.int64()))


def accept_deltas(raws: DataFrame, deltas: DataFrame) -> DataFrame:
    """Of a batch of transcript deltas (session_id, expect_offset, new_offset,
    content) those whose expected offset is where the session's last stored raw
    ends, or where an accepted delta of the batch ends; others are dropped
    silently, so a replayed batch adds nothing. Of deltas that expect one offset
    the longest counts, once. A delta that ends before what it expects is of a
    file that began anew; nothing of the batch can follow it. An expected offset
    of -1 is not checked: such a delta is taken as it is and moves no offset.

    The chain is followed over offsets alone, in a sorted stream per session;
    contents are joined to what was accepted."""
    kind = dict(deltas.dtypes)["session_id"]
    ends = raws.filter("expect_offset >= 0").groupBy("session_id").agg(F.max_by("new_offset", "seq").alias("at"))
    told = deltas.select("session_id", "expect_offset", "new_offset", "content", F.sha2("content", 256).alias("h"))
    one = told.filter("expect_offset >= 0 and new_offset <> expect_offset").groupBy("session_id", "expect_offset").agg(F.max(F.struct("new_offset", "h")).alias("d")).select("session_id", "expect_offset", "d.*")
    rows = one.join(ends, "session_id", "left").withColumn("at", F.coalesce("at", F.lit(0)).cast("long"))
    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "expect_offset")
    took = dealt.mapInArrow(_follow, f"session_id {kind}, expect_offset long, new_offset long, h string, at long").select("session_id", "expect_offset", "new_offset", "h")
    found = told.dropDuplicates(["session_id", "expect_offset", "new_offset", "h"]).join(took, ["session_id", "expect_offset", "new_offset", "h"], "left_semi")
    loose = told.filter("expect_offset = -1")
    return found.unionByName(loose).select("session_id", "expect_offset", "new_offset", "content")


class Raws:
    """The stored raws (session_id, seq, expect_offset, new_offset, content) as
    one folder per micro-batch. A batch is written to the folder of its number,
    which counts once its _SUCCESS mark stands; a batch that is run again after a
    failure replaces its folder, so nothing is stored twice, and what was stored
    before is never rewritten."""

    SCHEMA = "session_id long, seq int, expect_offset long, new_offset long, content string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, before: int | None = None) -> DataFrame:
        """All stored raws, or those of the batches before one."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root)
        names = [f.getPath().getParent().getName() for f in found or []]
        paths = [f"{self.path}/{n}" for n in names if before is None or int(n[6:]) < before]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, deltas: DataFrame, number: int) -> DataFrame:
        """Stores what a batch of deltas adds, and returns it."""
        raws = self.read(number)
        new = next_seq(raws, accept_deltas(raws, deltas), "session_id", ["expect_offset"])
        path = f"{self.path}/batch-{number}"
        new.select("session_id", F.col("seq").cast("int").alias("seq"), "expect_offset", "new_offset", "content").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.SCHEMA).parquet(path)


def extract_jobs(new: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """type and payload of the extraction jobs that new raws ask for: one per
    session, none where jobs (type, payload, state) has one that is queued or
    failed, which will take these raws too. One that runs may not have seen them."""
    wanted = new.select(F.lit("extract").alias("type"), F.to_json(F.struct("session_id")).alias("payload")).distinct()
    if jobs is None:
        return wanted
    return wanted.join(jobs.filter(F.col("state").isin("queued", "failed")).select("type", "payload"), ["type", "payload"], "left_anti")


def expedite(jobs: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """The job table after sessions (session_id) ended: their queued extraction is
    due now; a failed one keeps its back-off."""
    mine = ended.select(F.lit("extract").alias("type"), F.to_json(F.struct("session_id")).alias("payload"), F.lit(True).alias("hit")).distinct()
    rows = jobs.join(mine, ["type", "payload"], "left")
    due = F.coalesce("hit", F.lit(False)) & (F.col("state") == "queued") & (F.col("run_after") > now)
    return rows.withColumns({"run_after": F.when(due, now).otherwise(F.col("run_after")), "updated_at": F.when(due, now).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def capture(stream: DataFrame, raws: Raws, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Commits a stream of deltas to the raws; `then` gets each batch's new rows
    (extract_jobs makes jobs of them)."""

    def commit(batch: DataFrame, number: int) -> None:
        new = raws.add(batch, number)
        if then:
            then(new)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_spool(raws: DataFrame, spool: DataFrame) -> DataFrame:
    """What a spool of deltas that could not be sent (spooled_at, line: their
    JSON) adds to the raws: lines that are no deltas are dropped, equal ones
    count once, and only those that go on from a session's stored end, or from
    one another, are taken, as if they had come in time."""
    delta = F.from_json("line", "session_id long, expect_offset long, new_offset long, content string")
    rows = spool.select(delta.alias("d")).select("d.*").filter("session_id is not null and expect_offset is not null and new_offset is not null and content is not null")
    new = next_seq(raws, accept_deltas(raws, rows), "session_id", ["expect_offset"])
    return new.select("session_id", F.col("seq").cast("int").alias("seq"), "expect_offset", "new_offset", "content")


def spool_files(files: DataFrame) -> DataFrame:
    """session_id, expect_offset, new_offset and content (gzip bytes) of spooled
    files (path, content), named `<session>~<expect>~<new>~<time>.gz`, or, in the
    old way, `<session>-<time>.gz`, which know no offsets (-1 and 0). Hidden files
    and other names are none."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    parts = F.split(F.regexp_replace(name, r"\.gz$", ""), "~")
    whole = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
    new = (F.size(parts) == 4) & (parts[0] != "") & whole(2).isNotNull() & whole(3).isNotNull()
    old = (F.size(parts) != 4) & name.rlike(r"^.+-[^-]*\.gz$")
    rows = files.filter(name.endswith(".gz") & ~name.startswith(".") & (new | old))
    session = F.when(F.size(parts) == 4, parts[0]).otherwise(F.regexp_extract(name, r"^(.+)-[^-]*\.gz$", 1))
    return rows.select(session.alias("session_id"), F.when(F.size(parts) == 4, whole(2)).otherwise(F.lit(-1)).cast("long").alias("expect_offset"), F.when(F.size(parts) == 4, whole(3)).otherwise(F.lit(0)).cast("long").alias("new_offset"), "content")


def hourly_usage(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """usage_rollup by hour on a stream of calls (ts), late ones within `late`."""
    rows = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if calls.isStreaming else calls
    return usage_rollup(rows, F.window("ts", "1 hour")).withColumn("hour", F.col("window.start")).drop("window")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user on a stream: events within the gap belong together."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at")).drop("w")
