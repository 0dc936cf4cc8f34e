"""Tables that know the version of their layout, and how an old one becomes new.

A version is a folder of whole tables, `v<n>`, that counts once its mark stands,
written last. An upgrade takes the tables from one version to the next, a step
at a time. The folder that a step read is the copy that is kept; a step that was
cut off has no mark and is done again; where the last version stands an upgrade
does nothing. Tables that a step does not name are carried over as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
#: From the tables of one version to those it changes for the next.
Step = Callable[[Tables], Tables]


def _with(df: DataFrame, **columns) -> DataFrame:
    """df with those columns that it does not have."""
    return df.withColumns({c: x for c, x in columns.items() if c not in df.columns})


def media_errors(t: Tables) -> Tables:
    return {"media": _with(t["media"], last_error=F.lit(""))}


def structured(t: Tables) -> Tables:
    """Meta data and status of notes, and what is known of tasks."""
    none = {c: F.lit(None).cast("string") for c in ("why", "owner", "waiting_on", "due_at", "constraints")}
    return {"notes": _with(t["notes"], meta=F.lit("{}"), status=F.lit("active"), superseded_by=F.lit(None).cast("long")), "tasks": _with(t["tasks"], **none)}


def extracted_raws(t: Tables) -> Tables:
    """Raws that no waiting, failed or running job names in its payload were
    extracted when they came. A payload that names no raw, or is broken, names
    none; an anti join, so that null ids among the jobs hide nothing."""
    job = t["jobs"].filter((F.col("type") == "extract_session") & F.col("state").isin("queued", "failed", "running"))
    waits = job.select(F.get_json_object("payload", "$.raw_id").try_cast("long").alias("id")).filter("id is not null").distinct()
    rows = t["raws"].join(waits.withColumn("_waits", F.lit(True)), "id", "left")
    return {"raws": rows.withColumn("extracted_at", F.when(F.col("_waits").isNull(), F.col("at"))).select(*t["raws"].columns, "extracted_at")}


def task_times(t: Tables) -> Tables:
    tasks = _with(t["tasks"], created_at=F.lit(None).cast(t["tasks"].schema["updated_at"].dataType))
    return {"tasks": tasks.withColumn("created_at", F.coalesce("created_at", "updated_at"))}


def projects(t: Tables) -> Tables:
    none = F.lit(None).cast("string")
    return {name: _with(t[name], project=none, **({"cwd": none} if name == "sessions" else {})) for name in ("notes", "tasks", "sessions") if name in t}


def vector_scales(t: Tables) -> Tables:
    """Vectors without a scale are of the old kind, four bytes a component."""
    return {"embeddings": _with(t["embeddings"], scale=F.lit(None).cast("double"))} if "embeddings" in t else {}


#: The version that each step leads to.
STEPS: dict[int, Step] = {2: media_errors, 3: lambda t: {}, 4: structured, 5: extracted_raws, 6: task_times, 7: projects, 8: vector_scales}
LATEST = max(STEPS)


class Layouts:
    """The versions of tables under `path`, a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, steps: Mapping[int, Step] = STEPS):
        self.spark, self.path, self.steps = spark, path.rstrip("/"), steps

    def _found(self, pattern: str) -> list:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return [f.getPath() for f in found or []]

    def versions(self) -> list[int]:
        """Those that stand, in order."""
        return sorted(int(p.getParent().getParent().getName()[1:]) for p in self._found("v*/mark/_SUCCESS"))

    def version(self) -> int:
        """The last that stands; 0 if none does."""
        return (self.versions() or [0])[-1]

    def read(self, version: int | None = None) -> Tables:
        version = self.version() if version is None else version
        return {p.getName(): self.spark.read.parquet(p.toString()) for p in self._found(f"v{version}/*") if p.getName() != "mark"}

    def write(self, version: int, tables: Tables) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/v{version}/mark")

    def upgrade(self, to: int | None = None) -> list[int]:
        """Brings the tables to version `to` (the last step's); returns the
        versions that were made. Tables of a later version than is known are
        an error, and so is an upgrade of nothing."""
        to, at, made = max(self.steps) if to is None else to, self.version(), []
        if not at:
            raise ValueError("there are no tables to upgrade")
        if at > max(self.steps):
            raise ValueError(f"tables have version {at}, known is {max(self.steps)}")
        while at < to:
            tables = self.read(at)
            at += 1
            self.write(at, tables | self.steps[at](tables))
            made.append(at)
        return made

    def keep(self, n: int) -> int:
        """Deletes all versions that stand but the n last; returns how many."""
        old = self.versions()[:-n] if n > 0 else []
        for v in old:
            for p in self._found(f"v{v}"):
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(old)
