"""Writers: the Markdown vault, versioned tables and their retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.functions.text import slug


def vault_notes(notes: DataFrame, spaces: dict[int, str] | None = None) -> DataFrame:
    """path and body of a Markdown file per note that is not deleted: kind, tags
    (JSON), created, updated (UTC), source (quoted), session where there is one,
    then the text. notes have tags, created_at and updated_at; session_id may be
    absent."""
    names = F.create_map(*(F.lit(x) for kv in spaces.items() for x in kv)) if spaces else None
    own = F.col("space_id").cast("string")
    space = own if names is None else F.coalesce(names[F.col("space_id")], own)
    path = F.concat(space, F.lit("/"), "kind", F.lit("/"), F.col("id").cast("string"), F.lit("-"), slug(F.col("text")), F.lit(".md"))
    at = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    quoted = F.concat(F.lit('"'), F.regexp_replace("source", r'([\\"])', r"\\$1"), F.lit('"'))
    head = [F.lit("---"), F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("tags: "), F.to_json(F.coalesce("tags", F.array().cast("array<string>")))), F.concat(F.lit("created: "), at("created_at")), F.concat(F.lit("updated: "), at("updated_at")), F.concat(F.lit("source: "), quoted)]
    if "session_id" in notes.columns:
        head.append(F.concat(F.lit("session: "), F.col("session_id").cast("string")))
    body = F.concat(F.concat_ws("\n", *head, F.lit("---")), F.lit("\n\n"), "text", F.lit("\n"))
    return notes.filter("deleted_h is null").select(path.alias("path"), body.alias("body"))


def vault_tasks(tasks: DataFrame) -> DataFrame:
    """One checklist line per task, with its space: [x] done, [-] dropped; the
    next step follows where there is one."""
    box = F.when(F.col("status") == "done", "x").when(F.col("status") == "dropped", "-").otherwise(" ")
    step = F.when(F.col("next_step").isNotNull(), F.concat(F.lit(" — next: "), "next_step")).otherwise("")
    return tasks.select("space_id", "id", F.concat(F.format_string("- [%s] %s", box, "title"), step).alias("line"))


def vault_relations(relations: DataFrame) -> DataFrame:
    """One line per relation, with the note that it came from."""
    note = F.when(F.col("source_note_id").isNotNull(), F.concat(F.lit(" — note #"), F.col("source_note_id").cast("string"))).otherwise("")
    return relations.select("id", F.concat(F.format_string("- %s → %s (%s)", "from_ref", "to_ref", "rel_type"), note).alias("line"))


def _write_files(root: str):
    """Writes path and body of a task's rows as files, through the file system that pyarrow finds for the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                full = f"{base}/{path}"
                where.create_dir(full.rpartition("/")[0], recursive=True)
                with where.open_output_stream(full) as f:
                    f.write(body.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def write_vault(notes: DataFrame, tasks: DataFrame, relations: DataFrame, path: str, spaces: dict[int, str] | None = None) -> dict[str, int]:
    """The vault under `path`, a URI of a folder that all executors share: a
    Markdown file per note, and task and relation lines as text parts by space.
    Files are written by the tasks that hold the notes; writing again replaces
    them. Returns how many notes, tasks and relations there are."""
    root = path if "://" in path else f"file://{path}"
    written = vault_notes(notes, spaces).mapInArrow(_write_files(root), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lines = vault_tasks(tasks).repartition("space_id").sortWithinPartitions("space_id", "id")
    lines.select("space_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("space_id").text(f"{path}/tasks")
    vault_relations(relations).repartitionByRange("id").sortWithinPartitions("id").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/relations")
    return {"notes": written, "tasks": tasks.count(), "relations": relations.count()}


class Versions:
    """A table as numbered Parquet versions. A version counts once its _SUCCESS
    mark stands. A writer claims a number by creating its claim file, which only
    one can; a claim without a version is of a writer that died, and a later write
    takes the next number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted(v for v in found if fs.exists(self._fs(f"{self.path}/v{v}/_SUCCESS")[0]))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]}")

    def write(self, df: DataFrame, expect: int | None = None) -> int | None:
        """Adds a version; with `expect`, only if that is the latest one (0: none)."""
        last = (self.versions() or [0])[-1]
        if expect is not None and expect != last:
            return None
        new = last + 1
        while not self._claim(new):
            if expect is not None:
                return None
            new += 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        return new

    def _claim(self, version: int) -> bool:
        p, fs = self._fs(f"{self.path}/claims/v{version}")
        fs.mkdirs(p.getParent())
        return bool(fs.createNewFile(p))

    def keep(self, n: int) -> int:
        """Deletes all but the n latest; returns how many."""
        old = self.versions()[:-n] if n > 0 else []
        for v in old:
            p, fs = self._fs(f"{self.path}/v{v}")
            fs.delete(p, True)
        return len(old)
