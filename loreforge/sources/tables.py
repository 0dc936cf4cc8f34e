"""Several tables that change together.

A commit names its batch and gives, per table, rows that are new or replace
those of the same key and keys that go. Each is written to the batch's folder,
and the batch counts once its mark stands, which is written last: a commit that
failed half-way is none and is written anew, one that succeeded is found again
and does nothing. Readers see all of a batch or nothing of it.

A table is its last whole copy and the changes after it, joined by key; compact
writes whole copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableSet:
    """Tables under `path`, a folder that the cluster shares. schemas: DDL by
    table, keys: the key column of each. One batch is committed at a time."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], keys: dict[str, str]):
        self.spark, self.path, self.schemas, self.keys = spark, path.rstrip("/"), schemas, keys

    def _glob(self, pattern: str) -> list:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return [f.getPath() for f in found or []]

    def _marks(self) -> list[tuple[int, str, bool]]:
        """Number, batch and whether it is whole copies, of each commit in order."""
        folders = [p.getParent() for p in self._glob("*/mark-*/_SUCCESS")]
        return sorted((int(p.getName().split("-")[1]), p.getParent().getName()[6:], p.getName().endswith("-whole")) for p in folders)

    def batches(self) -> list[str]:
        return [b for _, b, _ in self._marks()]

    def _schema(self, table: str) -> str:
        return self.schemas[table]

    def read(self, table: str) -> DataFrame:
        """The rows of a table after all commits."""
        marks = self._marks()
        last = max((i for i, m in enumerate(marks) if m[2]), default=None)
        base = self.spark.createDataFrame([], self._schema(table))
        if last is not None:
            base = self.spark.read.schema(self._schema(table)).parquet(f"{self.path}/batch-{marks[last][1]}/{table}")
        key = self.keys[table]
        held = {(p.getParent().getName()[6:], p.getName()) for p in self._glob(f"batch-*/{table}*")}
        rows, gone = None, None
        for n, b, _ in marks[0 if last is None else last + 1 :]:
            for name in (table, f"{table}-gone"):
                if (b, name) not in held:
                    continue
                one = self.spark.read.schema(self._schema(table)).parquet(f"{self.path}/batch-{b}/{name}").withColumn("_n", F.lit(n))
                if name == table:
                    rows = one if rows is None else rows.unionByName(one)
                touched = one.select(key, "_n")
                gone = touched if gone is None else gone.unionByName(touched)
        if gone is None:
            return base
        latest = gone.groupBy(key).agg(F.max("_n").alias("_n"))
        out = base.join(latest.select(key), key, "left_anti").select(*base.columns)
        # a key that one batch both puts in and takes out is put in
        return out if rows is None else out.unionByName(rows.join(latest, [key, "_n"]).select(*base.columns))

    def commit(self, batch_id: str, puts: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> bool:
        """puts: rows by table; gone: by table the keys that go. Returns whether
        the batch is new. A null key, or one twice among the puts of a table, is
        an error."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        marks = self._marks()
        if batch_id in [b for _, b, _ in marks]:
            return False
        out = f"{self.path}/batch-{batch_id}"
        for table, rows in puts.items():
            names = self.spark.createDataFrame([], self._schema(table))
            rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in names.schema)).write.mode("overwrite").parquet(f"{out}/{table}")
            n, ids, some = self.spark.read.schema(self._schema(table)).parquet(f"{out}/{table}").agg(F.count(F.lit(1)), F.count_distinct(self.keys[table]), F.count(self.keys[table])).first()
            if not n == ids == some:
                raise ValueError(f"a batch has each key of {table} once")
        for table, keys in (gone or {}).items():
            keys.select(F.col(self.keys[table])).distinct().write.mode("overwrite").parquet(f"{out}/{table}-gone")
        self._seal(f"{out}/mark-{marks[-1][0] + 1 if marks else 1}")
        return True

    def compact(self, batch_id: str) -> bool:
        """Whole copies of all tables, under one mark too."""
        marks = self._marks()
        if batch_id in [b for _, b, _ in marks]:
            return False
        for table in self.schemas:
            self.read(table).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}/{table}")
        self._seal(f"{self.path}/batch-{batch_id}/mark-{marks[-1][0] + 1 if marks else 1}-whole")
        return True

    def _seal(self, path: str) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(path)
