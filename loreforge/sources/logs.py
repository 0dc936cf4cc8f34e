"""A log of JSON lines as a streaming sink, rotated by size.

Each micro-batch is a folder of its number; a batch that is sent again after a
failure is found and written no second time. Batches are gathered in generations:
when one has grown over `most` bytes the next batch begins a new one, and all but
the `keep` last generations go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: The size from which a log is rotated, and the generations kept.
MOST, KEEP = 5 << 20, 2


class LogSink:
    """The log under `path`, a folder that the cluster shares; one stream writes it."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST, keep: int = KEEP):
        self.spark, self.path, self.most, self.keep = spark, path.rstrip("/"), most, keep

    def _found(self, pattern: str) -> list:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return [f.getPath() for f in found or []]

    def generations(self) -> list[int]:
        return sorted(int(p.getName()[4:]) for p in self._found("gen-*"))

    def batches(self) -> list[int]:
        """Numbers of the batches that stand, of all generations that are kept."""
        return sorted(int(p.getParent().getName()[6:]) for p in self._found("gen-*/batch-*/_SUCCESS"))

    def size(self, generation: int) -> int:
        """Bytes of the batches of a generation that stand."""
        folders = [p.getParent() for p in self._found(f"gen-{generation}/batch-*/_SUCCESS")]
        return sum(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in folders)

    def add(self, rows: DataFrame, number: int) -> bool:
        """Writes a batch; returns whether it is new. A batch without rows is
        written too, so that it is known."""
        if number in self.batches():
            return False
        held = self.generations()
        at = held[-1] if held else 0
        if held and self.size(at) > self.most:
            at += 1
        rows.write.mode("overwrite").json(f"{self.path}/gen-{at}/batch-{number}")
        for g in held:
            if g <= at - self.keep:
                for p in self._found(f"gen-{g}"):
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return True

    def read(self, schema: str) -> DataFrame:
        """The lines that are kept."""
        paths = [p.getParent().toString() for p in self._found("gen-*/batch-*/_SUCCESS")]
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)


def log_calls(calls: DataFrame, sink: LogSink, checkpoint: str) -> StreamingQuery:
    """Writes a stream of calls (any columns) to the log."""

    def add(batch: DataFrame, number: int) -> None:
        sink.add(batch, number)

    return calls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
