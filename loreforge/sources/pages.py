"""Documents as a batch source, a row for each page.

    register(spark)
    spark.read.format("documents").option("path", folder).load()

Files of the formats that sources.documents reads become rows of path, page
(from 1), label (a slide, a chapter), text and error. A file that cannot be read,
or has no text, is a row with page 0 and its error, so that nothing is lost
silently. Files are dealt to tasks by size, the largest first, each to the task
that has least.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loreforge.sources.documents import read_parts

SCHEMA = "path string, page int, label string, text string, error string"
#: Bytes of files for one task; a larger file is a task by itself.
TASK_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    names: list[str]


def dealt(sizes: list[tuple[str, int]], most: int = TASK_BYTES) -> list[list[str]]:
    """Names in groups of about equal size, as many as the total asks for."""
    n = max(1, min(len(sizes), -(-sum(s for _, s in sizes) // most)))
    heap = [(0, i) for i in range(n)]
    groups: list[list[str]] = [[] for _ in range(n)]
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, i = heapq.heappop(heap)
        groups[i].append(name)
        heapq.heappush(heap, (held + size + 1, i))
    return [g for g in groups if g]


class PageReader(DataSourceReader):
    """path: a folder, searched at all depths, that driver and executors reach.
    taskbytes: bytes of files for one task."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        return [Files(g) for g in dealt(files, self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = self._open()
        for name in partition.names:
            short = name[len(root) :].lstrip("/")
            try:
                with system.open_input_stream(name) as f:
                    data = f.read()
            except OSError as e:
                yield short, 0, None, None, f"{type(e).__name__}: {e}"[:300]
                continue
            parts, error = read_parts(name, data)
            if error:
                yield short, 0, None, None, error
            for page, (label, text) in enumerate(parts, 1):
                yield short, page, label, text, None


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)
