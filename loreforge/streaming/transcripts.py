"""Transcript files as a streaming source.

    register(spark)
    spark.readStream.format("transcripts").option("path", folder).load()

A row is what a file gained, in whole lines: session_id (the file's name without
its ending), expect_offset and new_offset (bytes), content, and reset. The
stream's offset has the bytes read of every file, so a restart goes on where the
last batch ended. A half-written line waits for its end. A file that became
shorter is read again from its start; its first row still expects the old
offset, and says reset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "session_id string, expect_offset bigint, new_offset bigint, content string, reset boolean"
#: Bytes of a row, unless one line is longer, and bytes looked at to find a line's end.
ROW_BYTES, LOOK = 1 << 20, 1 << 16


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Piece(InputPartition):
    """Bytes of a file that one task reads: from `start`, which the first row
    expects as `expect`, to `end`."""

    name: str
    expect: int
    start: int
    end: int


class TranscriptReader(DataSourceStreamReader):
    """path: a folder that the driver and all executors reach. suffix: the ending
    of its transcripts. max_bytes: how much a batch takes, in whole lines; the
    first batch after a start, which does not yet know where the one before
    ended, takes all, in rows of bounded size. An offset names every file of the
    folder, so ended sessions are to be moved out of it."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.max_bytes = int(options.get("maxbytesperbatch", options.get("maxBytesPerBatch", 0)))
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(self.suffix) and not f.base_name.startswith(".")}

    def _last_line_end(self, name: str, start: int, end: int) -> int:
        """The place after the last newline of the bytes from start to end."""
        system, root = _filesystem(self.path)
        with system.open_input_file(f"{root}/{name}") as f:
            hi = end
            while hi > start:
                lo = max(start, hi - LOOK)
                f.seek(lo)
                at = f.read(hi - lo).rfind(b"\n")
                if at >= 0:
                    return lo + at + 1
                hi = lo
        return start

    def _next_line_end(self, name: str, start: int, end: int) -> int:
        """The place after the first newline from start on; start if none."""
        system, root = _filesystem(self.path)
        with system.open_input_file(f"{root}/{name}") as f:
            lo = start
            while lo < end:
                f.seek(lo)
                data = f.read(min(LOOK, end - lo))
                at = data.find(b"\n")
                if at >= 0:
                    return lo + at + 1
                lo += len(data) or LOOK
        return start

    def latestOffset(self) -> dict:
        known = (self.known or {}).get("files", {})
        left = self.max_bytes if self.max_bytes and self.known is not None else None
        out = dict(known)
        for name, size in sorted(self._sizes().items()):
            was = known.get(name, {"gen": 0, "end": 0})
            gen, start = (was["gen"], was["end"]) if size >= was["end"] else (was["gen"] + 1, 0)
            if left is not None and left <= 0:
                continue
            stop = size if left is None else min(size, start + left)
            end = self._last_line_end(name, start, stop)
            if end == start and stop < size:  # a line longer than what is left of the batch
                end = self._next_line_end(name, stop, size)
                end = start if end == stop else end
            if end > start:
                out[name] = {"gen": gen, "end": end}
                left = None if left is None else left - (end - start)
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.known = end
        out = []
        for name, to in end["files"].items():
            was = start["files"].get(name, {"gen": 0, "end": 0})
            if to["gen"] > was["gen"] or to["end"] < was["end"]:
                out.append(Piece(name, was["end"], 0, to["end"]))
            elif to["end"] > was["end"]:
                out.append(Piece(name, was["end"], was["end"], to["end"]))
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        system, root = _filesystem(self.path)
        session = PurePosixPath(partition.name).name.removesuffix(self.suffix)
        expect, at, held = partition.expect, partition.start, b""
        with system.open_input_file(f"{root}/{partition.name}") as f:
            f.seek(at)
            while at + len(held) < partition.end:
                data = f.read(min(ROW_BYTES, partition.end - at - len(held)))
                if not data:
                    break  # it was cut again meanwhile; the next batch finds out
                held += data
                cut = held.rfind(b"\n") + 1
                if cut:
                    yield session, expect, at + cut, held[:cut].decode("utf-8", "replace"), expect > at
                    expect = at = at + cut
                    held = held[cut:]


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Transcripts)
