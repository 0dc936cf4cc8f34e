"""Greedy packing of ordered rows of any number, a range at a time.

Whether a line opens a batch depends on how full the batch before it is, so the
rule is sequential. But of a range of rows one can say, for every fill that it
may begin with, what fill it ends with and how many batches it opens: greedy
packings that begin differently soon agree, so this is a short list of intervals.
Ranges are summed up apart, their lists are followed from range to range (a row
of numbers for each task), and then each range packs its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.sources.scratch import written


class Fills:
    """What becomes of every fill 0 to `most` as lines are added. Fills that have
    become equal are followed as one."""

    def __init__(self, most: int):
        self.most = most
        self.of = np.arange(most + 1)  # of each fill at the start, its class
        self.opened = np.zeros(most + 1, np.int64)
        self.held = np.arange(most + 1)  # of each class, the fill by now
        self.count = np.zeros(most + 1, np.int64)
        self.added = 0

    def add(self, size: int) -> None:
        cut = (self.held > 0) & (self.held + size > self.most)
        self.held = np.where(cut, size, self.held + size)
        self.count += cut
        self.added += 1
        if self.added % 32 == 0 and len(self.held) > 1:
            self.merge()

    def merge(self) -> None:
        self.opened += self.count[self.of]
        self.held, new = np.unique(self.held, return_inverse=True)
        self.of, self.count = new[self.of], np.zeros(len(self.held), np.int64)

    def result(self) -> list[tuple[int, int, int]]:
        """(first fill at the start, fill at the end, batches opened) of runs of
        fills that end alike."""
        self.merge()
        held = self.held[self.of]
        edge = np.flatnonzero(np.r_[True, (held[1:] != held[:-1]) | (self.opened[1:] != self.opened[:-1])])
        return [(int(i), int(held[i]), int(self.opened[i])) for i in edge]


def _step(held: int, size: int, most: int) -> tuple[int, int]:
    return (size, 1) if held and held + size > most else (held + size, 0)


def _summed(most: int):
    kind = pa.list_(pa.struct([("from", pa.int64()), ("held", pa.int64()), ("opened", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = first = last = None
        fills, held, batch_no = Fills(most), 0, 0
        for batch in batches:
            for at, g, size in zip(batch.column("p").to_pylist(), batch.column("g").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if p is None:
                    p, first, last = at, g, g
                if g != last:
                    last, held, batch_no = g, 0, 0
                if g == first:
                    fills.add(size)
                held, more = _step(held, size, most)
                batch_no += more
        if p is not None:
            spans = [{"from": a, "held": b, "opened": c} for a, b, c in fills.result()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([first]), pa.array([last]), pa.array([spans], kind), pa.array([held]), pa.array([batch_no])], ["p", "first", "last", "spans", "held", "batch"])

    return run


def _numbered(most: int, entry: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, no = None, 0, 0
        for batch in batches:
            out = []
            for at, g, size in zip(batch.column("p").to_pylist(), batch.column("g").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if last is None:
                    held, no = entry[at]
                elif g != last:
                    held, no = 0, 0
                last = g
                held, more = _step(held, size, most)
                no += more
                out.append(no)
            names = [c for c in batch.schema.names if c not in ("p", "g", "size")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], [*names, "batch"])

    return run


def packed(rows: DataFrame, group: list[str], order: str, size: str, most: int) -> DataFrame:
    """The rows with batch, from 0 in each group: lines in order go on with a
    batch while its sizes, one more for each line, stay within `most`; a line over
    the bound stands alone. Rows of one group are dealt over tasks like any
    others. The order tells the rows of a group apart."""
    g = F.concat_ws("\0", *(F.concat(F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in group))
    keyed = rows.withColumns({"g": g, "size": (F.col(size) + 1).cast("int")})
    # a range is what one task holds, in order; ranges stand in the order of their numbers
    dealt = written(keyed.repartitionByRange("g", order).withColumn("p", F.spark_partition_id()), "packing")

    def each(fn, schema: str) -> DataFrame:
        by = [("g", "ascending"), (order, "ascending")]
        return dealt.groupBy("p").applyInArrow(lambda t: pa.Table.from_batches(fn(iter(t.sort_by(by).combine_chunks().to_batches()))), schema)

    sums = each(_summed(most), "p int, first string, last string, spans array<struct<from:long,held:long,opened:long>>, held long, batch long")
    entry, end = {}, (None, 0, 0)
    for r in sums.orderBy("p").collect():  # a row for each range
        entry[r.p] = (end[1], end[2]) if r.first == end[0] else (0, 0)
        if r.first == r.last:
            held, no = entry[r.p]
            span = [s for s in r.spans if s["from"] <= held][-1]
            end = (r.last, span["held"], no + span["opened"])
        else:
            end = (r.last, r.held, r.batch)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return each(_numbered(most, entry), f"{kinds}, batch long")
