"""Mixing sources to target weights by a low-discrepancy schedule.

A source's texts are shuffled by a hash and laid end to end; that line is cut
into blocks of `block` words. The mix is a sequence of slots: the n-th point of
the golden-ratio sequence, mapped through the cumulative numbers of blocks due,
names the source of slot n. A source's slots are ranked, and its r-th slot takes
its r-th block, so any stretch of the mix has every source near its share.

Sums and ranks over all rows are taken in two levels, first within buckets of
bounded size and then over the buckets, so no source is sorted in one task. Only
one row per source is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import WORD
from .storage import written

BLOCK = 2048
#: Sources up to this number are sent to all executors (some 100 bytes each).
BROADCAST_SOURCES = 100_000
_CHUNK = 4096
_GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """Per source: s (its number by code point, null last), source, source_size,
    target and due (words to take).

    Sources weigh 1, 2, 3, repeating, and share the sum of all sizes; a target
    stops at `most` times its source's size, and the excess is shared again by
    weight. That ends in target = min(cap, level * weight) with one level for
    all, found over the sources in the order of cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumns({"w": (F.col("s") % 3 + 1).cast("double"), "cap": F.lit(most) * F.col("source_size")})
    by = Window.orderBy(F.col("cap") / F.col("w"), "s")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    tried = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    # the first source that its cap does not stop sets the level
    found = tried.withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("s")))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return found.select("s", "source", "source_size", target.alias("target"), F.least(F.floor(target + 0.5), F.floor("cap")).alias("due"))


def _bucketed_start(rows: DataFrame, group: str, bucket: str, order: list[Column], value: Column) -> DataFrame:
    """Adds start: the sum of `value` over the earlier rows of the group."""
    inner = Window.partitionBy(group, bucket).orderBy(*order)
    local = rows.withColumn("start", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - value)
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("total"))
    outer = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, bucket, F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("base"))
    return local.join(base, [group, bucket]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def _draw(cum: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            u = np.modf((n + 0.5) * _GOLDEN)[0]
            s = np.minimum(np.searchsorted(cum, u, side="right"), len(cum) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(s.astype(np.int32))], ["slot", "s"])

    return run


def schedule(spark, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, s and rank: every source has the ranks 0 to ceil(due / block) - 1.
    Slots beyond a source's last rank are left out; ranks that the points do not
    reach follow after the last point."""
    need = plan.select("s", F.ceil(F.col("due") / block).cast("long").alias("blocks")).filter("blocks > 0")
    rows = need.orderBy("s").collect()  # one row per source
    if not rows:
        return spark.createDataFrame([], "slot long, s int, rank long")
    blocks = np.zeros(max(r.s for r in rows) + 1, np.int64)
    for r in rows:
        blocks[r.s] = r.blocks
    total = int(blocks.sum())
    points = total + 16 * int(math.log2(total) + 1)
    drawn = spark.range(points).mapInArrow(_draw(np.cumsum(blocks) / total), "slot long, s int").withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    ranked = _bucketed_start(drawn, "s", "chunk", [F.col("slot")], F.lit(1)).select("slot", "s", F.col("start").alias("rank"))
    short = need.join(drawn.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < blocks")
    rest = short.select((F.lit(points) + F.col("s")).cast("long").alias("slot"), F.col("s").cast("int").alias("s"), F.explode(F.expr("sequence(n, blocks - 1)")).alias("rank"))
    return ranked.join(F.broadcast(need) if len(rows) <= BROADCAST_SOURCES else need, "s").filter("rank < blocks").select("slot", "s", "rank").unionByName(rest)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Returns (per document, pieces). Per document: the id, size (words), its
    source_size and target, taken (words that the mix takes, repeats counted),
    n_slots (slots that take of it) and first_slot (null if none). pieces: slot, rid, doc_from, words: what each slot takes of a row
    (rid as in the first result), in words from doc_from.

    Every source's taken words equal its target rounded; the line of a source is
    taken again from its start when it ends, at most `most` times. Null and
    empty texts have size 0 and are not taken; a null source is a source of its
    own; repeated rows and ids are rows of their own. The order is by a hash of
    id and size, then by id, size and text, so reruns agree whatever the layout. Other columns are ignored. An empty table gives
    empty results.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("tie"))
    sizes = written(sizes.withColumn("rid", F.monotonically_increasing_id()), "op7-sizes")
    sizes = sizes.withColumn("key", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string"))))
    plan = written(targets(sizes, most), "op7-plan")
    n_docs, n_sources = sizes.count(), plan.count()
    near = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    digits = max(1, math.ceil(math.log(max(n_docs, 1) / 2000 + 1, 16)))
    rows = sizes.join(near, sizes["source"].eqNullSafe(near["source"])).select("id", "rid", "size", "key", "tie", near["s"], "source_size", "target", "due", F.substring("key", 1, digits).alias("bucket"))
    laid = _bucketed_start(rows, "s", "bucket", [F.col("key"), F.col("id"), F.col("size"), F.col("tie"), F.col("rid")], F.col("size"))

    # the line of a source, unrolled: pass p covers [p * source_size, (p + 1) * source_size)
    passes = laid.filter("size > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    at = F.col("p") * F.col("source_size") + F.col("start")
    cut = passes.select("rid", "s", at.alias("lo"), F.least(at + F.col("size"), F.col("due")).alias("hi")).filter("hi > lo")
    parts = cut.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    from_, to = F.greatest("lo", F.col("rank") * block), F.least("hi", (F.col("rank") + 1) * block)
    parts = parts.select("rid", "s", "rank", (from_ - F.col("lo")).alias("doc_from"), (to - from_).alias("words"))
    pieces = parts.join(schedule(spark, plan, block), ["s", "rank"]).select("slot", "rid", "doc_from", "words")
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"), F.count_distinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"))
    per = rows.select("id", "rid", "size", "source_size", "target").join(taken, "rid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("taken", "n_slots")})
    return per.withColumnRenamed("id", id_col), pieces


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    per, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return per.select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot")


#: taken follows the definition: a document is taken wherever its place on the
#: line of its source lies below the words due, in three passes. The slots are
#: those of the schedule, point by point.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat(coalesce(doc_id::VARCHAR, ''), '|', len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))) AS key FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source
), q AS (SELECT *, (s % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM p),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM q WINDOW b AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, s LIMIT 1),
t AS (SELECT q.*, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM q),
u AS (SELECT *, least(floor(target + 0.5), floor(cap))::BIGINT AS due FROM t),
x AS (
  SELECT doc_id, key, s, size, source_size, target, due, coalesce(sum(size) OVER (PARTITION BY s ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
),
need AS (SELECT s, ((due + 2047) // 2048)::BIGINT AS blocks FROM u WHERE due > 0),
tot AS (SELECT sum(blocks)::BIGINT AS total, (sum(blocks) + 16 * (floor(log2(sum(blocks))) + 1))::BIGINT AS points FROM need),
cum AS (SELECT s, blocks, (sum(blocks) OVER (ORDER BY s) - blocks)::DOUBLE / total AS lo, (sum(blocks) OVER (ORDER BY s))::DOUBLE / total AS hi FROM need, tot),
drawn AS (SELECT slot, (slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS z FROM tot, range(points) r(slot)),
ranked AS (SELECT slot, s, blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank FROM drawn JOIN cum ON z >= lo AND z < hi),
held AS (SELECT s, count(*) AS n FROM ranked GROUP BY s),
slots AS (
  SELECT slot, s, rank FROM ranked WHERE rank < blocks
  UNION ALL SELECT points + s, s, unnest(range(coalesce(n, 0), blocks)) FROM need LEFT JOIN held USING (s), tot WHERE coalesce(n, 0) < blocks
),
passes AS (SELECT doc_id, key, s, p * source_size + start AS lo, least(p * source_size + start + size, due) AS hi FROM x, range(3) r(p) WHERE size > 0),
parts AS (SELECT doc_id, key, s, unnest(range(lo // 2048, (hi - 1) // 2048 + 1)) AS rank FROM passes WHERE hi > lo),
took AS (SELECT doc_id, key, count(DISTINCT slot) AS n_slots, min(slot)::BIGINT AS first_slot FROM parts JOIN slots USING (s, rank) GROUP BY doc_id, key)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, due) - start) + greatest(0, least(source_size + start + size, due) - source_size - start) + greatest(0, least(2 * source_size + start + size, due) - 2 * source_size - start))::BIGINT AS taken,
  coalesce(n_slots, 0)::BIGINT AS n_slots, first_slot
FROM x LEFT JOIN took USING (doc_id, key)
"""
